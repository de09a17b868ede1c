"""A PySpark engine for document corpora and the knowledge graphs derived from them."""
