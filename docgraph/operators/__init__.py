"""Relational operators of the retrieval and evaluation pipelines."""
