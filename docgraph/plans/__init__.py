"""Named queries over the corpus tables and the SQL that says the same."""

from docgraph.plans import catalogue, catalogue_index, catalogue_more, catalogue_rest, catalogue_wide

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
__all__ = ["ORACLES", "QUERIES", "catalogue", "catalogue_index", "catalogue_more", "catalogue_rest", "catalogue_wide"]
