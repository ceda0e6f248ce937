"""The queries over the test tables, by subject."""

from . import amount_queries, answer_queries, catalog_queries, index_queries, language_queries, metadata_queries, more_queries, retrieval_queries, search_queries, store_queries, text_queries, understanding_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
