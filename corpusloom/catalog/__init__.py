"""All registered queries."""

from corpusloom.catalog import (  # noqa: F401
    chunk_queries,
    eval_queries,
    log_queries,
    search_queries,
    store_queries,
    text_queries,
)
from corpusloom.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
