"""Registered queries: importing the modules fills the registry."""

from newsloom.queries import (  # noqa: F401
    checks,
    ingest_queries,
    publishing,
    serving_queries,
    streams,
    texts,
    timelines,
)
from newsloom.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
