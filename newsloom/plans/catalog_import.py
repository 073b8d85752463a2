"""Import of an alias catalog file into the canonical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from newsloom.operators import catalog, upsert
from newsloom.sources.catalog import load_alias_catalog


def import_catalog(spark: SparkSession, path: str, stored: DataFrame, now: Column) -> DataFrame:
    """The stored catalog with the file applied; an alias of two owners is an error."""
    loaded = load_alias_catalog(spark, path, now)
    conflict = catalog.alias_conflicts(loaded).limit(1).collect()
    if conflict:
        row = conflict[0]
        raise ValueError(
            f"alias conflict for {row['alias_key']!r}: {row['first_owner']} and {row['last_owner']}"
        )
    return upsert.catalog(stored, loaded)
