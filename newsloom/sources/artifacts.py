"""Fetch artifacts: a folder per id with content.html, metadata.json, projection.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_METADATA = (
    "content_type STRING, etag STRING, last_modified STRING, content_length BIGINT,"
    " content_sha256 STRING"
)
_PROJECTION = (
    "title STRING, cleaned_text STRING, status STRING, extractor STRING,"
    " diagnostics ARRAY<STRING>"
)


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """One row per artifact folder, ready for ``quality.artifact_problems``."""
    artifact = F.regexp_extract(F.col("path"), r"/([^/]+)/[^/]+$", 1)

    def files(name: str) -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", name)
            .option("recursiveFileLookup", "true")
            .load(root)
            .select(artifact.alias("id"), "content")
        )

    def parsed(name: str, schema: str) -> DataFrame:
        body = F.from_json(F.decode("content", "UTF-8"), schema)
        return files(name).select("id", body.alias("d")).select("id", "d.*")

    return (
        files("content.html")
        .join(parsed("metadata.json", _METADATA), "id", "full_outer")
        .join(parsed("projection.json", _PROJECTION), "id", "full_outer")
    )
