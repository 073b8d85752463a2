"""Windowed popularity on streams of dated mentions.

A mention row has article_id, entity_id, canonical_name, entity_type, crawl_date.
Append mode emits a window once the watermark has passed its end, so an open
window is never ranked and late rows are dropped, exactly as a closed window is
not summarised again; the forced batch run is the repair path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import settings
from newsloom.operators import ranking

LATENESS = "10 minutes"


def distinct_mentions(mentions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each (article, entity key) once within the watermark."""
    return mentions.withWatermark("crawl_date", lateness).dropDuplicatesWithinWatermark(
        ["article_id", *ranking.KEY]
    )


def tumbling_counts(mentions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Articles per entity key in each closed 3-hour window."""
    span = F.window("crawl_date", f"{settings.WINDOW_HOURS} hours")
    counted = distinct_mentions(mentions, lateness).groupBy(span.alias("span"), *ranking.KEY).agg(
        F.count("*").alias("mention_count")
    )
    return counted.select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
        *ranking.KEY, "mention_count",
    )


def sliding_counts(mentions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Articles per entity key in each closed 24-hour window, every 3 hours."""
    span = F.window(
        "crawl_date", f"{settings.POPULARITY_HOURS} hours", f"{settings.WINDOW_HOURS} hours"
    )
    counted = distinct_mentions(mentions, lateness).groupBy(span.alias("span"), *ranking.KEY).agg(
        F.count("*").alias("mention_count")
    )
    return counted.select(
        F.col("span.end").alias("window_end"), *ranking.KEY, "mention_count"
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows appended to a table."""
    return (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rank_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Top entities per type of each closed window, one folder per batch.

    Ranking is not possible on an unbounded frame; a micro-batch holds complete
    windows only, so ranking it is exact. Rewriting the batch's own folder makes
    a retry harmless.
    """

    def rank(batch: DataFrame, batch_id: int) -> None:
        tops = ranking.top_per_type(batch, by=["window_end"])
        tops.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.foreachBatch(rank)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
