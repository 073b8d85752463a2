"""Distinct-article popularity of entities over the last 24 hours."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import text


def in_range(articles: DataFrame, start: Column, end: Column, column: str = "crawl_date") -> DataFrame:
    """Half-open time range; a literal range is pushed to the scan."""
    return articles.filter((F.col(column) >= start) & (F.col(column) < end))


def popularity(
    articles: DataFrame, mentions: DataFrame, entities: DataFrame, now: datetime
) -> DataFrame:
    """Articles and last crawl date per entity over ``[now - 24h, now)``.

    Names, types and aliases come from the catalog where it knows the id (active
    or not), else from the mention.
    """
    end = F.lit(now)
    start = F.lit(now - timedelta(hours=settings.POPULARITY_HOURS))
    recent = in_range(articles, start, end).select(F.col("id").alias("article_id"), "crawl_date")
    named = mentions.filter(
        (F.coalesce("canonical_entity_id", F.lit("")) != "")
        & (F.coalesce("canonical_name", F.lit("")) != "")
    ).select(
        "article_id",
        F.col("canonical_entity_id").alias("entity_id"),
        F.col("canonical_name").alias("mention_name"),
        F.coalesce("label", F.lit("CLUB")).alias("label"),
    )
    raw = (
        named.join(recent, "article_id")
        .join(
            entities.select(
                F.col("id").alias("entity_id"),
                F.col("canonical_name").alias("catalog_name"),
                F.col("entity_type").alias("catalog_type"),
            ),
            "entity_id",
            "left",
        )
    )
    resolved = raw.select(
        "article_id",
        "crawl_date",
        "entity_id",
        F.coalesce(text.present(F.col("catalog_name")), "mention_name").alias("canonical_name"),
        text.entity_type(
            F.coalesce(text.present(F.col("catalog_type")), "label")
        ).alias("entity_type"),
    ).distinct()
    return resolved.groupBy("entity_id", "canonical_name", "entity_type").agg(
        F.count("*").alias("mention_count_24h"), F.max("crawl_date").alias("last_seen_at")
    )
