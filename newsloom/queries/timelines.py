"""Queries over windows, rankings, popularity and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import mentions, popularity, popularity_log, ranking
from newsloom.plans import publish, timeline
from newsloom.queries import sql
from newsloom.queries.bindings import FIRST_DAY, LAST_DAY, NOW, Newsroom
from newsloom.queries.registry import register
from newsloom.session import shared_folder


@register(
    "top_entities_24h",
    sql.query("""
        SELECT entity_id, canonical_name, entity_type, mention_count_24h, last_seen_at
        FROM popularity ORDER BY mention_count_24h DESC, canonical_name, entity_id, entity_type
        LIMIT 10"""),
)
def top_entities_24h(room: Newsroom) -> DataFrame:
    counted = popularity.popularity(room.articles, room.mentions, room.catalog, NOW)
    return counted.orderBy(
        F.col("mention_count_24h").desc(), "canonical_name", "entity_id", "entity_type"
    ).limit(10)


@register(
    "entity_popularity",
    sql.query("""
        SELECT entity_id, canonical_name, entity_type, mention_count_24h, last_seen_at
        FROM popularity"""),
)
def entity_popularity(room: Newsroom) -> DataFrame:
    return popularity.popularity(room.articles, room.mentions, room.catalog, NOW)


@register(
    "popularity_increments",
    sql.query("""
        SELECT entity_id, canonical_name, entity_type, mention_count_24h, last_seen_at
        FROM popularity"""),
)
def popularity_increments(room: Newsroom) -> DataFrame:
    """The same figures from stored day counts, after three runs whose second is delivered twice."""
    root = f"{shared_folder(room.spark)}/newsloom/popularity-{uuid.uuid4().hex}"

    def of_run(rows: DataFrame, id_: str, number: int) -> DataFrame:
        return rows.filter(F.pmod(F.xxhash64(id_), F.lit(3)) == number)

    for number in (0, 1, 1, 2):  # each run brings its articles with their own mentions
        popularity_log.update(room.spark, root, of_run(room.articles, "id", number), of_run(room.mentions, "article_id", number))
    return popularity_log.popularity(room.spark, root, room.catalog, NOW)


@register(
    "window_starts",
    sql.query(f"SELECT DISTINCT {sql.floor3('crawl_date')} AS window_start FROM articles"),
)
def window_starts(room: Newsroom) -> DataFrame:
    return timeline.window_starts(room.articles, FIRST_DAY, LAST_DAY)


def _dated(room: Newsroom) -> DataFrame:
    return ranking.dated_keys(mentions.named(room.mentions), room.articles)


@register(
    "window_entity_counts",
    sql.query("""
        SELECT window_end, entity_id, canonical_name, entity_type, mention_count
        FROM window_counts"""),
)
def window_entity_counts(room: Newsroom) -> DataFrame:
    counts = ranking.sliding_counts(ranking.bucket_counts(_dated(room)))
    return counts.drop("window_articles")


@register(
    "window_top_entities",
    sql.query("""
        SELECT window_end, entity_type, rank, entity_id, canonical_name, mention_count
        FROM window_tops"""),
)
def window_top_entities(room: Newsroom) -> DataFrame:
    return timeline.top_entities(_dated(room)).select(
        "window_end", "entity_type", F.col("rank").cast("bigint").alias("rank"), "entity_id",
        "canonical_name", "mention_count",
    )


def _pairs(room: Newsroom) -> DataFrame:
    dated = timeline.window_keys(room.articles, room.mentions, FIRST_DAY, LAST_DAY)
    return timeline.window_pairs(dated, FIRST_DAY, LAST_DAY)


@register(
    "entity_window_articles",
    sql.query("""
        SELECT window_start, window_end, entity_id, canonical_name, entity_type, article_id
        FROM window_pairs"""),
)
def entity_window_articles(room: Newsroom) -> DataFrame:
    return _pairs(room).select(
        "window_start", "window_end", "entity_id", "canonical_name", "entity_type", "article_id"
    )


@register(
    "entity_window_top5",
    sql.query("""
        SELECT window_start, entity_id, canonical_name, entity_type, article_id, mentions_in_text,
            rank
        FROM window_ranked"""),
)
def entity_window_top5(room: Newsroom) -> DataFrame:
    from newsloom.operators.articles import with_text

    ranked = timeline.ranked_articles(_pairs(room), with_text(room.articles, room.contents))
    return ranked.select(
        "window_start", "entity_id", "canonical_name", "entity_type", "article_id",
        F.col("mentions_in_text").cast("bigint").alias("mentions_in_text"),
        F.col("rank").cast("bigint").alias("rank"),
    )


_SUMMARY_SQL = """
    SELECT id, entity_id, canonical_name, entity_type, window_start, window_end,
        array_to_string(article_ids, ',') AS article_ids, article_count, short_description,
        aggregated_news
    FROM summaries"""


def _summary_columns(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "id", "entity_id", "canonical_name", "entity_type", "window_start", "window_end",
        F.array_join("article_ids", ",").alias("article_ids"),
        F.col("article_count").cast("bigint").alias("article_count"),
        "short_description", "aggregated_news",
    )


@register("timeline_summaries", sql.query(_SUMMARY_SQL))
def timeline_summaries(room: Newsroom) -> DataFrame:
    from newsloom.queries.bindings import RUN_TIME

    return _summary_columns(
        timeline.summarize(
            room.articles, room.contents, room.mentions,
            start=FIRST_DAY, end=LAST_DAY, now=RUN_TIME,
        )
    )


@register(
    "pending_summaries",
    sql.query("""
        SELECT id, entity_id, window_start FROM summaries ORDER BY window_start, id LIMIT 50"""),
)
def pending_summaries(room: Newsroom) -> DataFrame:
    return publish.pending(room.summaries, 50).select("id", "entity_id", "window_start")
