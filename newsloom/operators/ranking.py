"""Popularity counts, windowed top-N and top articles per entity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import text, windows

KEY = ["entity_id", "canonical_name", "entity_type"]


def dated_keys(named: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct (article, entity key) pairs with the article's crawl date.

    Mentions move once: the join partitions them by article, and that already
    satisfies the deduplication, whose keys contain the article.
    """
    dates = articles.select(F.col("id").alias("article_id"), "crawl_date").filter(
        F.col("crawl_date").isNotNull()
    )
    return named.join(dates, "article_id").distinct()


def bucket_counts(dated: DataFrame) -> DataFrame:
    """Distinct articles per entity key and three-hour bucket.

    Pairs are distinct and an article lies in one bucket, so a plain count is a
    distinct count, and map-side partial counts absorb hot entities.
    """
    return dated.groupBy(windows.floor_window(F.col("crawl_date")).alias("bucket"), *KEY).agg(
        F.count("*").alias("articles")
    )


def sliding_counts(buckets: DataFrame) -> DataFrame:
    """Articles per entity key in every 24-hour window ending on a 3-hour mark.

    A 24-hour window is eight whole buckets, so the eight-fold expansion runs on
    bucket counts and never on articles. The counts move to their entity key before
    that, where all sums of an entity can be made: what is expanded is not shuffled,
    and an entity has one row per bucket at most. ``window_articles`` counts the
    articles of the last bucket, the 3-hour window itself.
    """
    steps = F.sequence(F.lit(1), F.lit(settings.POPULARITY_HOURS // settings.WINDOW_HOURS))
    ends = F.transform(steps, lambda k: F.timestamp_add("HOUR", k * settings.WINDOW_HOURS, F.col("bucket")))
    is_last = windows.window_end(F.col("bucket")) == F.col("window_end")
    return (
        buckets.filter(F.col("bucket").isNotNull())
        .repartition(*KEY)
        .withColumn("window_end", F.explode(ends))
        .groupBy("window_end", *KEY)
        .agg(
            F.sum("articles").alias("mention_count"),
            F.coalesce(F.sum(F.when(is_last, F.col("articles"))), F.lit(0)).alias("window_articles"),
        )
    )


def type_limit(entity_type: Column, limits: Mapping[str, int]) -> Column:
    """Limit of a type; null for types without one."""
    chain = F.when(F.lit(False), F.lit(0))
    for name, limit in limits.items():
        chain = chain.when(entity_type == name, F.lit(limit))
    return chain


def top_per_type(
    counts: DataFrame,
    *,
    by: list[str],
    limits: Mapping[str, int] = settings.TOP_ENTITIES_BY_TYPE,
    count: str = "mention_count",
) -> DataFrame:
    """First entities of each type within ``by``: count desc, name, id."""
    order = Window.partitionBy(*by, "entity_type").orderBy(
        F.col(count).desc(), "canonical_name", "entity_id"
    )
    # The constant bound lets Spark cut every map task's output before the shuffle.
    return (
        counts.filter(F.col("entity_type").isin(*limits))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max(limits.values()))
        .filter(F.col("rank") <= type_limit(F.col("entity_type"), limits))
    )


def count_mentions(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Whole-word count of ``canonical_name`` in each pair's article text.

    ``contents`` is (id, filtered_content). The text is read once per article
    and dropped in the same stage, so it is never shuffled per entity.
    """
    texts = contents.select(F.col("id").alias("article_id"), "filtered_content")
    return pairs.join(texts, "article_id", "left").select(
        *pairs.columns,
        text.mention_count(F.col("filtered_content"), F.col("canonical_name")).alias(
            "mentions_in_text"
        ),
    )


def top_articles(
    counted: DataFrame, *, by: list[str], limit: int = settings.ARTICLES_PER_ENTITY
) -> DataFrame:
    """The first articles of each group: mentions desc, crawl date desc, id."""
    order = Window.partitionBy(*by).orderBy(
        F.col("mentions_in_text").desc(), F.col("crawl_date").desc(), "article_id"
    )
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def newest_first(fields: Column) -> Column:
    """Order a small array of structs that start with (crawl_date, rank, ...)."""
    def compare(a: Column, b: Column) -> Column:
        return (
            F.when(a["crawl_date"] > b["crawl_date"], -1)
            .when(a["crawl_date"] < b["crawl_date"], 1)
            .when(a["rank"] < b["rank"], -1)
            .when(a["rank"] > b["rank"], 1)
            .otherwise(0)
        )

    return F.array_sort(fields, compare)
