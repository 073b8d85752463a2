"""Popularity kept up to date: distinct pairs and their counts per 3-hour bucket, stored by day.

An update takes the articles of one run with all their mentions. It replaces
those articles' pairs in the days they were crawled, recounts the days it
touched, and leaves all other days' files alone. A query sums the whole buckets
of its 24 hours from the counts and takes the two cut ones at the edges from the
pairs; folder names prune both to the days of the range.

Counts are stored by what a catalog may leave open. Where it knows an entity's
name and type, articles count once per entity, whatever the mention said; else by
the mention's own name, type, or both. So a later change of the catalog changes
names at once and no stored count.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import text, windows
from newsloom.session import cut_lineage
from newsloom.sources import tables

PAIRS = "article_id STRING, crawl_date TIMESTAMP, bucket TIMESTAMP, entity_id STRING, name STRING, type STRING, day DATE"
COUNTS = "bucket TIMESTAMP, entity_id STRING, name STRING, type STRING, by_name BOOLEAN, by_type BOOLEAN, articles BIGINT, last_seen TIMESTAMP, day DATE"
_GRAIN = ["entity_id", "name", "type", "by_name", "by_type"]


def pairs_of(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct (article, entity, mention name and type) of dated articles and named mentions."""
    dated = articles.filter(F.col("crawl_date").isNotNull()).select(F.col("id").alias("article_id"), "crawl_date")
    named = mentions.filter(
        (F.coalesce("canonical_entity_id", F.lit("")) != "") & (F.coalesce("canonical_name", F.lit("")) != "")
    ).select(
        "article_id",
        F.col("canonical_entity_id").alias("entity_id"),
        F.col("canonical_name").alias("name"),
        text.entity_type(F.coalesce("label", F.lit("CLUB"))).alias("type"),
    )
    return named.join(dated, "article_id").distinct().select(
        "article_id", "crawl_date", windows.floor_window(F.col("crawl_date")).alias("bucket"), "entity_id", "name", "type",
        F.to_date("crawl_date").alias("day"),
    )


def _counted(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct articles and the last date, by ``by`` and each choice of mention name and type.

    Pairs move once, to their entity and ``by``; their four choices are made, made distinct and counted there.
    """
    choice = F.explode(
        F.array(*[F.struct(F.lit(n).alias("by_name"), F.lit(t).alias("by_type")) for n in (False, True) for t in (False, True)])
    )
    chosen = pairs.repartition(*by, "entity_id").withColumn("c", choice).select(
        *by, "article_id", "crawl_date", "entity_id",
        F.when(F.col("c.by_name"), F.col("name")).alias("name"), F.when(F.col("c.by_type"), F.col("type")).alias("type"), "c.*",
    )
    return chosen.distinct().groupBy(*by, *_GRAIN).agg(F.count("*").alias("articles"), F.max("crawl_date").alias("last_seen"))


def _write(frame: DataFrame, path: str) -> None:
    (
        frame.repartition("day")
        .sortWithinPartitions("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def update(spark: SparkSession, root: str, articles: DataFrame, mentions: DataFrame) -> None:
    """Replace the pairs of ``articles`` (id, crawl_date) by those of ``mentions``.

    ``mentions`` are all mentions of these articles (others are not looked at); an
    article without any loses its pairs. An article keeps its crawl date. Running
    an update again changes nothing.
    """
    given = cut_lineage(articles.filter(F.col("crawl_date").isNotNull()).select("id", "crawl_date").distinct())
    # One row per day of crawling that the run touches.
    days = [row["day"] for row in given.select(F.to_date("crawl_date").alias("day")).distinct().collect()]
    if not days:
        return
    fresh = pairs_of(given, mentions)
    stored = tables.read(spark, f"{root}/pairs", PAIRS).filter(F.col("day").isin(days))
    others = stored.join(given.select(F.col("id").alias("article_id")), "article_id", "left_anti")
    pairs = cut_lineage(others.select(*fresh.columns).unionByName(fresh))
    counts = cut_lineage(_counted(pairs, ["bucket", "day"]).select(*[f.split()[0] for f in COUNTS.split(", ")]))
    # A day that lost its last pair would keep its files: such days get a row that counts nothing.
    kept = {row["day"] for row in pairs.select("day").distinct().collect()}
    _write(_with_empty(pairs, [d for d in days if d not in kept], PAIRS), f"{root}/pairs")
    _write(_with_empty(counts, [d for d in days if d not in kept], COUNTS), f"{root}/counts")


def _with_empty(frame: DataFrame, days: list, schema: str) -> DataFrame:
    if not days:
        return frame
    none = frame.sparkSession.createDataFrame([(d,) for d in days], "day DATE")
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", ")) if name != "day"]
    return frame.unionByName(none.select(*blank, "day"))


def _days(frame: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return frame.filter(F.col("day").between(F.lit(start.date()), F.lit(end.date())) & F.col("entity_id").isNotNull())


def _border(moment: datetime, up: bool) -> datetime:
    step = timedelta(hours=settings.WINDOW_HOURS)
    past = (moment - datetime(1970, 1, 1, tzinfo=moment.tzinfo)) % step
    return moment - past + (step if up and past else timedelta())


def counts_between(spark: SparkSession, root: str, start: datetime, end: datetime) -> DataFrame:
    """Articles and last date per entity, mention name and type choice over ``[start, end)``."""
    first, last = _border(start, True), _border(end, False)
    moment: Column = F.col("crawl_date")
    inside = (moment >= F.lit(start)) & (moment < F.lit(end))
    whole = _days(tables.read(spark, f"{root}/counts", COUNTS), start, end)
    cut = _days(tables.read(spark, f"{root}/pairs", PAIRS), start, end).filter(inside)
    if first < last:
        whole = whole.filter((F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(last)))
        cut = cut.filter((moment < F.lit(first)) | (moment >= F.lit(last)))
    else:
        whole = whole.limit(0)
    parts = whole.select(*_GRAIN, "articles", "last_seen").unionByName(_counted(cut, []).select(*_GRAIN, "articles", "last_seen"))
    return parts.groupBy(*_GRAIN).agg(F.sum("articles").alias("articles"), F.max("last_seen").alias("last_seen"))


def popularity(spark: SparkSession, root: str, entities: DataFrame, now: datetime) -> DataFrame:
    """As :func:`newsloom.operators.popularity.popularity`, from the stored counts."""
    counted = counts_between(spark, root, now - timedelta(hours=settings.POPULARITY_HOURS), now)
    known = entities.select(
        F.col("id").alias("entity_id"),
        text.present(F.col("canonical_name")).alias("catalog_name"),
        text.present(F.col("entity_type")).alias("catalog_type"),
    )
    fitting = (F.col("by_name") == F.col("catalog_name").isNull()) & (F.col("by_type") == F.col("catalog_type").isNull())
    return counted.join(known, "entity_id", "left").filter(fitting).select(
        "entity_id",
        F.coalesce("catalog_name", "name").alias("canonical_name"),
        F.when(F.col("catalog_type").isNotNull(), text.entity_type(F.col("catalog_type"))).otherwise(F.col("type")).alias("entity_type"),
        F.col("articles").alias("mention_count_24h"),
        F.col("last_seen").alias("last_seen_at"),
    )
