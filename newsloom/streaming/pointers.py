"""The pointer stream: decode, validate, deduplicate and process articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas, settings
from newsloom.operators import quality
from newsloom.plans import entities as entity_plan
from newsloom.session import cut_lineage
from newsloom.sources import tables

# How long the id of a pointer is remembered for deduplication.
DEDUPE_DELAY = "1 day"

#: The table of rewritten texts.
FILTERED = "id STRING, filtered_content STRING"


def read_kafka(spark: SparkSession, brokers: str, *, max_offsets: int = 1_000_000) -> DataFrame:
    """The topic from its earliest offset; needs the Kafka package on the cluster."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", settings.CRAWLED_TOPIC)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def read_files(spark: SparkSession, folder: str, *, max_files: int = 1000) -> DataFrame:
    """The same events as JSON lines in a folder."""
    return (
        spark.readStream.schema("value STRING")
        .option("maxFilesPerTrigger", max_files)
        .text(folder)
    )


def decode(raw: DataFrame) -> DataFrame:
    """Events with their contract problems; a null payload is one of them."""
    checked = quality.check_events(raw)
    problems = F.when(F.isnull("value"), F.array(F.lit("null_payload"))).otherwise(
        F.col("problems")
    )
    return checked.withColumn("problems", problems)


def accepted(decoded: DataFrame) -> DataFrame:
    """Valid pointers: article id, canonical URL and event time."""
    return decoded.filter(F.size("problems") == 0).select(
        F.lower("event.payload.article_id").alias("article_id"),
        F.col("event.payload.canonical_url").alias("canonical_url"),
        F.col("event.payload.source_name").alias("source_name"),
        F.try_to_timestamp("event.occurred_at").alias("occurred_at"),
    )


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.size("problems") > 0).select("value", "problems")


def store_quarantined(decoded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep rejected payloads with their problems; stops when all available ones are stored."""
    return (
        quarantined(decoded)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay(rejected: DataFrame, mended: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of mended payloads that were never replayed, and the rows that the ledger gains.

    ``rejected`` and ``mended`` are keyed by ``payload_id`` (:func:`payload_id` of the
    rejected text); ``ledger`` holds the ids that were replayed before. A payload that
    still breaks the contract, or was never rejected, is left out and may be mended again.
    """
    known = rejected.select("payload_id").distinct()
    offered = mended.groupBy("payload_id").agg(F.min("value").alias("value")).join(known, "payload_id", "left_semi")
    fresh = decode(offered.join(ledger.select("payload_id"), "payload_id", "left_anti"))
    return accepted(fresh), fresh.filter(F.size("problems") == 0).select("payload_id")


def payload_id(value: Column) -> Column:
    """The name of a payload: a hash of its text; a missing text has one, too."""
    return F.sha2(F.coalesce(value, F.lit("")), 256)


def first_pointers(pointers: DataFrame, delay: str = DEDUPE_DELAY) -> DataFrame:
    """Each article once within the watermark; its state is dropped after it."""
    return pointers.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(
        ["article_id"]
    )


def article_processor(
    spark: SparkSession,
    *,
    content_path: str,
    entities_path: str,
    filtered_path: str,
    catalog: DataFrame,
) -> Callable[[DataFrame, int], None]:
    """Batch function: process the articles of a micro-batch and replace their rows.

    Rewritten texts go to ``filtered_path`` (``id``, ``filtered_content``) before
    the mentions. Both tables are keyed by article id, so a replayed batch, or a
    pointer that comes again on another day, replaces its rows: at-least-once
    delivery gives exactly-once tables. A pointer whose content is not stored
    yet gets no row; the article stays in the backlog.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        pointed = cut_lineage(batch.select(F.col("article_id").alias("id")).distinct())
        contents = tables.read(session, content_path, schemas.NEWS_CONTENT)
        stored = contents.filter(F.col("content").isNotNull()).join(pointed, "id", "left_semi")
        filtered = cut_lineage(entity_plan.filtered_contents(stored, catalog))
        tables.replace_keyed(session, filtered_path, filtered, FILTERED, key="id")
        found = entity_plan.extract_mentions(filtered, catalog)
        ready = filtered.select("id", F.col("filtered_content").alias("content"))
        rows = entity_plan.news_entities(filtered, found, ready, F.current_timestamp())
        tables.replace_keyed(session, entities_path, cut_lineage(rows), schemas.NEWS_ENTITIES, key="id")

    return process


def drain(
    pointers: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything available now, then stop; offsets commit after each batch."""
    return (
        pointers.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
