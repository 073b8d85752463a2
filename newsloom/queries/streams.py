"""Streaming queries: driver tables replayed as file streams until drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import ranking
from newsloom.queries import sql
from newsloom.queries.bindings import Newsroom
from newsloom.queries.ingest_queries import EVENT_SQL
from newsloom.queries.registry import register
from newsloom.session import cut_lineage, shared_folder
from newsloom.sources import events
from newsloom.streaming import bucket_log, pointers, windows


def _place(room: Newsroom, name: str) -> str:
    return f"{shared_folder(room.spark)}/newsloom/streams/{name}-{uuid.uuid4().hex}"


#: Slices of the mention stream, by time, and files of each.
SLICES, SLICE_FILES = 6, 4


def _mention_rows(room: Newsroom) -> DataFrame:
    dated = room.mentions.filter(F.col("canonical_entity_id").isNotNull()).join(
        room.articles.select(F.col("id").alias("article_id"), "crawl_date"), "article_id"
    )
    return dated.select(
        "article_id", F.col("canonical_entity_id").alias("entity_id"), "canonical_name",
        F.upper("label").alias("entity_type"), "crawl_date",
    )


def _mention_stream(room: Newsroom, late: bool = False) -> DataFrame:
    """Dated mentions as a stream of slices in time order, one slice per micro-batch.

    With ``late``, the rows of articles whose id begins with 0 come two slices later.
    """
    folder = _place(room, "mentions")
    rows = cut_lineage(_mention_rows(room))
    first, last = rows.agg(F.min("crawl_date"), F.max("crawl_date")).first()
    step = (F.lit(last).cast("double") - F.lit(first).cast("double") + 1) / SLICES
    slice_ = F.floor((F.col("crawl_date").cast("double") - F.lit(first).cast("double")) / step)
    if late:
        slice_ += F.when(F.startswith("article_id", F.lit("0")), 2).otherwise(0)
    placed = rows.withColumn("_slice", slice_)
    for number in range(SLICES + 2 * late):  # one after the other, so that the files' times order them
        some = placed.filter(F.col("_slice") == number).drop("_slice")
        place = f"{folder}/slice-{number}"
        some.coalesce(SLICE_FILES).write.parquet(place)
        # Few or empty partitions give fewer files, and a micro-batch would take the next slice's as well.
        if len(room.spark.read.schema(rows.schema).parquet(place).inputFiles()) < SLICE_FILES:
            some.repartition(SLICE_FILES).write.mode("overwrite").parquet(place)
    stream = room.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", SLICE_FILES)
    return stream.parquet(f"{folder}/slice-*")


# Windows that end later than the last event less the lateness stay open.
_CLOSED = "(SELECT max(crawl_date) - INTERVAL 10 MINUTES FROM entity_keys)"


@register(
    "stream_tumbling_counts",
    sql.query(f"""
        SELECT * FROM (
            SELECT {sql.floor3('crawl_date')} AS window_start, entity_id, canonical_name, entity_type,
                count(*) AS mention_count
            FROM entity_keys GROUP BY 1, 2, 3, 4)
        WHERE window_start + INTERVAL 3 HOURS <= {_CLOSED}"""),
)
def stream_tumbling_counts(room: Newsroom) -> DataFrame:
    path = _place(room, "tumbling")
    counts = windows.tumbling_counts(_mention_stream(room))
    windows.write_counts(counts, path, f"{path}-checkpoint").awaitTermination()
    return room.spark.read.parquet(path).drop("window_end")


@register(
    "stream_sliding_counts",
    sql.query(f"""SELECT window_end, entity_id, canonical_name, entity_type, mention_count
        FROM window_counts WHERE window_end <= {_CLOSED}"""),
)
def stream_sliding_counts(room: Newsroom) -> DataFrame:
    """Bucket counts kept across micro-batches; eight of them make a closed window."""
    path = _place(room, "sliding")
    bucket_log.run(_mention_stream(room), path, f"{path}-checkpoint").awaitTermination()
    return bucket_log.closed_windows(room.spark, path)


# The delayed stream: each row's micro-batch, and the bucket border that had closed before that batch.
_DELAYED = f"""
    SELECT *, {sql.floor3("crawl_date")} AS start FROM (
        SELECT article_id, entity_id, canonical_name, entity_type, crawl_date,
            CAST(floor((epoch(crawl_date) - epoch(first)) / ((epoch(last) - epoch(first) + 1) / 6)) AS INTEGER)
                + CASE WHEN starts_with(article_id, '0') THEN 2 ELSE 0 END AS batch
        FROM (SELECT m.article_id, m.canonical_entity_id AS entity_id, m.canonical_name, upper(m.label) AS entity_type,
                a.crawl_date, min(a.crawl_date) OVER () AS first, max(a.crawl_date) OVER () AS last
            FROM mentions m JOIN articles a ON a.id = m.article_id WHERE m.canonical_entity_id IS NOT NULL))"""
_BORDERS = f"""
    SELECT b.batch, (SELECT {sql.floor3("max(crawl_date) - INTERVAL 10 MINUTES")} FROM delayed d WHERE d.batch < b.batch) AS closed
    FROM (SELECT DISTINCT batch FROM delayed) b"""


@register(
    "stream_late_rows",
    sql.query(f"""SELECT * FROM (WITH delayed AS MATERIALIZED ({_DELAYED}), borders AS MATERIALIZED ({_BORDERS})
        SELECT article_id, entity_id, canonical_name, entity_type, crawl_date, batch
        FROM delayed JOIN borders USING (batch) WHERE start < closed)"""),
)
def stream_late_rows(room: Newsroom) -> DataFrame:
    """Rows of a stream with delays whose bucket had closed: kept aside, all of them and no others."""
    path = _place(room, "late")
    bucket_log.run(_mention_stream(room, late=True), path, f"{path}-checkpoint").awaitTermination()
    return bucket_log.late_rows(room.spark, path)


@register(
    "stream_delayed_counts",
    sql.query(f"""SELECT * FROM (WITH delayed AS MATERIALIZED ({_DELAYED}), borders AS MATERIALIZED ({_BORDERS})
        SELECT start AS window_start, entity_id, canonical_name, entity_type, count(DISTINCT article_id) AS mention_count
        FROM delayed JOIN borders USING (batch)
        WHERE (closed IS NULL OR start >= closed)
            AND start < (SELECT {sql.floor3("max(crawl_date) - INTERVAL 10 MINUTES")} FROM delayed)
        GROUP BY ALL)"""),
)
def stream_delayed_counts(room: Newsroom) -> DataFrame:
    """Closed 3-hour windows of the same stream: every row that wasn't late is counted once."""
    path = _place(room, "delayed")
    bucket_log.run(_mention_stream(room, late=True), path, f"{path}-checkpoint").awaitTermination()
    return bucket_log.closed_buckets(room.spark, path)


@register(
    "stream_window_tops",
    sql.query(f"""SELECT window_end, entity_type, rank, entity_id, canonical_name, mention_count
        FROM window_tops WHERE window_end <= {_CLOSED}"""),
)
def stream_window_tops(room: Newsroom) -> DataFrame:
    """Built-in windows, ranked batch by batch as they close."""
    path = _place(room, "tops")
    counts = windows.sliding_counts(_mention_stream(room))
    windows.rank_windows(counts, path, f"{path}-checkpoint").awaitTermination()
    return room.spark.read.parquet(path).select(
        "window_end", "entity_type", F.col("rank").cast("bigint").alias("rank"),
        *ranking.KEY[:2], "mention_count",
    )


@register(
    "stream_pointers",
    sql.query("SELECT id AS article_id, canonical_url, source_name FROM articles"),
)
def stream_pointers(room: Newsroom) -> DataFrame:
    """All articles' pointers, published twice, validated and deduplicated."""
    folder, path = _place(room, "pointers"), _place(room, "accepted")
    published = events.crawled_events(room.articles, room.run_time)
    events.publish(published.unionByName(published), path=folder)
    stream = pointers.first_pointers(
        pointers.accepted(pointers.decode(pointers.read_files(room.spark, folder)))
    )
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return room.spark.read.parquet(path).select("article_id", "canonical_url", "source_name")


def _damaged_topic(room: Newsroom) -> tuple[str, DataFrame]:
    """A topic folder where events of articles with an id from 0 to 3 are cut in half, and all true events by article."""
    folder = _place(room, "damaged")
    true = events.crawled_events(room.articles, room.run_time).select(F.col("key").alias("article_id"), "value")
    half = F.substring("value", 1, 60)
    sent = true.withColumn("value", F.when(F.substring("article_id", 1, 1).isin("0", "1", "2", "3"), half).otherwise(F.col("value")))
    sent.select("value").write.text(folder)
    return folder, true


def _rejected(room: Newsroom, folder: str) -> DataFrame:
    path = _place(room, "rejected")
    decoded = pointers.decode(pointers.read_files(room.spark, folder, max_files=2))
    pointers.store_quarantined(decoded, path, f"{path}-checkpoint").awaitTermination()
    stored = room.spark.read.schema("value STRING, problems ARRAY<STRING>").parquet(path)
    return stored.withColumn("payload_id", pointers.payload_id(F.col("value")))


_CUT_EVENTS = f"SELECT left(value, 60) AS value, key AS article_id FROM ({EVENT_SQL}) WHERE left(key, 1) IN ('0', '1', '2', '3')"


@register("stream_quarantine", sql.query(f"SELECT sha256(value) AS payload_id, count(*) AS copies FROM ({_CUT_EVENTS}) GROUP BY 1"))
def stream_quarantine(room: Newsroom) -> DataFrame:
    """Payloads that break the contract, kept with their problems."""
    folder, _ = _damaged_topic(room)
    kept = _rejected(room, folder).filter(F.size("problems") > 0)
    return kept.groupBy("payload_id").agg(F.count("*").alias("copies"))


@register("stream_replay", sql.query(f"SELECT article_id, CAST(1 AS BIGINT) AS times FROM ({_CUT_EVENTS})"))
def stream_replay(room: Newsroom) -> DataFrame:
    """Rejected payloads mended in two goes that overlap: each event is replayed once."""
    folder, true = _damaged_topic(room)
    rejected = cut_lineage(_rejected(room, folder))
    # The mended texts of all events; those that were never rejected are not replayed.
    mended = cut_lineage(true.select(pointers.payload_id(F.substring("value", 1, 60)).alias("payload_id"), "value", "article_id"))
    ledger = room.spark.createDataFrame([], "payload_id STRING")
    done = None
    for last in ("1", "3"):
        some = mended.filter(F.substring("article_id", 1, 1) <= last).select("payload_id", "value")
        replayed, gained = pointers.replay(rejected, some, ledger)
        replayed = cut_lineage(replayed.select("article_id"))
        ledger = cut_lineage(ledger.unionByName(gained))
        done = replayed if done is None else done.unionByName(replayed)
    return done.groupBy("article_id").agg(F.count("*").alias("times"))
