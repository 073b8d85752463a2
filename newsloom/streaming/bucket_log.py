"""Windowed popularity across micro-batches, with late rows kept aside.

The state is a log: each micro-batch writes the distinct (article, entity) pairs
it brings, their counts per 3-hour bucket, and the latest event time so far, all
under its own batch number. A batch reads back only the buckets it needs, which
the folder names prune. When the watermark passes the end of a bucket, the
bucket's counts, and the 24-hour window that ends there, are summed from the log:
a row is stored once, not once for each of the eight windows that cover it.

A row is late when its bucket closed before its batch began, by the watermark of
all earlier batches; late rows go to a table of their own and change nothing else.
A batch that runs again overwrites its own folders, so a retry is harmless. The
root folder and the stream's checkpoint belong together.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import settings
from newsloom.operators import ranking

LATENESS = timedelta(minutes=10)
BUCKET = timedelta(hours=settings.WINDOW_HOURS)
WINDOW = timedelta(hours=settings.POPULARITY_HOURS)

_KEYS = ", ".join(f"{c} STRING" for c in ranking.KEY)
PAIRS = f"article_id STRING, {_KEYS}, start TIMESTAMP, day DATE, batch INT"
COUNTS = f"start TIMESTAMP, {_KEYS}, n BIGINT, day DATE, batch INT"
MARKS = "latest TIMESTAMP, batch INT"
LATE = f"article_id STRING, {_KEYS}, crawl_date TIMESTAMP, batch INT"
CLOSED_BUCKETS = f"window_start TIMESTAMP, {_KEYS}, mention_count BIGINT, batch INT"
CLOSED_WINDOWS = f"window_end TIMESTAMP, {_KEYS}, mention_count BIGINT, batch INT"


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the log; empty before its first batch."""
    location = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came after their bucket had closed, with their batch."""
    return read(spark, root, "late", LATE)


def closed_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Articles per entity key in each closed 3-hour window."""
    return read(spark, root, "buckets", CLOSED_BUCKETS).drop("batch")


def closed_windows(spark: SparkSession, root: str) -> DataFrame:
    """Articles per entity key in each closed 24-hour window, every 3 hours."""
    return read(spark, root, "windows", CLOSED_WINDOWS).drop("batch")


def _bucket_start(moment: Column) -> Column:
    return F.window(moment, f"{settings.WINDOW_HOURS} hours")["start"]


def _floor(moment: datetime | None) -> datetime | None:
    """The last bucket border at or before ``moment`` (a naive UTC time)."""
    if moment is None:
        return None
    epoch = datetime(1970, 1, 1)
    return epoch + (moment - epoch) // BUCKET * BUCKET


class BucketLog:
    """Batch function of the log: :meth:`process` handles one micro-batch of mentions."""

    def __init__(self, root: str, lateness: timedelta = LATENESS):
        self.root, self.lateness = root, lateness

    def _write(self, frame: DataFrame, name: str, batch_id: int, *by: str) -> None:
        writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{name}/batch={batch_id}")

    def _before(self, spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame:
        return read(spark, self.root, name, schema).filter(F.col("batch") < batch_id)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("article_id", *ranking.KEY, "crawl_date").withColumn("start", _bucket_start(F.col("crawl_date")))
        rows = rows.persist()
        try:
            self._process(spark, rows, batch_id)
        finally:
            rows.unpersist()

    def _process(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> None:
        # One row per batch.
        seen = self._before(spark, "marks", MARKS, batch_id).agg(F.max("latest")).first()[0]
        latest = rows.agg(F.max("crawl_date")).first()[0]
        latest = max((m for m in (seen, latest) if m is not None), default=None)
        closed = _floor(seen - self.lateness) if seen is not None else None
        closing = _floor(latest - self.lateness) if latest is not None else None

        late = F.lit(False) if closed is None else F.col("start") < F.lit(closed)
        self._write(rows.filter(late).drop("start"), "late", batch_id)
        fresh = rows.filter(~late & F.col("crawl_date").isNotNull()).drop("crawl_date").distinct()
        fresh = fresh.withColumn("day", F.to_date("start"))
        known = self._before(spark, "pairs", PAIRS, batch_id)
        if closed is not None:  # only open buckets can meet again
            known = known.filter((F.col("day") >= F.lit(closed.date())) & (F.col("start") >= F.lit(closed)))
        pair = ["article_id", *ranking.KEY, "start"]
        on = [fresh[c].eqNullSafe(known[c]) for c in pair]
        self._write(fresh.join(known, on, "left_anti"), "pairs", batch_id, "day")
        mine = read(spark, self.root, "pairs", PAIRS).filter(F.col("batch") == batch_id)
        counted = mine.groupBy("start", *ranking.KEY, "day").agg(F.count("*").alias("n"))
        self._write(counted, "counts", batch_id, "day")
        self._close(spark, batch_id, closed, closing)
        self._write(spark.createDataFrame([(latest,)], "latest TIMESTAMP").coalesce(1), "marks", batch_id)

    def _close(self, spark: SparkSession, batch_id: int, closed: datetime | None, closing: datetime | None) -> None:
        """Emit what ends after ``closed``, up to ``closing``."""
        counts = read(spark, self.root, "counts", COUNTS).filter(F.col("batch") <= batch_id)
        if closing is None:
            counts = counts.limit(0)
        else:
            counts = counts.filter((F.col("day") <= F.lit(closing.date())) & (F.col("start") < F.lit(closing)))
            if closed is not None:
                first = closed + BUCKET - WINDOW
                counts = counts.filter((F.col("day") >= F.lit(first.date())) & (F.col("start") >= F.lit(first)))
        ends = F.transform(
            F.sequence(F.lit(1), F.lit(WINDOW // BUCKET)), lambda k: F.timestamp_add("HOUR", k * settings.WINDOW_HOURS, F.col("start"))
        )
        now = F.lit(True) if closed is None else F.col("end") > F.lit(closed)
        ended = counts.withColumn("end", F.explode(ends)).filter(now & (F.col("end") <= F.lit(closing)))
        sums = ended.groupBy(F.col("end").alias("window_end"), *ranking.KEY).agg(F.sum("n").alias("mention_count"))
        self._write(sums, "windows", batch_id)
        last = counts.filter(F.lit(True) if closed is None else F.col("start") >= F.lit(closed))
        own = last.groupBy(F.col("start").alias("window_start"), *ranking.KEY).agg(F.sum("n").alias("mention_count"))
        self._write(own, "buckets", batch_id)


def run(mentions: DataFrame, root: str, checkpoint: str, lateness: timedelta = LATENESS) -> StreamingQuery:
    """Process everything available now; tables are read with the functions above."""
    return (
        mentions.writeStream.foreachBatch(BucketLog(root, lateness).process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
