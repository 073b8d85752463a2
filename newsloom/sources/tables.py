"""Collections and read-model tables as Parquet folders.

Big collections are partitioned by day, so a keyed write rewrites only the days
it touches. Small read-model tables are written as whole new versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import upsert

#: Partitions of a table that is keyed by a hash.
BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The collection at ``path``; empty when nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str, *, day_of: str | None = None) -> None:
    if day_of is None:
        df.write.mode("append").parquet(path)
        return
    dated = df.withColumn("day", F.to_date(day_of))
    dated.write.mode("append").partitionBy("day").parquet(path)


def replace_rows(
    spark: SparkSession, path: str, changes: DataFrame, schema: str, *, key: str, day_of: str
) -> None:
    """Replace rows by ``key`` inside the days the changes belong to.

    Only for rows whose day never changes (it comes from their own creation time):
    other days cannot hold the key then and are neither read nor written. Where a
    row can come again with another time, use :func:`replace_keyed`. Running it
    twice with the same changes gives the same table.
    """
    dated = changes.withColumn("day", F.to_date(day_of))
    if not exists(spark, path):
        dated.write.mode("overwrite").partitionBy("day").parquet(path)
        return
    # Days touched: few by nature (a handful per run), used for partition pruning.
    days = [r["day"] for r in dated.select("day").distinct().collect()]
    if not days:
        return
    stored = spark.read.schema(f"{schema}, day DATE").parquet(path).filter(F.col("day").isin(days))
    merged = upsert.replace_by_key(stored, dated, [key])
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def replace_keyed(
    spark: SparkSession, path: str, changes: DataFrame, schema: str, *, key: str, buckets: int = BUCKETS
) -> None:
    """Replace rows by ``key`` in a table partitioned by a hash of the key.

    A key always has the same bucket, whenever its row is written, so only the
    buckets of the changes are read and rewritten. ``changes`` holds one row per
    key and is read several times: pass a stored or checkpointed frame. All
    writers of a table use the same number of buckets.
    """
    placed = changes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    merged = placed
    if exists(spark, path):
        # At most ``buckets`` values.
        touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]
        if not touched:
            return
        stored = spark.read.schema(f"{schema}, bucket INT").parquet(path)
        merged = upsert.replace_by_key(stored.filter(F.col("bucket").isin(touched)), placed, [key])
    (
        merged.repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def _versions(spark: SparkSession, root: str) -> list[int]:
    location = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    found = []
    for status in system.listStatus(location):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and system.exists(done):
            found.append(int(name[1:]))
    return sorted(found)


def read_version(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest complete version of a table; empty when there is none."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v{versions[-1]}")


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version; readers see it only once it is complete."""
    versions = _versions(df.sparkSession, root)
    path = f"{root}/v{(versions[-1] if versions else 0) + 1}"
    df.write.mode("overwrite").parquet(path)
    return path
