"""Session settings: what a job needs from any session, and a local default."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on.

    Naive times are UTC here, so the session zone must be UTC. Dynamic partition
    overwrite is what lets keyed sinks rewrite only the partitions they touch.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def local_session(name: str = "newsloom", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cores = os.cpu_count() or 4 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


# A full file split; Spark's default for spark.sql.files.maxPartitionBytes.
SPLIT_BYTES = 128 * 1024 * 1024
# Input per core below which a table is dealt out anew on reading: above, only Python work on its texts asks for it.
SPREAD_BYTES = 4 * 1024 * 1024

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (local
    runs and tests) a temporary folder is made, once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _folders[application]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and forget its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = SPLIT_BYTES) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core.

    Only an input too small to fill the cores with splits of ``per_core`` bytes is redistributed,
    judged by the plan's own size estimate (nothing runs for it). At scale the
    estimate is far above that and ``df`` is returned unchanged.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_core else df
