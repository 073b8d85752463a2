"""What workers and the driver hold at a time does not grow with the tables."""

import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import bpe, common, secret_scan
from newsloom.llm.decontamination import decontaminate
from newsloom.llm.graph import filter_places, may_hold, member_filter


def test_workers_get_batches_of_bounded_size(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    docs = spark.range(0, 32, 1, 1).select("id", F.repeat(F.lit("some word "), 100_000).alias("text"))
    fields = [T.StructField("held", T.LongType())]
    make = lambda part: [[part.get_total_buffer_size()] * part.num_rows]
    rows = common.add_columns(docs, "text", fields, make, drop_text=True).collect()
    assert [r.id for r in rows] == list(range(32))
    assert max(r.held for r in rows) < 2 * common.SLICE_BYTES
    # The stage that the driver stopped keeps its rows, however they are cut.
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    some = docs.where("id < 3").union(spark.createDataFrame([(40, "x a b c d e f g h i j k l m n")], docs.schema))
    whole = sorted(r.id for r in decontaminate(some, benchmark).collect())
    monkeypatch.setattr(common, "BATCH_BYTES", 1)
    spark.conf.unset(limit)
    assert sorted(r.id for r in decontaminate(some, benchmark).collect()) == whole == [0, 1, 2]
    # A limit that the session has is kept.
    assert spark.conf.get(limit) == "1"
    spark.conf.set(limit, "3m")
    common.map_batches(some, lambda batches: batches, some.schema)
    assert spark.conf.get(limit) == "3m"
    spark.conf.unset(limit)


def test_filters_come_to_the_driver_in_columns(spark):
    values = spark.range(300_000).withColumnRenamed("id", "v")
    values.count()
    tracemalloc.start()
    try:
        held = member_filter(values, "v")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 << 20
    places = spark.range(0, 300_000, 1000).withColumnRenamed("id", "v").select(*filter_places("v")).toArrow()
    assert may_hold(held, [c.to_numpy() for c in places.columns]).all()
    want = np.zeros_like(held)
    bits = values.select(F.explode(F.array(*filter_places("v"))).alias("p")).toArrow()["p"].to_numpy()
    np.bitwise_or.at(want, bits >> 5, np.uint32(1) << (bits & 31).astype(np.uint32))
    assert (held == want).all()
    assert not member_filter(values.where("v < 0"), "v").any()


def in_every_worker(spark, number) -> dict[int, int]:
    """``number()`` in each Python worker that waits for tasks, by process."""

    def look(batches):
        for _ in batches:
            time.sleep(0.3)  # so that no worker takes two tasks at once
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([number()])], names=["pid", "n"])

    tasks = spark.sparkContext.defaultParallelism
    return {r.pid: r.n for r in spark.range(0, tasks, 1, tasks).mapInArrow(look, "pid bigint, n bigint").collect()}


def test_workers_keep_no_words_of_a_finished_task(spark):
    docs = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    path = bpe.vocabulary_path()
    made, names = bpe.digests(docs, path)
    first = made.collect()

    def words() -> int:
        return len(bpe.load(path).words) if bpe.load.cache_info().currsize else -1

    held = in_every_worker(spark, words)
    assert max(held.values()) == 0
    assert made.collect() == first
    assert [r[names[0]] for r in first] == [len(bpe.load(path).encode(r.text)) for r in first]


def test_a_task_gives_its_memory_back(spark):
    def anonymous() -> int:
        with open("/proc/self/smaps_rollup") as file:
            return next(int(line.split()[1]) for line in file if line.startswith("Anonymous:"))

    def fill(batches):
        for _ in batches:
            held = [pa.array([b"x" * (600 + n % 3000)]) for n in range(60_000)]
            most = anonymous()
            del held
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([most])], names=["pid", "kb"])

    took = common.map_batches(spark.range(0, 1, 1, 1), fill, "pid bigint, kb bigint").collect()[0]
    assert took.kb - in_every_worker(spark, anonymous)[took.pid] > 100_000


def test_rules_reach_the_executors_without_python(spark):
    docs = spark.createDataFrame([(1, "password = abcdefghijkl"), (2, None)], "doc_id bigint, text string")
    queries = {r.kind: q for r in secret_scan.RULES if (q := secret_scan.trigram_query(r.pattern)) is not None}
    postings = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("aki").alias("gram"))
    plan = secret_scan.candidates(postings, queries)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert [r.text for r in secret_scan.mask_secrets(docs).orderBy("doc_id").collect()] == [secret_scan.MASK, None]
