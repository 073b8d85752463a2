"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on random Gaussian directions; each projection,
shifted and cut into cells of one width, gives a number, and the numbers of a
table's directions name a bucket. Vectors that share a bucket in some table are
compared exactly. The number of directions grows with the logarithm of the number
of vectors, so that a bucket holds about ``CHANCE`` vectors by chance at any size,
and the number of tables grows with it, so that a pair at the threshold misses all
tables with a chance of ``MISS`` at most at any size (closer pairs: less).

A bucket of many vectors is dealt into blocks, and pairs of blocks are compared
by matrix products; pairs are counted where they are, in the first table that
brings them together, and never listed. Equal vectors are one, with a number.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different length don't link; repeated ids are
rows of their own with the component of their id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import keep, table
from newsloom.llm.graph import components

#: The least cosine of a link.
COSINE = 0.9
#: Tables at least; width of a cell; the chance that unrelated vectors, and vectors at ``COSINE``, fall in one cell of it.
TABLES, WIDTH, FAR, NEAR = 20, 2.5, 0.567, 0.857
#: The chance, at most, that vectors at ``COSINE`` share no bucket.
MISS = 0.01
#: Vectors that share a bucket by chance, about.
CHANCE = 16
#: Vectors of a block, and vectors that are projected at a time.
BLOCK, PROJECTED = 512, 1024
SEED = 20_24
#: What names a group of vectors that are compared.
GROUPED = ["tab", "bucket", "size", "one", "two"]


def tables(per_table: int) -> int:
    """Tables that keep the chance of a miss within ``MISS`` with so many directions each."""
    return max(TABLES, math.ceil(math.log(MISS) / math.log1p(-(NEAR**per_table))))


def directions(size: int, per_table: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and shifts of all tables, the same everywhere."""
    rng = np.random.default_rng([SEED, size])
    number = tables(per_table) * per_table
    return rng.standard_normal((size, number)), rng.uniform(0, WIDTH, number)


def bucket_keys(vectors: np.ndarray, per_table: int) -> np.ndarray:
    """For each normalised vector its bucket in each table, as 64-bit numbers."""
    lines, shifts = directions(vectors.shape[1], per_table)
    keys = np.full((len(vectors), tables(per_table)), vectors.shape[1], dtype=np.uint64)
    for begin in range(0, len(vectors), PROJECTED):
        some = keys[begin : begin + PROJECTED]
        cells = np.floor((vectors[begin : begin + PROJECTED] @ lines + shifts) / WIDTH).astype(np.int64).view(np.uint64)
        cells = cells.reshape(*some.shape, per_table)
        for k in range(per_table):
            some ^= cells[:, :, k]
            some *= np.uint64(0x9E3779B97F4A7C15)
            some ^= some >> np.uint64(31)
    return keys.view(np.int64)


def _compare(ids, copies, block, split: bool, vectors: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket's vectors, or of two of its blocks (``split``): counts, and the smallest id reached."""
    linked = vectors @ vectors.T >= COSINE
    np.fill_diagonal(linked, False)
    if split:  # pairs within a block are compared where it stands alone
        linked &= block[:, None] != block[None, :]
    label = ids
    if not linked.any():
        return np.zeros(len(ids), dtype=np.int64), label
    while True:
        reached = np.where(linked, label[None, :], label[:, None]).min(axis=1)
        if (reached == label).all():
            break
        label = reached
    for before in range(keys.shape[1]):
        linked &= keys[:, before][:, None] != keys[:, before][None, :]
        if not linked.any():
            break
    return linked @ copies, label


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows: those of one bucket, or of two of its blocks, follow one another.

    A group is bounded by two blocks, and many small ones share an Arrow batch.
    """
    held: list[pa.RecordBatch] = []
    names = ["vec_id", "links", "label"]

    def made(rows: pa.Table) -> pa.RecordBatch | None:
        ids, copies, block, size, one, two, tab = (
            rows.column(n).to_numpy() for n in ("vec_id", "copies", "block", "size", "one", "two", "tab")
        )
        places = _places(rows)
        starts = np.append(np.flatnonzero(places), rows.num_rows)
        vectors, keys = rows.column("vector").to_pylist(), rows.column("keys").to_pylist()
        out: list[tuple] = []
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            x = np.frombuffer(b"".join(vectors[begin:end]), dtype=np.float64).reshape(end - begin, size[begin])
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            k = np.frombuffer(b"".join(keys[begin:end]), dtype=np.int64).reshape(end - begin, tab[begin])
            links, label = _compare(ids[begin:end], copies[begin:end], block[begin:end], one[begin] != two[begin], x, k)
            some = np.flatnonzero((links > 0) | (label != ids[begin:end]))
            out.append((ids[begin:end][some], links[some], label[some]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        last = int(np.flatnonzero(_places(rows))[-1])  # its group may go on
        if last:
            yield made(rows.slice(0, last))
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield made(pa.Table.from_batches(held))


def _places(rows: pa.Table) -> np.ndarray:
    """Where a group begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for name in GROUPED:
        value = rows.column(name).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return new


def embedding_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id), one per row of ``vectors``."""
    value = F.col(embedding).cast("array<double>")
    # float("nan") and infinities fail the comparison with the largest double.
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(whole, F.lit(False)) & F.exists(value, lambda x: x != 0) & F.col(vec_id).isNotNull()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, value).alias("v"))
    classes = keep(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    number = classes.count()
    per_table = max(2, math.ceil(math.log(max(2, number / CHANCE)) / -math.log(FAR)))

    def hash_(batches):
        for frame in batches:
            raw = [np.asarray(v, dtype=np.float64) for v in frame["v"]]
            keys = [b""] * len(raw)
            for size in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == size]
                some = np.array([raw[i] for i in at])
                some /= np.abs(some).max(axis=1, keepdims=True)  # against overflow
                for i, v in zip(at, some, strict=True):
                    raw[i] = v
                some = some / np.sqrt((some * some).sum(axis=1, keepdims=True))
                for i, k in zip(at, bucket_keys(some, per_table), strict=True):
                    keys[i] = k.tobytes()
            yield pd.DataFrame({"vec_id": frame["rep"], "copies": frame["copies"], "vector": [v.tobytes() for v in raw], "keys": keys,
                                "key": [np.frombuffer(k, dtype=np.int64) for k in keys], "size": [len(v) for v in raw]})

    hashed = keep(classes.mapInPandas(hash_, "vec_id bigint, copies bigint, vector binary, keys binary, key array<bigint>, size int"))
    placed = hashed.select("vec_id", "size", F.posexplode("key").alias("tab", "bucket"))
    parts = F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")
    several = keep(placed.groupBy("tab", "bucket", "size").agg(parts, F.count("*").alias("n")).where("n > 1").drop("n"))
    dealt = placed.join(several, ["tab", "bucket", "size"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("vec_id", "tab", "bucket", "size", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    full = dealt.join(hashed.select("vec_id", "copies", "vector", "keys"), "vec_id")
    full = full.withColumn("keys", F.expr("substring(keys, 1, 8 * tab)"))  # those of the tables before
    full = full.repartition(*GROUPED).sortWithinPartitions(*GROUPED)
    found = keep(full.mapInArrow(_compared, "vec_id bigint, links bigint, label bigint"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.where("label <> vec_id").select(F.col("vec_id").alias("a"), F.col("label").alias("b")))
    reps = classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(parts.withColumnRenamed("vertex", "rep"), "rep", "left")
    reps = reps.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    return rows.join(reps, "v", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    found = embedding_components(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
