"""Minimax contiguous partition: put groups of rows into shards whose largest is as small as can be.

Groups (rows of equal text) are atoms in the order of a text hash. The smallest
feasible capacity is found by binary search; a capacity is feasible if the
greedy cut, which fills shard after shard, needs no more shards than there are.
A group larger than an even share gets a shard of its own, and the rest is cut
for the shards that are left. The sizes never come to the driver one by one: they are summed over cells, that
is ranges of the hash. Where a cut may fall inside a cell, only that cell is
split further, until every cut lies between atoms, so the result is exact.

Cases: a null text counts as 0 bytes and is a group of its own; equal rows get
slots of their own; fewer groups than shards leave the last shards empty; an
empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import fresh, keep, table

#: Bits of the hash that orders the groups.
BITS = 60
#: Bits that tell cells apart at first, and more with each split.
FIRST, MORE = 12, 8
#: Rows of a shard that are numbered together.
BUCKET_ROWS = 20_000
#: Bytes that each row adds to its text.
OVERHEAD = 16
SHARDS = 40


@dataclass(frozen=True)
class Cell:
    """Groups whose hash lies in ``[low, high)``: their number and size."""

    low: int
    high: int
    groups: int
    size: int


def text_order(text):
    """The place of a text among all: 60 bits of its MD5, -1 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))


def greedy_cuts(cells: list[Cell], ends: list[int], capacity: int, shards: int, loose: bool) -> list[int] | None:
    """Sizes before each cut if shards are filled up to ``capacity``; None if they don't suffice.

    ``loose`` lets a cut fall inside a cell of several groups, wherever it likes.
    """
    cuts, begin, total = [], 0, ends[-1] if ends else 0
    for _ in range(shards):
        limit = begin + capacity
        if limit >= total:
            return cuts + [total]
        k = bisect_right(ends, limit)
        inside = loose and k < len(cells) and cells[k].groups > 1
        cut = limit if inside else (ends[k - 1] if k else 0)
        if cut <= begin:
            return None
        cuts.append(begin := cut)
    return None


def smallest_capacity(cells: list[Cell], ends: list[int], shards: int, loose: bool) -> int:
    """Binary search for the smallest feasible capacity."""
    total = ends[-1]
    low, high = max(1, -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(cells, ends, middle, shards, loose) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _sum(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        out.append(total := total + v)
    return out


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The hash at which each shard ends, from groups of columns ``place`` and ``size``."""

    def cells(frame: DataFrame, width: int) -> list[Cell]:
        step = 1 << width
        low = F.floor(F.col("place") / F.lit(step)).cast("long") if width else F.col("place")
        rows = frame.groupBy(low.alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
        return [Cell(r["cell"] * step, r["cell"] * step + step, r.n, r.s) for r in rows]

    width = BITS - FIRST
    known = sorted(cells(groups, width), key=lambda c: c.low)
    while known:
        ends = _sum([c.size for c in known])
        least = smallest_capacity(known, ends, shards, True)
        most = smallest_capacity(known, ends, shards, False)
        first = greedy_cuts(known, ends, least, shards, False)
        last = greedy_cuts(known, ends, most, shards, True)
        unclear = set()
        if most > least or any(c.groups > 1 for c in _cut_cells(known, ends, last)):
            lows = first if first is not None and most == least else _weak_cuts(known, ends, least, shards)
            for a, b in zip(lows, last):
                begin, end = bisect_right(ends, a), bisect_right(ends, b)
                unclear |= {k for k in range(min(begin, end), min(end + 1, len(known))) if known[k].groups > 1}
        if not unclear or not width:
            cuts = greedy_cuts(known, ends, most, shards, False)
            return [known[bisect_right(ends, c) - 1].high for c in cuts]
        narrow = max(0, width - MORE)
        parts = groups.where(_within(known, sorted(unclear)))
        split = cells(parts, narrow)
        known = sorted([c for k, c in enumerate(known) if k not in unclear] + split, key=lambda c: c.low)
        width = narrow
    return []


def _weak_cuts(cells: list[Cell], ends: list[int], capacity: int, shards: int) -> list[int]:
    """Places that the cuts for ``capacity`` or more never come before."""
    cuts, begin = [], 0
    for _ in range(shards):
        k = bisect_right(ends, begin + capacity)
        begin = max(begin, ends[k - 1] if k else 0)
        cuts.append(begin)
    return cuts


def _cut_cells(cells: list[Cell], ends: list[int], cuts: list[int]) -> list[Cell]:
    return [cells[k] for c in cuts if (k := bisect_right(ends, c)) < len(cells) and (ends[k - 1] if k else 0) != c]


def _within(cells: list[Cell], chosen: list[int]):
    """A condition on ``place``: in one of the chosen cells, neighbours taken together."""
    spans: list[list[int]] = []
    for k in chosen:
        if spans and spans[-1][1] == cells[k].low:
            spans[-1][1] = cells[k].high
        else:
            spans.append([cells[k].low, cells[k].high])
    found = F.lit(False)
    for low, high in spans:
        found = found | ((F.col("place") >= low) & (F.col("place") < high))
    return found


def oversized(groups: DataFrame, shards: int) -> list[int]:
    """The groups, fewer than there are shards, that are larger than an even share of what is left."""
    left = groups.agg(F.sum("size")).first()[0] or 0
    found = []
    for row in groups.orderBy(F.desc("size"), "place").limit(shards - 1).collect():
        if row["size"] * (shards - len(found)) <= left:
            break
        found.append(row["place"])
        left -= row["size"]
    return found


def shard_by_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Shard and slot of each row: doc_id, size, text_crc32, shard, slot.

    Slots count from 0 without gaps. Rows of a shard are numbered in buckets by a
    hash of their id, so that no task gets a whole shard.
    """
    value = F.col(text)
    size = F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + OVERHEAD
    rows = keep(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            size.alias("size"),
            F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
            text_order(value).alias("place"),
        )
    )
    groups = keep(rows.groupBy("place").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    large = oversized(groups, shards)
    rest = groups.where(~F.col("place").isin(large)) if large else groups
    shard = F.lit(len(large))
    for end in plan_cuts(rest, shards - len(large))[:-1]:
        shard = shard + (F.col("place") >= end).cast("int")
    for number, place in enumerate(large):
        shard = F.when(F.col("place") == place, number).otherwise(shard)
    total = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, -(-total // (shards * BUCKET_ROWS)))
    bucket = F.pmod(F.xxhash64("doc_id", "place"), F.lit(buckets)).cast("int")
    placed = rows.withColumns({"shard": shard, "bucket": bucket})
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32")
    return (
        placed.join(offsets, ["shard", "bucket"])
        .withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with a column of the shard (for ids that name one row each)."""
    name = fresh(docs, "shard")
    placed = shard_by_bytes(docs, doc_id, text, shards).select(F.col("doc_id").alias("_id"), F.col("shard").alias(name))
    return docs.join(placed, F.col(doc_id).eqNullSafe(F.col("_id"))).drop("_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes for all documents."""
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
