"""Connected components, and set membership that is small enough to ship."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import keep

#: Bits of a membership filter (2 MB), and hashes per value.
FILTER_BITS, HASHES = 1 << 24, 2


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One round: every neighbour (``both``: that is larger) of a vertex is tied to the smallest one around it."""
    if both:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("m", "a").alias("m"))
    joined = around.join(least, F.col("a") == F.col("c"))
    if both:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    tied = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex that each vertex with an edge can reach: rows (vertex, component).

    ``edges`` has columns ``a`` and ``b`` in any order, loops and repeats allowed.
    Alternates two star rounds until nothing changes; each is written to the
    shared folder, so a lost executor costs one round at most.
    """
    sum_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    now = keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = sum_of(now)
    while seen[0]:
        now = keep(_stars(_stars(now, True), False))
        found = sum_of(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("a")).distinct()
    return now.union(roots.select("a", F.col("a").alias("b"))).select(F.col("a").alias("vertex"), F.col("b").alias("component"))


def filter_places(value: str) -> list[Column]:
    """The bits that stand for a value."""
    return [F.pmod(F.xxhash64(F.lit(k), F.col(value)), F.lit(FILTER_BITS)).cast("int") for k in range(HASHES)]


def member_filter(values: DataFrame, value: str) -> np.ndarray:
    """A filter of fixed size over a column: never wrong about members, sometimes about others."""
    places = values.select(F.explode(F.array(*filter_places(value))).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, p % 32))").alias("bits")
    )
    held = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    found = words.toArrow()  # half a million words as rows of Python objects would take the driver's memory
    held[found["w"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return held


def may_hold(held: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Whether values may be members, by their bits."""
    found = np.ones(len(places[0]), dtype=bool)
    for p in places:
        found &= (held[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0
    return found
