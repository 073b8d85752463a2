"""Benchmark decontamination with suffix arrays over shards of the training texts.

Words of a shard become numbers of the benchmark's vocabulary (0: a word that no
test item has, which ends every match). The shard's suffixes are sorted by their
first ``window`` words, packed into 64-bit keys, and every test suffix is looked
up by binary search. Its range in the suffix array gives all verbatim matches
and their places; consecutive places on one diagonal join to the longest match.

A suffix with fewer known words ahead than the shortest window cannot hold a
match and is left out of the array; this loses nothing.

Cases: a null or wordless text has 0 words and is never contaminated; an item
without words matches nothing; items that share an id count once; all items without
an id are one, which counts as an item and in hits and has no name in the list; rows
of a repeated document are judged each for itself; an empty benchmark marks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, fresh, keep, table, utf8

#: Words of a window.
WINDOW = 13
#: A document is removed if hits make up one word in so many, or more.
SHARE = 20
#: Bytes of benchmark text that go to the workers at a time.
BLOCK_BYTES = 4 << 20
#: Blocks that the driver holds before what they found is written.
BLOCKS_HELD = 16

#: Lower-cases A-Z and turns every byte outside words into a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("item_id", T.StringType()),
                        T.StructField("item_start", T.LongType()),
                        T.StructField("doc_start", T.LongType()),
                        T.StructField("length", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(LETTERS).split()


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + counts[i] - 1, for all i in turn."""
    return np.repeat(first - _starts(counts), counts) + np.arange(counts.sum())


class TestSuffixes:
    """The windows of a block of test items, ready for look-up in suffix arrays."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        found = [(name, words_of(text)) for name, text in items]
        found = [(name, words) for name, words in found if words]
        self.window = window
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in found for w in words}), 1)}
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.names = sorted({name for name, _ in found}, key=_name_order)
        number = {name: i for i, name in enumerate(self.names)}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, words in found:
            ids = [self.vocabulary[w] for w in words]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1):
                places.setdefault(tuple(ids[start : start + size]), []).append((number[name], start))
        self.lengths = np.array([len(w) for w in places], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if places else 0
        rows = np.zeros((len(places), window), dtype=np.uint64)
        for i, ids in enumerate(places):
            rows[i, : len(ids)] = ids
        ahead = np.arange(window)[None, :] >= self.lengths[:, None]
        filled = np.where(ahead, np.uint64((1 << self.bits) - 1), rows)
        self.low = self._pack(lambda j: rows[:, j])
        self.high = self._pack(lambda j: filled[:, j])
        self.place_counts = np.array([len(p) for p in places.values()], dtype=np.int64)
        self.place_first = _starts(self.place_counts)
        flat = np.array([p for ps in places.values() for p in ps], dtype=np.int64).reshape(-1, 2)
        self.place_item, self.place_start = flat[:, 0], flat[:, 1]

    def _pack(self, word: Callable[[int], np.ndarray]) -> list[np.ndarray]:
        """The word numbers ``word(0)``, ``word(1)``, ... as a few 64-bit keys each, in the same order."""
        per = max(1, 63 // self.bits)
        keys = []
        for begin in range(0, self.window, per):
            key = np.uint64(0)
            for j in range(begin, begin + per):
                key = key << np.uint64(self.bits)
                if j < self.window:
                    key = key | word(j).astype(np.uint64)
            keys.append(key)
        return keys

    def suffix_array(self, shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The places of the shard's suffixes, sorted by their words, and their keys."""
        size = len(shard)
        stops = np.append(np.flatnonzero(shard == 0), size)
        ahead = np.repeat(stops, np.diff(stops, prepend=-1))[:size] - np.arange(size)
        places = np.flatnonzero(ahead >= self.shortest)
        ahead = ahead[places]
        keys = self._pack(lambda j: np.where(j < ahead, shard[np.minimum(places + j, size - 1)], 0))
        order = np.lexsort(keys[::-1])
        return places[order], [key[order] for key in keys]

    @staticmethod
    def _bisect(keys: list[np.ndarray], probes: list[np.ndarray], after: bool) -> np.ndarray:
        """For each probe the number of suffixes before it, or up to it if ``after``."""
        low = np.zeros(len(probes[0]), dtype=np.int64)
        high = np.full(len(probes[0]), len(keys[0]), dtype=np.int64)
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) >> 1, 0)
            before = np.zeros(len(low), dtype=bool)
            equal = np.ones(len(low), dtype=bool)
            for key, probe in zip(keys, probes, strict=True):
                value = key[middle]
                before |= equal & (value < probe)
                equal &= value == probe
            right = open_ & (before | (equal & after))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def search(self, texts: list[bytes]) -> list[dict]:
        """For each text its words, hit intervals, items and longest matches."""
        get = self.vocabulary.get
        coded, counts = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            coded.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
            coded.append(np.zeros(1, dtype=np.int64))
        out = [{"n_words": n, "hits": [], "items": [], "matches": []} for n in counts]
        if not len(self.lengths) or not texts:
            return out
        shard = np.concatenate(coded)
        first = _starts(np.array(counts, dtype=np.int64) + 1)
        places, keys = self.suffix_array(shard)
        if not len(places):
            return out
        begin = self._bisect(keys, self.low, False)
        found = self._bisect(keys, self.high, True) - begin
        at = places[_ranges(begin, found)]
        window = np.repeat(np.arange(len(found)), found)
        if not len(at):
            return out
        self._mark(out, first, at, at + self.lengths[window])
        doc = np.searchsorted(first, at, side="right") - 1
        n = self.place_counts[window]
        which = _ranges(self.place_first[window], n)
        self._join(
            out,
            np.repeat(doc, n),
            self.place_item[which],
            self.place_start[which],
            np.repeat(at - first[doc], n),
            np.repeat(self.lengths[window], n),
        )
        return out

    @staticmethod
    def _mark(out: list[dict], first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Merge the hit windows of each text to intervals."""
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        new = np.append(True, begin[1:] > end[:-1])
        begins, ends = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
        docs = np.searchsorted(first, begins, side="right") - 1
        for doc, b, e in zip(docs.tolist(), (begins - first[docs]).tolist(), (ends - first[docs]).tolist(), strict=True):
            out[doc]["hits"] += [b, e]

    def _join(self, out, doc, item, item_start, doc_start, length) -> None:
        """Join windows that follow one another on a diagonal; keep the longest match of a text and an item."""
        diagonal = doc_start - item_start
        order = np.lexsort((doc_start, diagonal, item, doc))
        doc, item, item_start, doc_start, length, diagonal = (
            x[order] for x in (doc, item, item_start, doc_start, length, diagonal)
        )
        new = np.append(
            True,
            (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(doc_start) != 1),
        )
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(doc)) - 1
        total = doc_start[ends] + length[ends] - doc_start[starts]
        best = np.lexsort((doc_start[starts], -total, item[starts], doc[starts]))
        starts, total = starts[best], total[best]
        lead = np.append(True, (np.diff(doc[starts]) != 0) | (np.diff(item[starts]) != 0))
        for i, n in zip(starts[lead].tolist(), total[lead].tolist(), strict=True):
            name = self.names[item[i]]
            row = out[doc[i]]
            row["items"].append(name)
            row["matches"].append(
                {"item_id": name, "item_start": int(item_start[i]), "doc_start": int(doc_start[i]), "length": n}
            )


def _union(one: list[int], two: list[int]) -> list[int]:
    """The union of two sorted lists of intervals, flat."""
    merged: list[int] = []
    for b, e in sorted([*zip(one[::2], one[1::2]), *zip(two[::2], two[1::2])]):
        if merged and b <= merged[-1]:
            merged[-1] = max(merged[-1], e)
        else:
            merged += [b, e]
    return merged


def _name_order(name: str | None) -> tuple[bool, str]:
    """Names as strings, the missing one last."""
    return name is None, name or ""


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes``, one at a time, each small enough for every worker."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [(r.i, r.t.encode()) for r in items.where(block == k).collect()]


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` with a column of overlaps, and that column's name.

    The column holds ``n_words``, ``hits`` (merged word intervals, flat: start,
    end, ...), ``items`` (ids as strings, sorted) and ``matches`` (the longest
    verbatim match per item with its places). The benchmark passes by in blocks,
    of which the driver holds ``BLOCKS_HELD``; the texts are never shuffled.
    """
    name = fresh(docs, "overlap")
    out = docs
    for number, block in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        tests = TestSuffixes(block, window)
        if number and number % BLOCKS_HELD == 0:
            out = keep(out)

        def make(batch: pa.RecordBatch, tests=tests, later=number > 0) -> list:
            found = tests.search(utf8(batch, text))
            if later:
                earlier = batch.column(batch.schema.get_field_index(name)).to_pylist()
                for row, old in zip(found, earlier, strict=True):
                    row["hits"] = _union(old["hits"], row["hits"])
                    row["items"] = sorted({*old["items"], *row["items"]}, key=_name_order)
                    row["matches"] = sorted(old["matches"] + row["matches"], key=lambda m: _name_order(m["item_id"]))
            return [found]

        if number:
            passed = fresh(out, "overlap_next")
            columns = docs.columns
            out = add_columns(out, text, [T.StructField(passed, STATE)], make)
            out = out.select(*[F.col(f"`{c}`") for c in columns], F.col(passed).alias(name))
        else:
            out = add_columns(out, text, [T.StructField(name, STATE)], make)
    return out, name


def hit_words(overlap: str):
    """The number of words that windows cover."""
    hits = F.col(f"{overlap}.hits")
    return F.aggregate(
        F.sequence(F.lit(0), F.size(hits)),
        F.lit(0).cast("long"),
        lambda n, i: n + F.when(i >= F.size(hits), 0).when(i % 2 == 1, F.get(hits, i)).otherwise(-F.get(hits, i)),
    )


def is_contaminated(overlap: str):
    """The rule: some hit, and one word in ``SHARE`` or more."""
    n = hit_words(overlap)
    return (n > 0) & (n * SHARE >= F.col(f"{overlap}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones, its columns as they were."""
    found, name = find_overlaps(docs, benchmark, text, **options)
    return found.where(~is_contaminated(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        hit_words(name).alias("n_hit"),
        F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{name}.items", ","), 256).alias("items_sha256"),
        is_contaminated(name).alias("contaminated"),
    )


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p, w FROM items WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM windows
), lengths AS (
  SELECT DISTINCT n FROM wanted
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, places.n, p FROM places JOIN wanted USING (k) WHERE places.n = wanted.n
), hit AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
