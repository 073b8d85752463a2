"""Ranked lexical search in reverse: the queries are indexed, the documents stream past.

An inverted index over the terms of a block of items goes to every task. Each
task counts the index's terms in its documents, looks their postings up, adds up
integer scores in a (documents x items) matrix of bounded size and keeps the best
``k`` documents of each item in a heap. The heaps of all tasks are merged in two
steps, so that no task gets the heaps of all others. A first pass of the same
shape counts documents, terms and document frequencies.

The benchmark may be of any size: its distinct rows are cut by hash into blocks
of about ``block_bytes`` (and one text at most beyond that), the driver holds one
block at a time, and each block's ranking is written before the next one starts.

Cases: a null text, or one without terms, holds no term and isn't counted; an
item without terms gets no rows; repeated item rows count once, rows of one id
with different texts are ranked apart, null ids too; repeated document rows are
ranked each for itself; equal scores go by ascending doc_id, nulls last; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.llm.common import keep, slices, table, utf8
from newsloom.llm.decontamination import words_of

#: Documents returned per item.
BEST = 20
#: Bytes of item text that go to the workers at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of document text that are scored at a time.
TEXT_BYTES = 4 << 20
#: Cells and postings of a score matrix, unless one document alone needs more.
CELLS = 1 << 20
#: Groups of tasks whose heaps are merged before all are.
MERGES = 64

#: Rows of the first pass that count documents and terms instead of one term's documents.
DOCUMENTS, TERMS = -1, -2

COUNTS = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())])
HEAPS = T.StructType(
    [
        T.StructField("number", T.IntegerType()),
        T.StructField("item", T.StringType()),
        T.StructField("doc", T.LongType()),
        T.StructField("score", T.LongType()),
        T.StructField("task", T.IntegerType()),
    ]
)


class ItemIndex:
    """Postings (item, occurrences) by term, for a block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        counted = [(name, Counter(words_of(text))) for name, text in items]
        counted = [(name, terms) for name, terms in counted if terms]
        self.names = [name for name, _ in counted]
        self.terms = {term: i for i, term in enumerate(sorted({t for _, terms in counted for t in terms}))}
        postings = np.array(
            [(self.terms[t], item, n) for item, (_, terms) in enumerate(counted) for t, n in terms.items()],
            dtype=np.int64,
        ).reshape(-1, 3)
        postings = postings[np.argsort(postings[:, 0], kind="stable")]
        self.size = np.bincount(postings[:, 0], minlength=len(self.terms))
        self.first = np.cumsum(self.size) - self.size
        self.item, self.times = postings[:, 1].copy(), postings[:, 2].copy()

    def term_counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All terms per text; then text, term and occurrences of each indexed term that a text holds, by text."""
        get, coded, lengths = self.terms.get, [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            coded.append(np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words)))
        lengths = np.array(lengths, dtype=np.int64)
        terms = np.concatenate(coded) if coded else np.empty(0, dtype=np.int64)
        known = terms >= 0
        width = max(1, len(self.terms))
        cells, times = np.unique(np.repeat(np.arange(len(texts)), lengths)[known] * width + terms[known], return_counts=True)
        return lengths, cells // width, cells % width, times


class Heaps:
    """The best documents of each item so far, sorted by item, score and document."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.floor = np.ones(items, dtype=np.int64)
        self.item = self.doc = self.score = np.empty(0, dtype=np.int64)
        self.null = np.empty(0, dtype=bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """Take in a matrix of scores, a row per document."""
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[row, item[len(self.item) :]]))
        doc, gone = np.concatenate((self.doc, docs[row])), np.concatenate((self.null, null[row]))
        order = np.lexsort((doc, gone, -score, item))
        item = item[order]
        count = np.bincount(item, minlength=len(self.floor))
        rank = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        held = rank < self.best
        self.item, order = item[held], order[held]
        self.doc, self.null, self.score = doc[order], gone[order], score[order]
        full = rank[held] == self.best - 1
        self.floor[self.item[full]] = self.score[full]


class Scorer:
    """Scores of documents for the items of one block."""

    def __init__(self, index: ItemIndex, counts: dict[int, int]):
        self.index = index
        self.documents, self.all_terms = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * self.documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(index.terms))],
            dtype=np.int64,
        )

    def add(self, heaps: Heaps, texts: list[bytes], docs: np.ndarray, null: np.ndarray) -> None:
        """Score texts and put the best into the heaps."""
        index, items = self.index, len(self.index.names)
        lengths, text, term, times = index.term_counts(texts)
        if not len(text) or not self.all_terms:
            return
        norm = 75 + 25 * lengths * self.documents // self.all_terms
        part = self.weight[term] * (1_000_000_000 * times // (1000 * times + 12 * norm[text]))
        size = index.size[term]
        work = np.maximum(np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64), items)
        before, begin = np.cumsum(work) - work, 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(before + work, before[begin] + CELLS, side="right")))
            low, high = np.searchsorted(text, (begin, end))
            n = size[low:high]
            posting = np.repeat(index.first[term[low:high]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            scores = np.zeros((end - begin) * items, dtype=np.int64)
            cell = np.repeat((text[low:high] - begin) * items, n) + index.item[posting]
            np.add.at(scores, cell, np.repeat(part[low:high], n) * index.times[posting])
            heaps.add(scores.reshape(-1, items), docs[begin:end], null[begin:end])
            begin = end


def _count(docs: DataFrame, index: ItemIndex) -> dict[int, int]:
    """Documents, terms, and documents per indexed term, over all of ``docs`` (columns d, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        holding = np.zeros(len(index.terms), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES):
                lengths, _, term, _ = index.term_counts(utf8(part, "t"))
                documents += int(np.count_nonzero(lengths))
                terms += int(lengths.sum())
                holding += np.bincount(term, minlength=len(holding))
        numbers = np.flatnonzero(holding)
        keys = np.concatenate((numbers, (DOCUMENTS, TERMS))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.append(holding[numbers], (documents, terms)))], names=["term", "n"])

    summed = docs.mapInArrow(run, COUNTS).groupBy("term").agg(F.sum("n").alias("n"))
    return {row.term: row.n for row in summed.collect()}


def _heaps(docs: DataFrame, scorer: Scorer, best: int) -> DataFrame:
    """Each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = scorer.index.names
        heaps = Heaps(len(names), best)
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES):
                ids = part.column(part.schema.get_field_index("d"))
                scorer.add(heaps, utf8(part, "t"), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        task = np.full(len(heaps.item), TaskContext.get().partitionId(), dtype=np.int32)
        columns = [
            pa.array(heaps.item.astype(np.int32)),
            pa.array([names[i] for i in heaps.item.tolist()], pa.string()),
            pa.array(heaps.doc, mask=heaps.null),
            pa.array(heaps.score),
            pa.array(task),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=HEAPS.fieldNames())

    return docs.mapInArrow(run, HEAPS)


def _merge(heaps: DataFrame, best: int) -> DataFrame:
    """The best rows of each item, ranked: first within groups of tasks, then over all."""
    order = F.col("score").desc(), F.col("doc").asc_nulls_last()
    some = Window.partitionBy("number", F.col("task") % MERGES).orderBy(*order)
    merged = heaps.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= best)
    every = Window.partitionBy("number").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= best)


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The distinct items, a block at a time."""
    rows = items.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for k in range(n):
        found = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).select("i", F.col("t").cast("binary").alias("t"))
        yield [(r.i, bytes(r.t)) for r in sorted(found.collect(), key=lambda r: (r.i is not None, r.i or "", r.t))]


def search(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each item its ``best`` documents: item_id, rank (from 1), doc_id, score.

    ``doc`` must be an integer column. Each block of items takes two passes over
    the texts, which are never shuffled.
    """
    kind = items.schema[item].dataType
    stream = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t"))
    ranked = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind)] + [T.StructField(n, k) for n, k in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))]))
    for block in _blocks(items, item, item_text, block_bytes):
        index = ItemIndex(block)
        if not index.names:
            continue
        scorer = Scorer(index, _count(stream, index))
        found = _merge(_heaps(stream, scorer, best), best)
        ranked = ranked.unionAll(keep(found.select(F.col("item").cast(kind).alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")))
    return ranked


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (
  SELECT doc_id, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term
), items AS (
  SELECT DISTINCT item_id, text FROM benchmark
), wanted AS (
  SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM items
), parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))) AS part
  FROM counts JOIN weights USING (term) JOIN sizes USING (doc_id), totals
), scores AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
