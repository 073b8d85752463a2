"""A phrase dictionary of any size joined with texts: whole words, any case.

Each text names the token runs that could be phrases: runs of the token counts
that the dictionary has, whose first token and whole text pass membership filters
of fixed size. Only these reach the join, a row per article and distinct run, so
a phrase that most articles hold is one short row of each, and Spark splits it if
it is hot. The filters let some wrong runs pass, never stop a right one, and the
join compares the text itself: the result is exact for any dictionary. A dictionary
of up to ``BROADCAST_BYTES`` is broadcast for it, so that its rows stay where they are.

What is collected to the driver is bounded: two bitmaps of ``FILTER_BITS`` bits, and the
distinct token counts of the phrases. Workers hold one article's runs at a time and pass
rows on in batches of ``ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import matching
from newsloom.session import spread

#: Bits of each membership filter (2 MB).
FILTER_BITS = 1 << 24
_WORD_BITS = 63
#: Size of a dictionary, estimated by its texts, that is broadcast for the join.
BROADCAST_BYTES = 64 << 20
#: Rows that a worker collects before it passes them on.
ROWS = 4096
#: Tokens, and runs, whose filter answer a worker remembers.
_REMEMBERED = 100_000

_PARTS = T.StructType(
    [T.StructField("folded", T.StringType()), T.StructField("first", T.StringType()), T.StructField("tokens", T.IntegerType())]
)


@F.pandas_udf(_PARTS)
def _phrase_parts(phrases: pd.Series) -> pd.DataFrame:
    rows = []
    for phrase in phrases:
        folded = matching.fold(phrase)
        tokens = [m.group() for m in matching.TOKEN.finditer(folded)]
        rows.append((folded, tokens[0] if tokens else None, len(tokens)))
    return pd.DataFrame(rows, columns=["folded", "first", "tokens"])


def dictionary(phrases: DataFrame, phrase: str = "alias") -> DataFrame:
    """``phrases`` with ``folded``, ``first`` (token) and ``tokens`` of each; those without a token are left out."""
    usable = phrases.filter(F.trim(phrase) != "").withColumn("_parts", _phrase_parts(F.trim(phrase)))
    return usable.select("*", "_parts.*").drop("_parts").filter("tokens > 0")


class Filters:
    """Membership of first tokens and of whole phrases, and the token counts that occur."""

    def __init__(self, bits: np.ndarray, size: int, counts: list[int], volume: int = 0):
        self.bits, self.size, self.counts, self.volume = bits, size, counts, volume
        self.seen: tuple[dict[str, bool], dict[str, bool]] = ({}, {})

    @classmethod
    def of(cls, known: DataFrame) -> Filters:
        """The filters of a dictionary."""

        def entry(kind: int, column: str) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("text"))

        # The hash of the workers; that it has a sign here doesn't matter to a power of two.
        place = F.pmod(F.xxhash64("b.text"), F.lit(FILTER_BITS))
        size = weight("folded")
        placed = known.select(
            F.explode(F.array(entry(0, "first"), entry(1, "folded"))).alias("b"), "tokens", size.alias("weight")
        ).select("b.kind", place.alias("at"), "tokens", "weight")
        words = placed.groupBy("kind", F.expr(f"at DIV {_WORD_BITS}").alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, CAST(at % {_WORD_BITS} AS INT))")).alias("bits"),
            F.collect_set("tokens").alias("tokens"),
            F.sum("weight").alias("weight"),
        )
        held = np.zeros((2, FILTER_BITS // _WORD_BITS + 1), dtype=np.int64)
        counts: set[int] = set()
        volume = 0
        for row in words.collect():
            held[row["kind"], row["word"]] = row["bits"]
            counts.update(row["tokens"])
            volume += row["weight"] * row["kind"]
        return cls(held, FILTER_BITS, sorted(counts), volume)

    def has(self, kind: int, text: str) -> bool:
        place = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=42) % self.size
        return bool(int(self.bits[kind, place // _WORD_BITS]) >> (place % _WORD_BITS) & 1)

    def may(self, kind: int, text: str) -> bool:
        """:meth:`has`, remembered: whether some phrase may begin with the token ``text`` (0) or be it (1)."""
        seen = self.seen[kind]
        known = seen.get(text)
        if known is None:
            if len(seen) >= _REMEMBERED:
                seen.clear()
            known = seen[text] = self.has(kind, text)
        return known

    def runs(self, text: str) -> dict[str, list[int]]:
        """Starts of the token runs of ``text`` that may be phrases, by their folded text."""
        folded = matching.fold(text)
        tokens = [m.span() for m in matching.TOKEN.finditer(folded)]
        found: dict[str, list[int]] = {}
        many, opening = len(tokens), self.seen[0]
        before = -1
        for i, (start, stop) in enumerate(tokens):
            token = folded[start:stop]
            known = opening.get(token)
            # Between tokens that don't touch there is white space.
            touches, before = start == before, stop
            if not (self.may(0, token) if known is None else known) or (touches and matching.is_word(folded[start - 1])):
                continue
            for n in self.counts:
                if i + n > many:
                    break
                end = tokens[i + n - 1][1]
                if i + n < many and tokens[i + n][0] == end and matching.is_word(folded[end]):
                    continue
                run = folded[start:end]
                known = found.get(run)
                if known is not None:
                    known.append(start)
                elif self.may(1, run):
                    found[run] = [start]
        return found


def find(
    articles: DataFrame, known: DataFrame, *, text_column: str = "content", overlapping: bool = True, pieces: bool = False
) -> DataFrame:
    """(``id``, ``starts``, and all columns of ``known``) for each article and phrase in it.

    ``known`` comes from :func:`dictionary`. ``starts`` are the whole-word places, in order:
    all of them, or from left to right those that don't overlap. With ``pieces`` the text at
    each place comes along, as it is written there.
    """
    filters = Filters.of(known)
    shared = articles.sparkSession.sparkContext.broadcast((filters.bits, filters.size, filters.counts))
    fields = [
        T.StructField("id", articles.schema["id"].dataType),
        T.StructField("folded", T.StringType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        *([T.StructField("pieces", T.ArrayType(T.StringType()))] if pieces else []),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Filters(*shared.value)
        for batch in batches:
            out = pa.schema(
                [("id", batch.schema.field(0).type), ("folded", pa.string()), ("starts", pa.list_(pa.int32()))]
                + ([("pieces", pa.list_(pa.string()))] if pieces else [])
            )
            columns: list[list] = [[] for _ in out]
            for at in range(batch.num_rows):
                key, value = batch.column(0)[at].as_py(), batch.column(1)[at].as_py() or ""
                for folded, places in mine.runs(value).items():
                    size = len(folded)
                    kept = places if overlapping else _apart(places, size)
                    row = (key, folded, kept, [value[p : p + size] for p in kept] if pieces else None)
                    for column, cell in zip(columns, row, strict=False):
                        column.append(cell)
                if len(columns[0]) >= ROWS:
                    yield record_batch(out, columns)
                    columns = [[] for _ in out]
            yield record_batch(out, columns)

    held = F.broadcast(known) if filters.volume <= BROADCAST_BYTES else known
    return spread(articles.select("id", text_column)).mapInArrow(run, T.StructType(fields)).join(held, "folded")


def weight(*texts: Column | str) -> Column:
    """About the bytes of a row in a broadcast table: its texts, its other values and the row itself."""
    return 2 * sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)) + 100


def marked(
    articles: DataFrame, filters: Filters, *, text_column: str = "content", keep: tuple[str, ...] = (), overlapping: bool = True
) -> DataFrame:
    """The rows of ``articles`` (``id`` and ``keep``), each followed by the runs in its text that may be phrases.

    An article's own row has no ``starts``. A run's row has the article's ``id``, the run as a phrase (``folded``) and
    as it is written there (``form``), and its ``starts``, chosen as :func:`find` does. ``_article`` numbers both.
    """
    shared = articles.sparkSession.sparkContext.broadcast((filters.bits, filters.size, filters.counts))
    columns = list(dict.fromkeys(["id", *keep, text_column]))
    text = columns.index(text_column)
    schema = T.StructType(
        [
            *(T.StructField(c, articles.schema[c].dataType) for c in ("id", *keep)),
            T.StructField("_article", T.LongType()),
            T.StructField("folded", T.StringType()),
            T.StructField("form", T.StringType()),
            T.StructField("starts", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Filters(*shared.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = _Rows()
            for at in range(batch.num_rows):
                value = batch.column(text)[at].as_py() or ""
                # No phrase begins with a blank: the article's own row meets none, and lies anywhere in a shuffle.
                rows.add(at, f" {number + at}", None, None)
                for folded, places in mine.runs(value).items():
                    size = len(folded)
                    forms: dict[str, list[int]] = {}
                    for p in places if overlapping else _apart(places, size):
                        forms.setdefault(value[p : p + size], []).append(p)
                    for form, starts in forms.items():
                        rows.add(at, folded, form, starts)
                if len(rows.at) >= ROWS or at == batch.num_rows - 1:
                    yield rows.batch(batch, 1 + len(keep), number)
                    rows = _Rows()
            number += batch.num_rows

    return articles.select(columns).mapInArrow(run, schema)


class _Rows:
    """Rows of :func:`marked` by column."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.folded: list[str] = []
        self.forms: list[str | None] = []
        self.starts: list[int] = []
        self.ends: list[int] = [0]

    def add(self, at: int, folded: str, form: str | None, starts: list[int] | None) -> None:
        self.at.append(at)
        self.folded.append(folded)
        self.forms.append(form)
        if starts:
            self.starts += starts
        self.ends.append(len(self.starts))

    def batch(self, source: pa.RecordBatch, kept: int, number: int) -> pa.RecordBatch:
        """With the first column of ``source``, and in the articles' own rows with the others that are ``kept``."""
        at = np.array(self.at, dtype=np.int64)
        forms = pa.array(self.forms, pa.string())
        own = forms.is_null().to_numpy(zero_copy_only=False)
        of, ends = pa.array(at), pa.array(self.ends, pa.int32())
        others = pa.array(at, mask=~own)
        columns = {source.schema.names[i]: source.column(i).take(others if i else of) for i in range(kept)}
        columns |= {"_article": pa.array(at + number), "folded": pa.array(self.folded, pa.string()), "form": forms}
        columns["starts"] = pa.ListArray.from_arrays(ends, pa.array(self.starts, pa.int32()), mask=pa.array(own))
        return pa.RecordBatch.from_pydict(columns)


def met(rows: DataFrame, known: DataFrame, filters: Filters) -> DataFrame:
    """The rows of :func:`marked` in their order, with the columns of ``known``; runs that are no phrase are left out."""
    held = filters.volume <= BROADCAST_BYTES
    phrase = known.withColumn("_known", F.lit(True))
    joined = rows.join(F.broadcast(phrase) if held else phrase, "folded", "left")
    return in_order(joined.filter(F.col("starts").isNull() | F.col("_known")).drop("_known"), held)


def in_order(rows: DataFrame, kept: bool) -> DataFrame:
    """Rows of :func:`marked` in their order, which broadcast joins have ``kept``."""
    if kept:
        return rows
    return rows.repartition("id").sortWithinPartitions("id", "_article", F.col("starts").isNotNull())


def whole(batches: Iterator[pa.RecordBatch], *, by_id: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of :func:`marked` as batches of whole groups, with the places of the articles' own rows and of the groups' first.

    A group is an article, or with ``by_id`` the articles in a row that share their id.
    """
    open_: pa.RecordBatch | None = None  # the group that the next batch may go on with
    for batch in batches:
        rows = batch if open_ is None else pa.concat_batches([open_, batch])
        if not rows.num_rows:
            continue
        heads, begins = _bounds(rows, by_id)
        last = begins[-1]
        if last:
            yield rows.slice(0, last), heads[heads < last], begins[:-1]
        open_ = rows.slice(last)
    if open_ is not None:
        yield open_, *_bounds(open_, by_id)


def _bounds(rows: pa.RecordBatch, by_id: bool) -> tuple[np.ndarray, np.ndarray]:
    own = rows.column("starts").is_null().to_numpy(zero_copy_only=False)
    heads, numbers = np.flatnonzero(own), rows.column("_article").to_numpy()
    # Each row must lie behind its article's own.
    if not own[0] or (numbers[heads][np.cumsum(own) - 1] != numbers).any():
        raise ValueError("the rows of an article are not in order")
    if not by_id:
        return heads, heads
    ids = rows.column("id").take(pa.array(heads)).to_pylist()
    return heads, heads[[i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))]]


def _apart(places: list[int], size: int) -> list[int]:
    """From left to right the places whose runs of ``size`` don't overlap."""
    kept: list[int] = []
    for place in places:
        if not kept or place >= kept[-1] + size:
            kept.append(place)
    return kept


def record_batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def apart(starts: list[int], less: list[int]) -> Iterator[tuple[int, int, int]]:
    """Of places in order those that begin behind the last taken one: (number, start, end)."""
    done = 0
    for number, (start, shorter) in enumerate(zip(starts, less, strict=True)):
        if start >= done:
            done = start - shorter
            yield number, start, done
