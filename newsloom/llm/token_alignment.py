"""Alignment of two tokenizers' tokens by diagonal run skipping.

Each text is encoded twice; the byte ends of both token sequences are two rising
arrays. As long as the ends agree at the current shift between the two indices,
tokens stand one to one: the length of such a stretch is found by exponential
probing, comparing ever longer slices, then halving back. At a difference the
group is resolved locally, the side that lags goes on until the ends meet again,
and the shift is updated. Every step of that walk is one overlapping pair.

The corpus-wide counts of id pairs come from chunks: a chunk of documents lists
its distinct pairs with their links once, its documents refer to that list. The
lists are summed by pair, joined back by pair (Spark splits a pair that many
chunks have), and meet their documents again by chunk. So neither a text nor a
document's pairs are sent by pair, and no table of all pairs is broadcast.

Cases: a null or empty text, and one whose joined bytes differ from a space and
the text on either side (the second vocabulary writes U+2581 as a space), has no
tokens, zeros and an empty digest; repeated rows are judged and counted each for
itself, null ids too; texts of any length are encoded whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bpe import PATTERN, OffsetTable, byte_letters, vocabulary_path
from newsloom.llm.common import add_columns, fresh, keep, slices, table, utf8

#: The vocabularies of the registered query, by their public names.
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a chunk, unless one text alone is longer.
CHUNK_BYTES = 4 << 20
#: Characters of a text that are encoded at a time where it can be cut.
LONG_TEXT = 1 << 20
#: Characters of white space that are a piece of their own without a look at the pattern.
LONG_BLANK = 10_000

CHUNKS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("links", T.ArrayType(T.LongType())),
    ]
)
#: Columns of a document's row; a chunk's row has ``keys`` and ``links`` instead.
DOCUMENT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


class SpacedBytes:
    """The byte-level vocabulary: a text behind one space, special tokens as plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merged = [ids[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must rise in the order of the merges")
        pieces = [b""] * (1 + max(ids.values()))
        for piece, i in ids.items():
            pieces[i] = piece
        known = {*merged}
        ranks = {piece: i for piece, i in ids.items() if len(piece) == 1 or i in known}
        self.model = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = OffsetTable(pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._ids(" " + t), dtype=np.int32) for t in texts]

    def _ids(self, text: str) -> list[int]:
        """The ids of a text; long white space, on which the library's matcher would run out of stack, goes as one piece."""
        if len(text) < LONG_BLANK:
            return self.model.encode_ordinary(text)
        out, at = [], 0
        for run in regex.finditer(rf"\s{{{LONG_BLANK},}}", text):
            end = run.end() - (run.end() < len(text))  # the last one may belong to the next word
            out += self.model.encode_ordinary(text[at : run.start()])
            out += self.model._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.model.encode_ordinary(text[at:])


class SentencePieces:
    """The piece vocabulary, which sets a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = OffsetTable(pieces)
        #: Whether a text can be cut before a space behind another character: no piece goes across.
        self.parts = not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(len(pieces)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT or not self.parts]
        found = dict(zip(whole, self.model.encode([texts[i] for i in whole], num_threads=1), strict=True))
        for i, text in enumerate(texts):
            if i not in found:  # the model sets the space that was cut before each part
                found[i] = [x for part in _cut(text, LONG_TEXT) for x in self.model.encode(part, num_threads=1)]
        return [np.array(found[i], dtype=np.int32) for i in range(len(texts))]


def _cut(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut at single spaces between other characters, which are left out."""
    cut, begin = re.compile(r"(?<=\S) (?=\S)"), 0
    while len(text) - begin > size and (found := cut.search(text, begin + size)):
        yield text[begin : found.start()]
        begin = found.end()
    yield text[begin:]


@functools.lru_cache(maxsize=2)
def load_pair(first: str, second: str) -> tuple[SpacedBytes, SentencePieces]:
    """Both vocabularies, once per worker."""
    return SpacedBytes(first), SentencePieces(second)


def diagonal_groups(a: list[int], b: list[int]) -> tuple[list, list, list, list]:
    """Walk two rising lists of byte ends with the same last end.

    Returns one-to-one stretches (first index, shift, length); the index pairs of
    overlapping tokens in all other groups, as two lists; and those groups' last
    index pairs.
    """
    runs, left, right, lasts = [], [], [], []
    i, n, shift = 0, len(a), 0
    while i < n:
        begin = i
        if a[i] == b[i + shift]:
            i, step = i + 1, 1
            while i < n and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step *= 2
            i = min(i, n)
            while step > 1 and i < n:  # what the last probe holds before its first difference
                step >>= 1
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i = min(i + step, n)
            runs.append((begin, shift, i - begin))
            if i == n:
                break
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            left.append(i)
            right.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        left.append(i)
        right.append(j)
        lasts.append((i, j))
        i += 1
        shift = j + 1 - i
    return runs, left, right, lasts


class Aligned:
    """The groups and overlapping pairs of one text's tokens."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        runs, left, right, lasts = diagonal_groups(a_ends.tolist(), b_ends.tolist())
        begin, shift, size = np.array(runs, dtype=np.int64).reshape(-1, 3).T
        one = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        two = one + np.repeat(shift, size)
        end_a, end_b = np.array(lasts, dtype=np.int64).reshape(-1, 2).T
        #: Overlapping pairs of token indices, and the last token of each group.
        self.left, self.right = np.append(one, np.array(left, dtype=np.int64)), np.append(two, np.array(right, dtype=np.int64))
        self.last_a, self.last_b = np.sort(np.append(one, end_a)), np.sort(np.append(two, end_b))
        self.a, self.b = a, b

    def digest(self, decimals: OffsetTable, size_a: int, size_b: int) -> str:
        """The groups in decimal, hashed: ``a1,a2|b1;a3|b2``."""
        n_a, n_b = len(self.a), len(self.b)
        groups = np.arange(len(self.last_a))
        of_a = np.repeat(groups, np.diff(self.last_a, prepend=-1))
        of_b = np.repeat(groups, np.diff(self.last_b, prepend=-1))
        first_b = np.append(0, self.last_b[:-1] + 1)
        line = np.empty(n_a + n_b, dtype=np.int64)
        entry_a, entry_b = self.a.astype(np.int64), self.b + np.int64(2 * size_a)
        entry_a[self.last_a] += size_a
        entry_b[self.last_b] += size_b
        line[np.arange(n_a) + first_b[of_a]] = entry_a
        line[np.arange(n_b) + self.last_a[of_b] + 1] = entry_b
        found = hashlib.sha256()
        parts = list(decimals.gather(line))
        for number, part in enumerate(parts, 1):
            found.update(part[:-1] if number == len(parts) else part)
        return found.hexdigest()


@functools.lru_cache(maxsize=2)
def _decimals(size_a: int, size_b: int) -> OffsetTable:
    """Decimal ids with what follows them: a ``,`` or a ``|``, b ``,`` or ``;``."""
    return OffsetTable([f"{i}{after}".encode() for size, marks in ((size_a, ",|"), (size_b, ",;")) for after in marks for i in range(size)])


def _joins(vocabulary, ids: np.ndarray, whole: bytes) -> bool:
    """Whether the tokens' bytes, end to end, are ``whole``."""
    return int(vocabulary.bytes.length[ids].sum()) == len(whole) and b"".join(vocabulary.bytes.gather(ids)) == whole


def align_texts(texts: list[bytes], first: str, second: str) -> list[Aligned | None]:
    """Each text's alignment, or None where a side's tokens don't give its bytes."""
    a_side, b_side = load_pair(first, second)
    read = [t.decode("utf-8", "replace") for t in texts]
    out: list[Aligned | None] = []
    for raw, a, b in zip(texts, a_side.encode(read), b_side.encode(read), strict=True):
        whole = b" " + raw
        if raw and _joins(a_side, a, whole) and _joins(b_side, b, whole):
            out.append(Aligned(a, b, np.cumsum(a_side.bytes.length[a]), np.cumsum(b_side.bytes.length[b])))
        else:
            out.append(None)
    return out


def chunk_rows(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of documents (columns d, t) and of chunks, as ``CHUNKS`` says.

    A document's ``pairs`` are places in its chunk's ``keys``, with the document's
    links in ``times``; a chunk's ``links`` are those of all its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, number = to_arrow_schema(CHUNKS), TaskContext.get().partitionId() << 33
        sides = load_pair(first, second)
        size_a, size_b = (len(s.bytes.length) for s in sides)
        decimals = _decimals(size_a, size_b)
        for batch in batches:
            for part in slices(batch, "t", CHUNK_BYTES):
                found = align_texts(utf8(part, "t"), first, second)
                columns: dict[str, list] = {n: [] for n in CHUNKS.fieldNames()}
                keys, sizes = [], []
                for doc, x in zip(part.column(part.schema.get_field_index("d")).to_pylist(), found, strict=True):
                    values = (0, 0, 0, 0, "")
                    if x is not None:
                        keys.append(x.a[x.left].astype(np.int64) * size_b + x.b[x.right])
                        values = len(x.a), len(x.b), len(x.last_a), len(x.left), x.digest(decimals, size_a, size_b)
                    sizes.append(values[3])
                    for n, v in zip(("chunk", *DOCUMENT), (number, doc, *values), strict=True):
                        columns[n].append(v)
                linked = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
                known, place = np.unique(linked, return_inverse=True)
                # Pairs of one document, with how often each occurs.
                width = max(1, len(known))
                cells, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + place, return_counts=True)
                cuts = np.searchsorted(cells // width, np.arange(len(sizes) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (cells % width, times)]
                rows = [
                    lists[("pairs", "times").index(n)] if n in ("pairs", "times") else pa.array(v or [None] * len(sizes), type=kinds.field(n).type)
                    for n, v in columns.items()
                ]
                yield pa.RecordBatch.from_arrays(rows, names=CHUNKS.fieldNames())
                if len(known):
                    links = np.bincount(place, minlength=width)
                    head = {"chunk": [number], "keys": [known], "links": [links]}
                    yield pa.RecordBatch.from_arrays([pa.array(head.get(n, [None]), type=kinds.field(n).type) for n in columns], names=CHUNKS.fieldNames())
                number += 1

    return docs.mapInArrow(run, CHUNKS)


def pair_counts(rows: DataFrame, second_size: int) -> DataFrame:
    """Links of every id pair over all chunks: key, b, total, and whether no pair of its b has more."""
    pairs = rows.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "links")).alias("p"))
    totals = pairs.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.links").alias("total"))
    totals = totals.withColumn("b", F.col("key") % second_size)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("key", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def _sums(documents: pa.Table, counted: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links."""
    place = counted.column("place").to_numpy()
    total = np.zeros(len(place) + 1, dtype=np.int64)
    best = np.zeros(len(place) + 1, dtype=np.int64)
    total[place] = counted.column("total").to_numpy()
    best[place] = counted.column("best").to_numpy()
    pairs, times = (documents.column(n).combine_chunks() for n in ("pairs", "times"))
    place, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(pairs.value_lengths().to_numpy())
    added = [np.append(0, np.cumsum(times * worth[place])) for worth in (best, total)]
    sums = [pa.array(np.diff(x[np.append(0, ends)])) for x in added]
    return pa.table([documents.column(n) for n in DOCUMENT] + sums, names=[*DOCUMENT, "n_best", "count_sum"])


def align(docs: DataFrame, first: str, second: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row the figures of its alignment, with corpus-wide counts of its id pairs.

    ``doc`` must be an integer column. Columns: doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256.
    """
    rows = keep(chunk_rows(docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")), first, second))
    size = len(load_pair(first, second)[1].bytes.length)
    listed = rows.where("keys IS NOT NULL").select("chunk", F.posexplode("keys").alias("place", "key"))
    counted = listed.join(pair_counts(rows, size), "key").select(F.col("chunk").alias("of"), "place", "total", "best")
    documents = rows.where("keys IS NULL").select("chunk", *DOCUMENT, "pairs", "times")
    schema = T.StructType([*[CHUNKS[n] for n in DOCUMENT], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return documents.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(_sums, schema)


def align_groups(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """``docs`` with the groups of each text: a list of the two sides' ids; empty without tokens."""
    ids = T.ArrayType(T.IntegerType())
    kind = T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)]))

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for x in align_texts(utf8(batch, text), first, second):
            groups = []
            if x is not None:
                cut_a, cut_b = np.split(x.a, x.last_a[:-1] + 1), np.split(x.b, x.last_b[:-1] + 1)
                groups = [{"a": p.tolist(), "b": q.tolist()} for p, q in zip(cut_a, cut_b, strict=True)]
            out.append(groups)
        return [out]

    return add_columns(docs, text, [T.StructField(fresh(docs, "groups"), kind)], make)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens in the two public vocabularies."""
    return align(table(spark, sf_dir, "documents"), vocabulary_path(FIRST), vocabulary_path(SECOND))
