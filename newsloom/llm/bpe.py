"""Byte-level BPE by backtracking over longest token matches, and decoding by an offset table.

A sequence of tokens is what the merges give exactly when every two neighbours
are compatible: undoing the merges of both, latest first, never meets a merge
across their border that would have come earlier. The encoder takes the longest
token at a place (one Aho-Corasick pass finds them all), checks it against its
left neighbour, and falls back to the next shorter token or one token back. Ends
that proved dead are remembered, so each place is left once: linear time.

Decoding joins slices of one byte table at the tokens' offsets.

Cases: null counts as empty and gives no tokens; special tokens inside a text
become their ids, as the tokenizer file says; texts of any length are encoded
whole; other columns stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, fresh, table

#: The vocabulary that the registered query uses, by its public name.
VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's caches; what a full cache holds is kept while the next one fills.
CACHE = 200_000
#: Tokens whose bytes are gathered at a time.
GATHER = 1 << 20

#: How byte-level BPE cuts a text before merging (fixed by the tokenizer file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary lies on this machine."""
    import sys

    if "/opt" not in sys.path:
        sys.path.append("/opt")
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {raw(token): i for token, i in made["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.pieces = [b""] * self.size
        for piece, i in ids.items():
            self.pieces[i] = piece
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self._merges(made["model"]["merges"], ids, raw)
        self._matches(ids)
        self.table = OffsetTable(self.pieces)
        self.decimals = OffsetTable([f"{i},".encode() for i in range(self.size)])
        self.cut = regex.compile(PATTERN)
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bad = re.compile(r"(?:^|[\s])[ \n]|[ \n](?:\s|$)")
        self.words: dict[str, bytes]
        self.older: dict[str, bytes]
        self.checked: dict[int, bool]
        self.forget()

    def forget(self) -> None:
        """Empty the caches, which would else stay in the worker after its task. The tables stay."""
        self.words, self.older, self.checked = {}, {}, {}

    def _merges(self, merges: list, ids: dict[bytes, int], raw) -> None:
        """Ranks by pair, and for each token its two parts and the rank that made it."""
        self.rank: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.born = [-1] * self.size
        for rank, merge in enumerate(merges):
            one, two = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            a, b, whole = ids[one], ids[two], ids[one + two]
            self.rank.setdefault((a, b), rank)
            if self.born[whole] < 0:
                self.left[whole], self.right[whole], self.born[whole] = a, b, rank

    def _matches(self, ids: dict[bytes, int]) -> None:
        """The automaton of all tokens that merges can make, and each one's longest proper prefix token."""
        usable = {p: i for p, i in ids.items() if len(p) == 1 or self.born[i] >= 0}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * self.size
        for piece, i in usable.items():
            self.automaton.add_word(piece.decode("latin-1"), i)
            for end in range(len(piece) - 1, 0, -1):
                if (known := usable.get(piece[:end])) is not None:
                    self.shorter[i] = known
                    break
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between ``a`` and ``b``."""
        key = a * self.size + b
        if (known := self.checked.get(key)) is not None:
            return known
        if len(self.checked) >= CACHE:
            self.checked.clear()
        self.checked[key] = known = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        before = len(self.rank)
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < before:
                return False
            last_a, last_b = self.born[a], self.born[b]
            if last_a < 0 and last_b < 0:
                return True
            if last_a > last_b:
                before, a = last_a, self.right[a]
            else:  # among equal ranks the leftmost pair merges first
                before, b = last_b + 1, self.left[b]

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece between cuts.

        The longest matches from left to right are the answer where all
        neighbours agree, which is the common case; else it goes step by step.
        """
        letters = piece.decode("latin-1")
        greedy = [token for _, token in self.automaton.iter_long(letters)]
        known, size, last = self.checked, self.size, -1
        for number, token in enumerate(greedy):
            if last >= 0:
                fits = known.get(last * size + token)
                if fits is None:
                    fits = self.compatible(last, token)
                if not fits:
                    return self._backtrack(letters, greedy[:number], token)
            last = token
        return greedy

    def _backtrack(self, letters: str, out: list[int], token: int) -> list[int]:
        """Go on after ``out``, where ``token`` is the longest match but doesn't fit."""
        size, length, shorter, known, all_ = len(letters), self.length, self.shorter, self.checked, self.size
        longest = [-1] * size
        for end, match in self.automaton.iter(letters):  # of one start, longer ones come later
            longest[end + 1 - length[match]] = match
        dead = bytearray(size + 1)
        place = sum([length[x] for x in out])
        while True:
            end = place + length[token]
            if not dead[end]:
                fits = not out or known.get(out[-1] * all_ + token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    place = end
                    if place == size:
                        return out
                    token = longest[place]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[place] = 1
                token = out.pop()
                place -= length[token]

    def _word(self, word: str) -> bytes:
        """The packed ids of a text without special tokens, cached if it is short."""
        known = self.words.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                body = word[1:] if word[:1] == " " else word
                if body.isalpha():
                    cut = [word]
                elif body[:-1].isalpha() and body[-1] in ".,":
                    cut = [word[:-1], word[-1]]
                else:
                    cut = self.cut.findall(word)
                if len(cut) == 1:
                    known = array("i", self.merge(word.encode())).tobytes()
                else:
                    known = b"".join([self.words.get(piece) or self._word(piece) for piece in cut])
            if len(word) < 64:
                if len(self.words) >= CACHE:
                    self.older, self.words = self.words, {}
                self.words[word] = known
        return known

    def _plain(self, text: str) -> list[bytes]:
        """Packed ids of a text without special tokens, in parts.

        A cut always lies before a single blank or around a single line break
        between other letters, so such texts go word by word through the cache.
        """
        if self.bad.search(text):
            return [self._word(text)] if len(text) < 4096 else [self._word(p) for p in re.split(r"(?<=\S)(?= \S)", text)]
        new, out = self._word, []
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(new("\n"))
            first, *rest = line.split(" ")
            out.append(new(first))
            get = self.words.get
            for word in rest:
                word = " " + word
                out.append(get(word) or new(word))
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        out: list[bytes] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            elif part:
                out += self._plain(part)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        return b"".join(self.table.gather(ids)).decode("utf-8", "replace")

    def decimal_parts(self, ids: np.ndarray):
        """The ids in decimal, joined by commas, in parts."""
        parts = list(self.decimals.gather(ids))
        if parts:
            parts[-1] = parts[-1][:-1]
        return parts


class OffsetTable:
    """Byte strings by number, laid end to end."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def gather(self, ids: np.ndarray):
        """The bytes of ``ids`` end to end, in parts of bounded size."""
        for begin in range(0, len(ids), GATHER):
            some = ids[begin : begin + GATHER]
            length = self.length[some]
            ends = np.cumsum(length)
            at = np.repeat(self.offset[some] - ends + length, length)
            at += np.arange(len(at))
            yield self.bytes[at].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, once per worker."""
    return ByteBPE(path)


def _forget(path: str) -> None:
    """A task's end: its words leave the worker, the tables stay."""
    if load.cache_info().currsize:  # a task without rows loads nothing
        load(path).forget()


def _texts(batch: pa.RecordBatch, text: str):
    for value in batch.column(batch.schema.get_field_index(text)):
        yield value.as_py() or ""


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each text."""

    def make(batch: pa.RecordBatch) -> list:
        bpe = load(path)
        return [[bpe.encode(t) for t in _texts(batch, text)]]

    return add_columns(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, done=lambda: _forget(path))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids; null ids give an empty text."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [bpe.decode(np.array(v.as_py() or [], dtype=np.int32)) for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with token count, hash of the ids and hash of the decoded text, and those columns' names.

    Encodes and decodes in one pass. With ``keep_ids`` the ids come as well.
    """
    names = [fresh(docs, n) for n in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")[: 3 + keep_ids]]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]

    def make(batch: pa.RecordBatch) -> list:
        bpe = load(path)
        columns: list[list] = [[], [], [], []]
        for value in _texts(batch, text):
            ids = bpe.encode(value)
            numbers = hashlib.sha256()
            for part in bpe.decimal_parts(ids):
                numbers.update(part)
            columns[0].append(len(ids))
            columns[1].append(numbers.hexdigest())
            columns[2].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            if keep_ids:
                columns[3].append(ids)
        return columns[: 3 + keep_ids]

    fields = [T.StructField(n, k) for n, k in zip(names, kinds)]
    return add_columns(docs, text, fields, make, done=lambda: _forget(path)), names


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and their way back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made, names = digests(docs, vocabulary_path())
    return made.select("doc_id", *names)
