"""Quality classifier: a label model over weak labelers, and a hashed linear scorer trained on its posteriors.

Each labeler looks at a whole text and votes bad where it sees junk of its kind.
Several labelers overlap on each kind of junk. The counts of
vote patterns, taken over all documents, go through expectation-maximisation,
which estimates how often each labeler says what about good and bad texts. The
posteriors of a bounded sample (``SAMPLE`` rows per class, the smallest by a hash)
train a logistic scorer over hashed byte trigrams and hashed votes; the scorer
decides. No given label is used.

Cases: null counts as empty; a text without words is bad; ties of the score
count as good; repeated rows are judged each for itself; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, fresh, keep, table, utf8

#: Documents per class that train the scorer.
SAMPLE = 1000
#: Buckets of the hashed features, as a power of two.
HASH_BITS = 12
#: How much a hashed vote weighs beside the trigrams of a text, which weigh ``TRIGRAMS`` together.
VOTE, TRIGRAMS = 0.25, 32.0
#: Bytes of a text whose trigrams are hashed at a time.
STEP = 1 << 20

# Frequent words of the languages that the corpus is written in.
FREQUENT_WORDS = frozenset(
    "the of and to in is that for it as was with be by on at this are or from an not"
    " der die das und in zu den von ist mit sich auf nicht ein eine im dem des als auch"
    " le la les de des et un une en est que qui dans pour pas sur du au avec par"
    " el los las y que en un una es por con para se del al lo su no".split()
)
_FREQUENT = frozenset(w.encode() for w in FREQUENT_WORDS)

_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in " \n\t\r.,;:!?'\"()-/+@=_")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
#: Signs that junk repeats at the end of words.
_RUNS = (b"***", b"###", b"$$$", b"%%%", b"&&&", b"~~~", b"^^^")

LABELERS = (
    "symbols", "symbol runs", "capitals", "shouting", "bars", "lone signs", "equal lines", "equal words", "repeats", "no stops", "length", "no common words",
)


def votes(text: bytes) -> str:
    """The labelers' votes on a UTF-8 text: ``-`` where a labeler sees junk of its kind, else ``0``."""
    words = text.split()
    n = len(words)
    if not n:
        return "-" * len(LABELERS)
    size = len(text)
    letters = max(1, len(text.translate(None, _NOT_LETTER)))
    lines = text.split(b"\n")
    bars = text.count(b"|")
    seen = (
        len(text.translate(None, _PLAIN)) > 0.03 * size,
        sum(map(text.count, _RUNS)) > 0.08 * n,
        len(text.translate(None, _NOT_UPPER)) > 0.15 * letters and n > 3,
        text.count(b"!") > 0.08 * n,
        bars > 0.04 * n,
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) > 0.04 * n,
        len(lines) > 3 and len(set(lines)) < 0.7 * len(lines),
        n > 15 and len(set(words)) < 0.4 * n,
        n > 4 and sum(map(bytes.__eq__, words, words[1:])) > 0.2 * n,
        n > 40 and not any(map(text.count, (b".", b"?", b"!"))),
        n < 4,
        n >= 20 and sum(map(_FREQUENT.__contains__, words)) < 0.02 * n,
    )
    return "".join("-" if s else "0" for s in seen)


@dataclass
class LabelModel:
    """How often good and bad texts get each vote of each labeler, and the share of good texts."""

    cells: np.ndarray
    good: float

    def posterior(self, said: str) -> float:
        """The probability that a text with these votes is good."""
        log = [math.log1p(-self.good), math.log(self.good)]
        for j, v in enumerate(said):
            for y in (0, 1):
                log[y] += math.log(self.cells[y, j, "-0".index(v)])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1]))))


def fit_label_model(counts: list[tuple[str, int]], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over vote patterns and their numbers of documents.

    Starts from labelers that are mostly right; one document is added to each
    cell in the start's proportions, which also keeps the two classes apart.
    """
    start = np.array([[[0.3, 0.7]] * len(LABELERS), [[0.01, 0.99]] * len(LABELERS)])
    model = LabelModel(start, 0.8)
    for _ in range(rounds):
        cells, yes, total = start.copy(), 0.8, 1.0
        for said, n in counts:
            p = model.posterior(said)
            yes += n * p
            total += n
            for j, v in enumerate(said):
                k = "-0".index(v)
                cells[1, j, k] += n * p
                cells[0, j, k] += n * (1 - p)
        model = LabelModel(cells / cells.sum(axis=2, keepdims=True), min(1 - 1e-9, yes / total))
    return model


def _trigrams(text: bytes):
    """The hash buckets of all byte trigrams of a text, in parts of bounded size."""
    for begin in range(0, max(0, len(text) - 2), STEP):
        b = np.frombuffer(text[begin : begin + STEP + 2], dtype=np.uint8).astype(np.uint32)
        mixed = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
        yield (mixed * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def _vote_buckets(said: str) -> list[int]:
    return [zlib.crc32(f"{j}{v}".encode()) & ((1 << HASH_BITS) - 1) for j, v in enumerate(said)]


def features(text: bytes, said: str) -> np.ndarray:
    """The hashed features of a text: shares of trigrams, and votes."""
    x = np.zeros(1 << HASH_BITS)
    for part in _trigrams(text):
        x += np.bincount(part, minlength=len(x))
    x *= TRIGRAMS / max(1, len(text) - 2)
    for k in _vote_buckets(said):
        x[k] += VOTE
    return x


@dataclass
class Scorer:
    """A logistic model over the hashed features."""

    weights: np.ndarray
    bias: float

    def score(self, text: bytes, said: str) -> float:
        """The probability that a text is good, rounded so that it is the same everywhere."""
        total = sum(float(self.weights[part].sum()) for part in _trigrams(text)) * TRIGRAMS / max(1, len(text) - 2)
        total += VOTE * float(sum(self.weights[k] for k in _vote_buckets(said))) + self.bias
        return round(1 / (1 + math.exp(max(-700.0, min(700.0, -total)))), 6)


def train_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Logistic regression by adaptive gradient steps; both classes weigh the same."""
    w, bias = np.zeros(x.shape[1]), 0.0
    seen, seen_bias = np.full(x.shape[1], 1e-8), 1e-8
    good = max(1e-9, target.sum())
    bad = max(1e-9, (1 - target).sum())
    weight = (target / good + (1 - target) / bad) / 2
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        off = weight * (p - target)
        gradient, slope = x.T @ off + decay * w, off.sum()
        seen += gradient**2
        seen_bias += slope**2
        w -= rate * gradient / np.sqrt(seen)
        bias -= rate * slope / math.sqrt(seen_bias)
    return Scorer(w.round(6), round(float(bias), 6))


def train(docs: DataFrame, text: str = "text") -> tuple[LabelModel, Scorer]:
    """Fit both models to a corpus. The texts are read twice; what comes to the driver has a fixed bound."""
    seen = docs.select(F.col(text).alias("text")).withColumn("order", F.xxhash64(F.coalesce("text", F.lit(""))))

    def vote(batch: pa.RecordBatch) -> list:
        return [[votes(t) for t in utf8(batch, "text")]]

    voted = keep(add_columns(seen, "text", [T.StructField("votes", T.StringType())], vote, drop_text=True))
    counts = sorted((r.votes, r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())
    model = fit_label_model(counts)
    # As many patterns as labelers can say, however many documents there are.
    classes = [(said, model.posterior(said) >= 0.5) for said, _ in counts]
    chosen = []
    for good in (True, False):
        side = [said for said, is_good in classes if is_good == good]
        if side:
            some = voted.where(F.col("votes").isin(side)).select("order").distinct().orderBy("order").limit(SAMPLE)
            chosen += [r.order for r in some.collect()]
    x, target = np.zeros((0, 1 << HASH_BITS)), np.zeros(0)
    if chosen:
        picked = seen.where(F.col("order").isin(chosen)).dropDuplicates(["order"])

        def describe(batch: pa.RecordBatch) -> list:
            texts = utf8(batch, "text")
            said = [votes(t) for t in texts]
            return [said, [features(t, v).astype(np.float32).tobytes() for t, v in zip(texts, said, strict=True)]]

        fields = [T.StructField("votes", T.StringType()), T.StructField("x", T.BinaryType())]
        rows = add_columns(picked, "text", fields, describe, drop_text=True).toArrow().sort_by("order")
        x = np.array([np.frombuffer(v.as_buffer(), dtype=np.float32) for v in rows["x"]]).reshape(rows.num_rows, 1 << HASH_BITS)
        target = np.array([model.posterior(said) for said in rows["votes"].to_pylist()])
    return model, train_scorer(x, target)


def score_quality(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of votes, posterior and score, and that column's name."""
    model, scorer = train(docs, text)
    name = fresh(docs, "quality")
    kind = T.StructType(
        [T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def make(batch: pa.RecordBatch) -> list:
        rows = []
        for t in utf8(batch, text):
            said = votes(t)
            rows.append({"votes": said, "posterior": round(model.posterior(said), 6), "score": scorer.score(t, said)})
        return [rows]

    return add_columns(docs, text, [T.StructField(name, kind)], make), name


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that the scorer rejects."""
    scored, name = score_quality(docs, text)
    return scored.where(F.col(f"{name}.score") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and decision for every document."""
    scored, name = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", f"{name}.*", (F.col(f"{name}.score") >= 0.5).alias("kept"))
