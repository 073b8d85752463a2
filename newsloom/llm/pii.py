"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns. Labelers vote on each: the pattern's own
checks (digits, check sums, ranges), a gazetteer (top-level domains, issuer and
country prefixes), the words before the span, and the letters around it.
Expectation-maximisation over the counts of vote patterns, taken over all
candidates, estimates how reliable each labeler is; the posteriors then train a
logistic span classifier, which decides on the candidates beyond the base kinds.
Base spans that pass their checks always stay.

Only counts of vote patterns come to the driver; there are no more of them than
kinds times 3 to the number of labelers.

Cases: null text counts as empty; an empty table gives an empty result and an
untrained classifier; repeated rows are judged each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import spans
from newsloom.llm.common import keep, table

# Gazetteers of the labelers.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "nl", "uk", "eu", "us", "ch", "at"]
CARD_PREFIXES = ["34", "37", "4", "51", "52", "53", "54", "55", "6011", "65"]
PHONE_PREFIXES = ["+1", "+33", "+34", "+39", "+41", "+43", "+44", "+49"]
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "ES", "FR", "GB", "IT", "NL", "PL"]
CUES = "mail|contact|phone|tel|call|fax|mobile|card|visa|credit|account|iban|bank|ssn|social|host|server|address|passport"
AGAINST = "version|release|isbn|issn|section|chapter|figure|page|sku|serial|order no"

#: Code points before a span that the context labeler reads.
CONTEXT = 40
LABELERS = ("check", "gazetteer", "context", "border")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, checks that must hold, checks and gazetteer that vote."""

    name: str
    pattern: str
    base: bool
    must: Callable[[Column], Column]
    check: Callable[[Column], Column]
    gazetteer: Callable[[Column], Column]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _length_within(text: Column, low: int, high: int) -> Column:
    return F.char_length(_digits(text)).between(low, high)


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    doubled = F.split(F.reverse(_digits(text)), "")
    worth = F.transform(
        doubled,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2),
    )
    return F.aggregate(worth, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _octets(text: Column) -> Column:
    return F.forall(
        F.split(text, r"\."),
        lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
    )


def _starts(text: Column, prefixes: list[str]) -> Column:
    return F.regexp_like(text, F.lit("^(?:" + "|".join(p.replace("+", r"\+") for p in prefixes) + ")"))


def _always(text: Column) -> Column:
    return F.lit(True)


#: The letters that an address may have before the at-sign.
_LOCAL = "A-Za-z0-9._%+-"

#: Kinds in the order in which they are listed; the first four are the base. The
#: patterns are written so that Java's engine takes linear time: a match starts
#: at the start of its run of letters or where the last match ended, and runs
#: are possessive where what follows them can't be part of them.
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        True,
        _always,
        lambda t: F.char_length(t) <= 254,
        lambda t: F.lower(F.regexp_extract(t, r"\.([A-Za-z0-9-]+)$", 1)).isin(DOMAINS),
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        True,
        _octets,
        _octets,
        lambda t: ~_starts(t, ["0", "127", "22[4-9]", "2[3-9][0-9]"]),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        True,
        lambda t: _length_within(t, 16, 19) & luhn(t),
        luhn,
        lambda t: _starts(t, CARD_PREFIXES),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        True,
        lambda t: _length_within(t, 8, 15),
        lambda t: _length_within(t, 10, 13),
        lambda t: _starts(t, PHONE_PREFIXES),
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        False,
        _always,
        lambda t: ~_starts(t, ["000", "666", "9"]),
        lambda t: ~_starts(t, ["000"]),
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        False,
        _always,
        lambda t: F.char_length(F.regexp_replace(t, " ", "")).between(15, 34),
        lambda t: _starts(t, IBAN_COUNTRIES),
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
        False,
        _always,
        lambda t: ~_starts(_digits(t), ["0", "1"]),
        lambda t: ~_starts(_digits(t), ["000"]),
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)

SPAN = "struct<number:int,start:bigint,end:bigint,kind:string,base:boolean,votes:string>"


def candidate_spans(text: Column) -> Column:
    """All candidates of a text, sorted by kind and start: spans with the votes of the labelers as ``+-0``."""

    listed = []
    for number, kind in enumerate(KINDS):
        found = F.filter(spans.matches(text, kind.pattern), _must(kind))
        listed.append(F.transform(found, _voted(text, number, kind)).cast(f"array<{SPAN}>"))
    return F.sort_array(F.concat(*listed))


def _must(kind: Kind) -> Callable[[Column], Column]:
    return lambda m: kind.must(m["text"])


def _voted(text: Column, number: int, kind: Kind) -> Callable[[Column], Column]:
    """A match as a span with votes."""

    def sign(good: Column, bad: Column) -> Column:
        return F.when(good, "+").when(bad, "-").otherwise("0")

    def span(m: Column) -> Column:
        at = m["start"].cast("int")
        before = F.lower(F.substring(text, F.greatest(at - CONTEXT + 1, F.lit(1)), F.least(at, F.lit(CONTEXT))))
        around = F.concat(
            F.substring(text, at, F.when(at > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, m["end"].cast("int") + 1, F.lit(1))
        )
        check, gazetteer = kind.check(m["text"]), kind.gazetteer(m["text"])
        votes = F.concat(
            sign(check, ~check),
            sign(gazetteer, ~gazetteer),
            sign(F.regexp_like(before, F.lit(CUES)), F.regexp_like(before, F.lit(AGAINST))),
            sign(~F.regexp_like(around, F.lit("[A-Za-z0-9_]")), F.regexp_like(around, F.lit("[A-Za-z0-9_]"))),
        )
        return F.struct(
            F.lit(number).alias("number"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.lit(kind.base).alias("base"),
            votes.alias("votes"),
        )

    return span


@dataclass
class LabelModel:
    """Reliabilities: for each class (no, yes), labeler and vote (-, 0, +) its probability; priors by kind."""

    votes: np.ndarray
    prior: dict[str, float]

    def posterior(self, kind: str, votes: str) -> float:
        """The probability that a candidate with these votes is personal data."""
        log = [math.log1p(-self.prior[kind]), math.log(self.prior[kind])]
        for j, v in enumerate(votes):
            for y in (0, 1):
                log[y] += math.log(self.votes[y, j, "-0+".index(v)])
        return 1 / (1 + math.exp(min(700, log[0] - log[1])))


def fit_labelers(counts: list[tuple[str, str, int]], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over (kind, votes, number of candidates).

    Starts from labelers that are right eight times in ten; half a candidate is
    added to each cell, so nothing becomes impossible.
    """
    votes = np.array([[[0.7, 0.2, 0.1]] * len(LABELERS), [[0.1, 0.2, 0.7]] * len(LABELERS)])
    model = LabelModel(votes, {k.name: 0.5 for k in KINDS})
    for _ in range(rounds):
        cells = np.full(votes.shape, 0.5)
        yes = {k.name: [1.0, 2.0] for k in KINDS}
        for kind, said, n in counts:
            p = model.posterior(kind, said)
            yes[kind][0] += n * p
            yes[kind][1] += n
            for j, v in enumerate(said):
                cells[1, j, "-0+".index(v)] += n * p
                cells[0, j, "-0+".index(v)] += n * (1 - p)
        model = LabelModel(cells / cells.sum(axis=2, keepdims=True), {k: a / b for k, (a, b) in yes.items()})
    return model


@dataclass
class SpanClassifier:
    """A logistic model over the kind and the votes; its score is a sum that SQL can write."""

    bias: float
    kinds: dict[str, float]
    votes: np.ndarray

    def score(self, span: Column) -> Column:
        """The log-odds of a span."""
        total = F.lit(float(self.bias))
        for kind, weight in self.kinds.items():
            total = total + F.when(span["kind"] == kind, float(weight)).otherwise(0.0)
        for j, weights in enumerate(self.votes):
            vote = F.substring(span["votes"], j + 1, 1)
            total = total + F.when(vote == "-", float(weights[0])).when(vote == "+", float(weights[2])).otherwise(float(weights[1]))
        return total


def train_classifier(counts: list[tuple[str, str, int]], model: LabelModel, rounds: int = 300) -> SpanClassifier:
    """Fit the span classifier to the posteriors, each vote pattern weighted by its candidates."""
    names = [k.name for k in KINDS]
    width = 1 + len(names) + 3 * len(LABELERS)
    x, target, weight = np.zeros((len(counts), width)), np.zeros(len(counts)), np.zeros(len(counts))
    for i, (kind, said, n) in enumerate(counts):
        x[i, 0] = x[i, 1 + names.index(kind)] = 1
        for j, v in enumerate(said):
            x[i, 1 + len(names) + 3 * j + "-0+".index(v)] = 1
        target[i], weight[i] = model.posterior(kind, said), n
    w = np.zeros(width)
    weight = weight / max(1.0, weight.sum())
    for _ in range(rounds if len(counts) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    w = w.round(9)
    return SpanClassifier(w[0], dict(zip(names, w[1 : 1 + len(names)], strict=True)), w[1 + len(names) :].reshape(-1, 3))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, spans): base spans, and others beside them that the span classifier takes.

    The candidates are written once; the texts are read once.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = keep(docs.select(F.col(doc_id).alias("doc_id"), candidate_spans(value).alias("spans")))
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    counts = sorted((r.kind, r.votes, r.n) for r in rows)
    classifier = train_classifier(counts, fit_labelers(counts))
    base = F.filter("spans", lambda s: s["base"])
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return found.withColumn("spans", F.filter("spans", lambda s: s["base"] | (apart(s) & (classifier.score(s) > 0))))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(spans.joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )
