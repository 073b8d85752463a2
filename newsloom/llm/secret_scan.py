"""Secret scan through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
every match holds all trigrams of one of its alternatives. The index lists the
documents of each trigram that some rule asks for; postings of an alternative
are intersected, those of a rule's alternatives united, and the rule's regex
verifies its candidates. A rule without mandatory trigrams scans every text.

Cases: null text counts as empty; a document id that is null or occurs on
several rows is judged row by row (candidates of the id are verified on each);
other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import spans
from newsloom.llm.common import fresh, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules in the order in which kinds are listed. The first three are the base.
RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"

#: Alternatives beyond which a derivation forgets the text before it.
MOST = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, in lower case, one of which every match holds in full; None if there is no such query."""
    done = _walk(re._parser.parse(pattern), {(frozenset(), "")})
    sets = {grams for grams, _ in done}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


_State = set[tuple[frozenset[str], str]]


def _letter(states: _State, letters: list[str]) -> _State:
    out = set()
    for grams, tail in states:
        for letter in letters:
            text = tail + letter.lower()
            out.add((grams | {text} if len(text) == 3 else grams, text[-2:]))
    return out


def _apart(states: _State) -> _State:
    return {(grams, "") for grams, _ in states}


def _walk(items, states: _State) -> _State:
    """What the matched text must hold after ``items``, from what it must hold before."""
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            states = _letter(states, [chr(value)])
        elif name == "IN" and len(value) <= 6 and all(str(k) == "LITERAL" for k, _ in value):
            states = _letter(states, [chr(v) for _, v in value])
        elif name == "SUBPATTERN":
            states = _walk(value[-1], states)
        elif name == "BRANCH":
            states = set().union(*(_walk(branch, states) for branch in value[1]))
        elif name == "MAX_REPEAT":
            least, most, inner = value
            once = _walk(inner, states)
            if least == 0:
                states = states | once if most == 1 else _apart(states)
            else:
                states = once if most == 1 else _apart(once)
        elif name != "AT":
            states = _apart(states)
        if len(states) > MOST:
            states = _apart(states)
    return states


def build_index(docs: DataFrame, grams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings: one row (gram, doc_id) for each document and trigram that it holds."""
    lower = F.lower(F.col(text))
    held = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(held).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Rows (doc_id, kinds): the rules whose trigram queries a document answers."""
    spark = postings.sparkSession
    asked = [
        (kind, number, gram, len(grams))
        for kind, alternatives in queries.items()
        for number, grams in enumerate(alternatives)
        for gram in sorted(grams)
    ]
    # One row per trigram of a rule: as many as the rule file has.
    kinds = {"kind": pa.string(), "alternative": pa.int32(), "gram": pa.string(), "need": pa.int32()}
    columns = [pa.array([row[k] for row in asked], kind) for k, kind in enumerate(kinds.values())]
    # As an Arrow table it needs no Python on the executors; a list would start a daemon and workers there.
    wanted = F.broadcast(spark.createDataFrame(pa.table(columns, names=list(kinds))))
    met = (
        postings.join(wanted, "gram")
        .groupBy("doc_id", "kind", "alternative", "need")
        .agg(F.count_distinct("gram").alias("n"))
        .where("n = need")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans (start, number of the kind, end, kind), sorted, and its name."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    name = fresh(docs, "secret_spans")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    if queries:
        grams = sorted({g for q in queries.values() for s in q for g in s})
        found = candidates(build_index(docs, grams, doc_id, text), queries)
        found = found.select(F.col("doc_id").alias("_candidate"), F.col("kinds").alias("_kinds")).hint("shuffle_hash")
        joined = docs.alias("d").join(found, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("_candidate")), "left")
    else:
        joined = docs.alias("d").withColumn("_kinds", F.array().cast("array<string>"))
    value = F.coalesce(F.col(f"d.`{text}`"), F.lit(""))
    columns.append(value.alias("_value"))
    work = joined.select(*columns, F.coalesce("_kinds", F.array().cast("array<string>")).alias("_kinds"))
    by_rule = []
    for number, rule in enumerate(rules):
        hits = F.filter(spans.matches(F.col("_value"), rule.pattern, rule.group), _long_enough(rule))
        listed = F.transform(hits, _span(number, rule.kind))
        if rule.kind in queries:
            none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string>>")
            listed = F.when(F.array_contains("_kinds", rule.kind), listed).otherwise(none)
        by_rule.append(listed)
    every = F.sort_array(F.concat(*by_rule)).alias(name)
    return work.select(*[F.col(f"`{c}`") for c in docs.columns], every), name


def _long_enough(rule: Rule) -> Callable[[Column], Column]:
    return lambda m: F.char_length(m["part"]) >= rule.least


def _span(number: int, kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("number"), m["end"].alias("end"), F.lit(kind).alias("kind")
    )


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret masked; null texts stay null."""
    found, name = find_secrets(docs, doc_id=doc_id, text=text)
    return found.select(
        *[spans.masked(F.col(c), F.col(name), MASK).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found, name = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.col(name)
    base = F.filter(every, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(spans.joined(base), 256).alias("base_sha256"),
        spans.joined(every).alias("spans"),
    )


def _sql() -> str:
    """The same by scanning all texts with all rules."""
    parts = []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least,"
            f" regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,"
            f" string_split_regex(t, '{pattern}') AS b FROM docs WHERE regexp_matches(t, '{pattern}')"
        )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each_ AS (
  SELECT doc_id, number, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, b FROM found
), spans AS (
  SELECT doc_id, number, kind, length(g[i]) >= least AS kept,
    CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(m[i]) AS n FROM each_
), listed AS (
  SELECT doc_id, number, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM spans WHERE kept
)
SELECT docs.doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, number) FILTER (number < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, number), '') AS spans
FROM docs LEFT JOIN listed ON docs.doc_id IS NOT DISTINCT FROM listed.doc_id GROUP BY docs.doc_id
"""


OP9_SQL = _sql()
