"""Exact n-gram Jaccard self-join with a token-group matrix.

Similar sets are put into groups of bounded size. A row of the matrix says which
groups hold a token in the union of their sets. A query set shares at most as
many tokens with any member of a group as with the group's union, so only groups
that reach the needed overlap are opened, where each member is then compared.

Steps: sets that are equal become one. Sets of one smallest hash form groups;
inside a group all are compared, and linked ones become one part. Then the rest
must be found: two sets that link share a token among their rarest few (the
prefix that the threshold leaves open), so the matrix is kept for prefixes. Rows
of tokens that only one part holds say nothing and go. A row says how far its
token reaches: the rarer tokens before it may all be missing from a partner, so
the later its place, the smaller the partners that it can speak for. Where all
sets that hold a token are too large for a row, the row goes; similar sets that
do not link differ in their rarest tokens, so rows of what they share go, and
they do not meet in pairs. The rows left name, for each set, how many of its
tokens each group of other parts holds. Groups that hold too few say so before
any set is fetched; for the others the bound is taken again with the union of
whole sets, and groups that still qualify are opened.

The order "rarest first" only has to be the same everywhere for the result to be
exact; it is taken from counts of tokens that are frequent in some slice.
Shingles are compared by 64-bit hashes, and a set is named by a 64-bit hash of its own.

Cases: a text without words, or null, has no set and links with nothing; one of
fewer words than a shingle is one shingle; equal texts are one set, whatever
their ids; rows without doc_id link like others, and their component is the
smallest doc_id in it, or null; rows of one doc_id share a component, which all
their texts tie together; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, fresh, keep, map_batches, slices, table, utf8
from newsloom.llm.graph import components, filter_places, may_hold, member_filter

#: Words of a shingle, and the similarity at which sets link, in hundredths, unless the caller says otherwise.
SHINGLE, THRESHOLD = 4, 85
#: Sets of a group, and queries that meet a group at a time.
GROUP, QUERIES = 256, 512
#: Shared tokens after which a group is opened, unless sizes demand fewer. Changes the work, never the result.
ENOUGH = 2
#: Tokens whose frequency is known for ordering (8 bytes each, twice).
FREQUENT = 1 << 18


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted 64-bit hashes. A-Z count as lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = len(words) - width + 1
    mixed = np.zeros(size, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ each[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def links(overlap, one, two, threshold: int = THRESHOLD):
    """Whether sets of sizes ``one`` and ``two`` with that overlap are similar enough."""
    return 100 * overlap >= threshold * (one + two - overlap)


def prefix_length(size: int, threshold: int = THRESHOLD) -> int:
    """Tokens among which a set of ``size`` shares one with every set that links with it."""
    return size - -(-threshold * size // 100) + 1


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """The name of each set."""
    return _signed(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes()) for tokens in sets], dtype=np.uint64))


def _surveyed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per row its set in brief (kind 0); per slice the tokens that are frequent there (kind 1)."""
    names = ["kind", "doc_id", "n", "key", "token"]
    for batch in batches:
        for part in slices(batch, "text"):
            every = [shingles(text, width) for text in utf8(part, "text")]
            size = len(every)
            first = np.array([tokens[0] if len(tokens) else 0 for tokens in every], dtype=np.uint64)
            rows = [np.array([len(tokens) for tokens in every]), _keys(every), _signed(first)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * size, pa.int32()), part.column(0).cast(pa.int64()), *[pa.array(r, pa.int64()) for r in rows]], names=names
            )
            found, counts = np.unique(np.concatenate(every), return_counts=True)
            often = counts >= max(3, size // 500)
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(none), np.int32)), none, pa.array(counts[often].astype(np.int64)), none, pa.array(_signed(found[often]))],
                names=names,
            )


def _survey(docs: DataFrame, width: int) -> DataFrame:
    return keep(map_batches(docs, lambda batches: _surveyed(batches, width), "kind int, doc_id bigint, n bigint, key bigint, token bigint"))


def _token_rows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Rows (key, tokens) of the sets in ``wanted`` (key, doc_id); only documents of those ids leave their tasks, each set once a batch."""
    held = member_filter(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
            for part in slices(batch.filter(pa.array(may_hold(held, places))), "text"):
                sets = [shingles(text, width) for text in utf8(part, "text")]
                keys, at = np.unique(_keys(sets), return_index=True)
                packed = [sets[i].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(packed, pa.binary())], names=["key", "tokens"])

    placed = docs.select("doc_id", "text", *[p.alias(f"p{k}") for k, p in enumerate(filter_places("doc_id"))])
    rows = map_batches(placed, run, "key bigint, tokens binary")
    return rows.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("tokens").alias("tokens"))


class OpenGroup:
    """A group of sets: its token union and, for each token, the members that hold it."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.threshold = threshold
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.flat = np.concatenate(sets)
        self.union, self.where = np.unique(self.flat, return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def overlaps(self, query: np.ndarray) -> np.ndarray | None:
        """How many tokens each member shares with the query; None if the union shows that none can link."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        shared = at[self.union[at] == query]
        if 100 * len(shared) < self.threshold * len(query):
            return None
        mark = np.zeros(len(self.union), dtype=np.int32)
        mark[shared] = 1
        return np.add.reduceat(mark[self.where], self.starts)


def _sets(frame: pd.DataFrame, column: str = "tokens") -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in frame[column]]


def _inside(frame: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Edges that span the linked sets of one group."""
    frame = frame.sort_values("key")
    ids = frame["key"].tolist()
    sets = _sets(frame)
    group = OpenGroup(sets, threshold)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, query in enumerate(sets):
        shared = group.overlaps(query)
        for j in np.flatnonzero(links(shared, group.sizes, len(query), threshold)).tolist():
            one, two = sorted((find(i), find(j)))
            root[two] = one
    pairs = [(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i]
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _across(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """An edge between parts for each query that links with a member of the group (which is connected already)."""
    members, queries = rows[~rows["asks"]], rows[rows["asks"]]
    pairs = []
    if len(members) and len(queries):
        group = OpenGroup(_sets(members), threshold)
        other = int(members["part"].iloc[0])
        for part, query in zip(queries["part"].tolist(), _sets(queries), strict=True):
            shared = group.overlaps(query)
            if shared is not None and links(shared, group.sizes, len(query), threshold).any():
                pairs.append((part, other))
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64").drop_duplicates()


def _buckets(frame: DataFrame, by: str, size: int, seed: int = 0) -> DataFrame:
    """``frame`` with columns ``bucket``, of ``deals``: rows of a value of ``by`` dealt by their set into parts of about ``size``."""
    counts = frame.groupBy(by).agg(F.ceil(F.count("*") / size).alias("deals")).where("deals > 1")
    rows = frame.join(counts, by, "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.col("deals")))


def _first_links(docs: DataFrame, sets: DataFrame, width: int, threshold: int) -> DataFrame:
    """Edges among sets of one smallest hash. Large groups are dealt out twice, in two ways."""
    several = sets.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(sets.join(several, "token").select("key", "doc_id", "token", "size"))
    one = _buckets(members, "token", GROUP).withColumn("deal", F.lit(0))
    two = _buckets(members.where(F.col("size") > GROUP), "token", GROUP, seed=1).withColumn("deal", F.lit(1))
    dealt = one.unionByName(two).select("key", "token", "bucket", "deal")
    rows = _token_rows(docs, members, width).join(dealt, "key")
    return rows.groupBy("token", "bucket", "deal").applyInPandas(lambda frame: _inside(frame, threshold), "a bigint, b bigint")


def _prefixes(docs: DataFrame, survey: DataFrame, width: int, threshold: int) -> DataFrame:
    """Rows (doc_id, n, key, token, reach): each document's rarest tokens, one of which every partner shares.

    Sets of sizes n and m that link share ``ENOUGH`` tokens, or all that their sizes demand,
    whose places lie so early that ``threshold * m <= reach`` of the one and ``threshold * n <= reach`` of the other.
    """
    often = survey.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    known, counts = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(known)
    known, counts = known[order], counts[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingles(t, width) for t in utf8(part, "text")]
                keys = _keys(found)
                if len(known):
                    for i, tokens in enumerate(found):
                        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                        count = np.where(known[at] == tokens, counts[at], 0)
                        found[i] = tokens[np.argsort(count, kind="stable")]
                sizes = np.array([len(t) for t in found])
                took = [t[: prefix_length(len(t), threshold)] if len(t) else t for t in found]
                repeat = np.array([len(t) for t in took])
                places = np.concatenate([np.arange(len(t)) for t in took])
                reach = 100 * np.repeat(sizes, repeat) - (100 + threshold) * (places - ENOUGH + 1)
                columns = [
                    part.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(took)), repeat))),
                    pa.array(np.repeat(sizes, repeat).astype(np.int64)),
                    pa.array(np.repeat(keys, repeat)),
                    pa.array(_signed(np.concatenate(took))),
                    pa.array(reach.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "token", "reach"])

    return map_batches(docs, run, "doc_id bigint, n bigint, key bigint, token bigint, reach bigint")


def _matrix(prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (token, key, doc_id, n, reach) for tokens that several sets hold in their prefixes; each set speaks once."""
    shared = prefixes.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    shared = keep(shared.select("token"))
    held = member_filter(shared, "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = may_hold(held, [batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6)])
            yield batch.filter(pa.array(chosen)).select([0, 1, 2, 3, 4])

    placed = prefixes.select("doc_id", "n", "key", "token", "reach", *[p.alias(f"p{k}") for k, p in enumerate(filter_places("token"))])
    rows = map_batches(placed, run, "doc_id bigint, n bigint, key bigint, token bigint, reach bigint").distinct()
    speaks = sets.select(F.col("key").alias("set"), F.col("doc_id").alias("by"))
    rows = rows.join(speaks, (F.col("key") == F.col("set")) & F.col("doc_id").eqNullSafe(F.col("by")), "left_semi")
    return keep(rows.join(shared, "token", "left_semi").select("token", "key", "doc_id", "n", "reach"))


def _placed(matrix: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """The matrix with the ``part`` of each set, for tokens that several parts hold, some set of fitting size early enough."""
    rows = matrix.join(parts, F.col("key") == F.col("vertex"), "left").withColumn("part", F.coalesce("component", "key"))
    rows = keep(rows.select("token", "key", "doc_id", "n", "reach", "part"))
    several = rows.groupBy("token").agg(
        F.min("part").alias("first"), F.max("part").alias("last"), F.min("n").alias("least"), F.max("reach").alias("most")
    )
    near = (F.col("least") * threshold <= F.col("reach")) & (F.col("n") * threshold <= F.col("most"))
    return keep(rows.join(several.where("first <> last"), "token").where(near).select(*rows.columns))


def _groups(matrix: DataFrame) -> DataFrame:
    """The sets of the matrix in groups of one part each."""
    members = _buckets(matrix.select("key", "doc_id", "n", "part").distinct(), "part", GROUP)
    return keep(members.withColumn("group", F.xxhash64("part", "bucket")).drop("bucket"))


def _open(docs: DataFrame, members: DataFrame, asked: DataFrame, width: int, threshold: int) -> DataFrame:
    """Edges between the parts of sets that ask (key, doc_id, part, group) and those of the groups they ask."""
    columns = ["key", "doc_id", "part", "group", "bucket"]
    asked = keep(_buckets(keep(asked), "group", QUERIES).select(*columns))
    held = members.join(asked.select("group", "bucket").distinct(), "group").select(*columns)
    roles = keep(held.withColumn("asks", F.lit(False)).union(asked.withColumn("asks", F.lit(True))))
    rows = _token_rows(docs, roles, width).join(roles.drop("doc_id"), "key")
    return keep(rows.groupBy("group", "bucket").applyInPandas(lambda rows: _across(rows, threshold), "a bigint, b bigint"))


def may_link(shared: Column, n: Column, m: Column, threshold: int = THRESHOLD) -> Column:
    """Whether sets of sizes ``n`` and ``m`` may link if their prefixes share so many tokens.

    The set whose prefix ends first has all its other shared tokens behind that
    prefix, so the overlap is below ``shared + threshold * size / 100`` of the larger.
    As a function of ``m`` the needed count rises up to ``n`` and falls beyond it.
    """
    whole = 100 + threshold
    return 100 * whole * shared > 100 * threshold * (n + m) - threshold * whole * F.greatest(n, m)


def _enough(threshold: int) -> Column:
    """Whether a set of size ``n`` that shares ``shared`` prefix tokens with sets of sizes ``low`` to ``high`` may link with one."""
    # Among the sizes in reach the needed count is least at the smallest or the largest.
    least = F.greatest("low", F.ceil(F.col("n") * threshold / 100))
    most = F.least("high", F.floor(F.col("n") * 100 / threshold))
    return may_link(F.col("shared"), F.col("n"), least, threshold) | may_link(F.col("shared"), F.col("n"), most, threshold)


def _last_links(docs: DataFrame, matrix: DataFrame, width: int, threshold: int) -> DataFrame:
    """Edges between parts: matrix rows name groups to be opened."""
    members = _groups(matrix)
    rows = matrix.join(members.select("key", "group"), "key")
    union = rows.groupBy("token", "part", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"))
    one, two = matrix.alias("q"), union.alias("g")
    near = (F.col("g.low") * threshold <= F.col("q.reach")) & (F.col("q.n") * threshold <= F.col("g.reach"))
    pairs = one.join(two, (F.col("q.token") == F.col("g.token")) & (F.col("q.part") > F.col("g.part")) & near)
    bounds = pairs.groupBy(F.col("q.key").alias("key"), F.col("g.group").alias("group")).agg(
        F.first("q.doc_id").alias("doc_id"), F.first("q.part").alias("part"), F.first("q.n").alias("n"),
        F.count("*").alias("shared"), F.min("g.low").alias("low"), F.max("g.high").alias("high"),
    )
    bounds = bounds.where(_enough(threshold) | (F.col("shared") >= ENOUGH))
    return _open(docs, members, bounds.select("key", "doc_id", "part", "group"), width, threshold)


def _linked(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, key) of the documents, and edges that span the linked sets."""
    survey = _survey(docs, width)
    rows = survey.where("kind = 0").drop("kind")
    sets = keep(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("token").alias("token")))
    edges = keep(_first_links(docs, sets, width, threshold))
    matrix = _matrix(keep(_prefixes(docs, survey, width, threshold)), sets)
    matrix = _placed(matrix, components(edges), threshold)
    if not matrix.isEmpty():
        edges = edges.union(_last_links(docs, matrix, width, threshold))
    return rows.drop("token"), edges


def _named(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (key, part): the component of each set."""
    found = components(edges).select(F.col("vertex").alias("key"), F.col("component").alias("part"))
    keys = rows.where("n > 0").select("key").distinct()
    return keep(keys.join(found, "key", "left").select("key", F.coalesce("part", "key").alias("part")))


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``: shingles of ``width`` words, links from ``threshold`` hundredths."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows, edges = _linked(docs, width, threshold)
    # A document id with several texts ties their sets together.
    full = rows.where("n > 0")
    tie = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    tied = full.select("doc_id", "key").distinct().join(tie.select("doc_id", "low"), "doc_id")
    named = _named(rows, edges.union(tied.select(F.col("key").alias("a"), F.col("low").alias("b"))))
    ids = full.select("doc_id", "key").distinct().join(named, "key").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = full.join(named.join(ids, "part").select("key", "component_id"), "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0")
    return out.union(empty.select("doc_id", "n", "doc_id"))


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of rows that share it one of the first text in order.

    Components are of texts here: different texts of one id stay if they do not
    link. Rows without id go before rows with one. Texts without words stay.
    """
    brief = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows, edges = _linked(brief, width, threshold)
    named = _named(rows, edges)
    full = rows.where("n > 0").select("doc_id", "key").distinct().join(named, "key")
    speaks = keep(full.groupBy("part").agg(F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", "key")).alias("by")))
    odd = keep(rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    this, key, row = (fresh(docs, name) for name in ("this_id", "set_key", "whole_row"))
    once = F.col(doc_id).cast("bigint").eqNullSafe(F.col(this))
    # Ids of one row: they stay unless another row speaks for their component.
    gone = full.join(speaks, "part").where("doc_id IS NOT NULL AND doc_id <> by.doc_id").select(F.col("doc_id").alias(this)).distinct()
    left = keep(gone.union(odd.select(F.col("doc_id").alias(this))).distinct())
    plain = docs.join(left, once, "left_anti")
    # Rows without id, or that share one, are told apart by their texts.
    field = docs.schema[text].name
    again = docs.join(odd.select(F.col("doc_id").alias(this)), once, "left_semi")
    again = add_columns(again, field, [T.StructField(key, T.LongType())], lambda part: [_set_keys(part, field, width)])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = again.join(speaks.select(F.col("by.key").alias(key), F.col("by.doc_id").alias(this)), [key]).where(once)
    single = chosen.groupBy(key).agg(F.min_by(whole, F.col(text)).alias(row)).select(f"{row}.*")
    return plain.union(again.where(F.col(key).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])).union(single)


def _set_keys(part: pa.RecordBatch, text: str, width: int) -> pa.Array:
    """The name of each text's set, null for texts without words."""
    sets = [shingles(value, width) for value in utf8(part, text)]
    return pa.array(_keys(sets), mask=np.array([len(tokens) == 0 for tokens in sets]))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, threshold=85)


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * shared >= 85 * (s.n + t.n - shared)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM docs UNION SELECT linked.b, reach.r FROM reach JOIN linked ON linked.a = reach.v AND linked.b > reach.r
)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v) USING (doc_id)
"""
