"""Queries over text functions, mention extraction and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import identity, redaction, text
from newsloom.operators import aliases, articles, catalog, mentions, ranking
from newsloom.plans import entities as entity_plan
from newsloom.queries import sql
from newsloom.queries.bindings import Newsroom
from newsloom.queries.registry import register

# The active catalog's names (ordinal 0) and aliases, one row each.
_NAMES = """
    SELECT id, canonical_key, entity_type, canonical_name, 0 AS ordinal, canonical_name AS alias
    FROM catalog WHERE status = 'ACTIVE'
    UNION ALL
    SELECT id, canonical_key, entity_type, canonical_name, unnest(range(1, len(aliases) + 1)),
        unnest(aliases)
    FROM catalog WHERE status = 'ACTIVE'"""
_RULES = f"""
    SELECT lower(arg_max(alias, row(canonical_key, ordinal))) AS word,
        arg_max(canonical_name, row(canonical_key, ordinal)) AS replacement
    FROM ({_NAMES})
    WHERE ordinal > 0
        AND replace(lower(alias), 'ß', 'ss') <> replace(lower(canonical_name), 'ß', 'ss')
    GROUP BY replace(lower(alias), 'ß', 'ss')"""
_TOKENS = r"""
    SELECT id, unnest(tokens) AS token, unnest(range(len(tokens))) AS position
    FROM (SELECT id, regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS tokens
        FROM {source})"""


def _offsets(tokens: str) -> str:
    return f"""
    SELECT id, token, position,
        sum(length(token)) OVER (PARTITION BY id ORDER BY position) - length(token) AS start
    FROM ({tokens})"""


_REWRITTEN_TOKENS = f"""
    SELECT t.id, t.position, coalesce(r.replacement, t.token) AS token
    FROM ({_TOKENS.format(text="content", source="contents")}) t
    LEFT JOIN ({_RULES}) r ON r.word = lower(t.token)"""
_LABELLED = f"SELECT DISTINCT lower(alias) AS word, entity_type AS label FROM ({_NAMES})"


@register(
    "mention_counts",
    sql.query("""
        SELECT k.article_id, k.canonical_name, coalesce(w.n, 0) AS mentions_in_text
        FROM (SELECT DISTINCT article_id, canonical_name FROM mentions) k
        LEFT JOIN article_words w ON w.id = k.article_id AND w.word = lower(k.canonical_name)"""),
)
def mention_counts(room: Newsroom) -> DataFrame:
    pairs = room.mentions.select("article_id", "canonical_name").distinct()
    texts = articles.with_text(room.articles, room.contents)
    counted = ranking.count_mentions(pairs, texts)
    return counted.withColumn("mentions_in_text", F.col("mentions_in_text").cast("bigint"))


@register(
    "alias_rewrite",
    sql.query(f"""
        SELECT id, sha256(string_agg(token, '' ORDER BY position)) AS filtered_hash
        FROM ({_REWRITTEN_TOKENS}) GROUP BY id"""),
)
def alias_rewrite(room: Newsroom) -> DataFrame:
    rules = catalog.rewrite_rules(catalog.active(room.catalog))
    done = aliases.rewrite_aliases(room.contents, rules)
    return done.select("id", F.sha2("filtered_content", 256).alias("filtered_hash"))


@register(
    "alias_rewrite_large_catalog",
    sql.query(f"""
        SELECT id, sha256(string_agg(token, '' ORDER BY position)) AS filtered_hash
        FROM ({_REWRITTEN_TOKENS}) GROUP BY id"""),
)
def alias_rewrite_large_catalog(room: Newsroom) -> DataFrame:
    """The same rewriting; the route doesn't depend on the size of the catalog."""
    rules = catalog.rewrite_rules(catalog.active(room.catalog))
    done = aliases.rewrite_aliases(room.contents, rules)
    return done.select("id", F.sha2("filtered_content", 256).alias("filtered_hash"))


@register(
    "catalog_spans",
    sql.query(f"""
        SELECT DISTINCT t.id, l.label, t.token AS text, 1.0::DOUBLE AS score,
            CAST(t.start AS BIGINT) AS start, CAST(t.start + length(t.token) AS BIGINT) AS stop
        FROM ({_offsets(_TOKENS.format(text="content", source="contents"))}) t
        JOIN ({_LABELLED}) l ON l.word = lower(t.token)"""),
)
def catalog_spans(room: Newsroom) -> DataFrame:
    rules = entity_plan.catalog_rules(catalog.active(room.catalog))
    spans = mentions.catalog_spans(room.contents, rules, text_column="content")
    return spans.select(
        "id", "label", "text", "score", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("stop"),
    )


# Phrases of two and four words at the start of every benchmark item, the shorter inside the longer.
_PHRASES = r"""
    SELECT DISTINCT lower(array_to_string(tokens[1 : n], '')) AS phrase, n, 'W' || n AS label FROM (
        SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS tokens FROM benchmark), (VALUES (3), (7)) v(n)
    WHERE len(tokens) >= n"""


@register(
    "phrase_spans",
    rf"""WITH t AS ({_offsets(_TOKENS.format(text="text", source="(SELECT doc_id AS id, text FROM documents)"))}),
        g AS (SELECT id, start, token || lead(token, 1) OVER w || lead(token, 2) OVER w AS three,
            token || lead(token, 1) OVER w || lead(token, 2) OVER w || lead(token, 3) OVER w || lead(token, 4) OVER w
                || lead(token, 5) OVER w || lead(token, 6) OVER w AS seven
            FROM t WINDOW w AS (PARTITION BY id ORDER BY position))
        SELECT id AS doc_id, label, text, CAST(start AS BIGINT) AS start FROM (
            SELECT id, 'W3' AS label, three AS text, start FROM g UNION ALL SELECT id, 'W7', seven, start FROM g) s
        JOIN ({_PHRASES}) f USING (label) WHERE f.phrase = lower(s.text)""",
)
def phrase_spans(room: Newsroom) -> DataFrame:
    """Phrases of several words, one inside the other, found in whole documents."""
    cut = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
    tokens = room.table("benchmark").select(F.regexp_extract_all("text", F.lit(cut), F.lit(0)).alias("t"))
    rules = None
    for n in (3, 7):
        some = tokens.filter(F.size("t") >= n).select(
            F.array_join(F.slice("t", 1, n), "").alias("alias"), F.lit(f"W{n}").alias("label")
        )
        rules = some if rules is None else rules.unionByName(some)
    documents = room.table("documents").select(F.col("doc_id").alias("id"), "text")
    spans = mentions.catalog_spans(documents, rules, text_column="text", overlapping=True)
    return spans.select(F.col("id").alias("doc_id"), "label", "text", F.col("start").cast("bigint").alias("start"))


_LOOKUP = f"""
    SELECT entity_type AS label, {sql.name_key('alias')} AS name_key,
        row(canonical_key, ordinal) AS seq, id, canonical_name FROM ({_NAMES})"""


def _resolved(spans: str) -> str:
    own = (
        "CASE WHEN true THEN "
        + sql.uuid5(settings.ENTITY_NAMESPACE, f"s.label || ':' || {sql.slug('s.text')}")
        + " END"
    )
    return f"""
    SELECT s.*, coalesce(l.id, a.id, {own}) AS canonical_entity_id,
        coalesce(l.canonical_name, a.canonical_name, trim(s.text)) AS canonical_name
    FROM ({spans}) s
    LEFT JOIN (SELECT label, name_key, arg_max(id, seq) AS id,
            arg_max(canonical_name, seq) AS canonical_name
        FROM ({_LOOKUP}) GROUP BY label, name_key) l
        ON l.label = s.label AND l.name_key = {sql.name_key('s.text')}
    LEFT JOIN (SELECT name_key, arg_max(id, seq) AS id,
            arg_max(canonical_name, seq) AS canonical_name
        FROM ({_LOOKUP}) GROUP BY name_key) a ON a.name_key = {sql.name_key('s.text')}"""


@register(
    "resolve_entities",
    sql.query(_resolved("SELECT event_id, label, text FROM mentions")),
)
def resolve_entities(room: Newsroom) -> DataFrame:
    spans = room.mentions.select("event_id", "label", "text")
    return mentions.resolve(spans, catalog.active(room.catalog))


_REWRITTEN_SPANS = f"""
    SELECT DISTINCT t.id, l.label, t.token AS text, CAST(t.start AS BIGINT) AS start,
        CAST(t.start + length(t.token) AS BIGINT) AS stop
    FROM ({_offsets(_REWRITTEN_TOKENS)}) t JOIN ({_LABELLED}) l ON l.word = lower(t.token)"""


@register(
    "entity_processing",
    sql.query(f"""
        SELECT a.id, s.label, s.text, s.start, s.stop, s.canonical_entity_id, s.canonical_name,
            CASE WHEN c.id IS NULL THEN 'article_content_not_found' END AS error
        FROM articles a LEFT JOIN contents c ON c.id = a.id
        LEFT JOIN ({_resolved(_REWRITTEN_SPANS)}) s ON s.id = a.id"""),
)
def entity_processing(room: Newsroom) -> DataFrame:
    """Rewrite, extract, threshold, resolve and mark, for all articles."""
    rows, _ = entity_plan.process(room.articles, room.contents, room.catalog, room.run_time)
    return rows.select("id", "error", F.explode_outer("entities").alias("e")).select(
        "id", "e.label", "e.text", F.col("e.start").cast("bigint").alias("start"),
        F.col("e.end").cast("bigint").alias("stop"), "e.canonical_entity_id", "e.canonical_name",
        "error",
    )


@register(
    "reprocess_totals",
    sql.query(f"""
        SELECT (SELECT count(*) FROM contents) AS documents, count(*) AS entities,
            count(*) / (SELECT count(*) FROM contents) AS entities_per_document
        FROM ({_REWRITTEN_SPANS})"""),
)
def reprocess_totals(room: Newsroom) -> DataFrame:
    filtered = entity_plan.filtered_contents(room.contents, room.catalog)
    found = entity_plan.extract_mentions(filtered, room.catalog)
    return entity_plan.reprocess_totals(found, room.contents)


@register(
    "best_predictions",
    """SELECT id, label, start, "end", score, ordinal FROM (
        SELECT event_id // 10 AS id, event_type AS label, user_id % 5 AS start,
            user_id % 5 + 4 AS "end", round(value) AS score, event_id AS ordinal,
            row_number() OVER (PARTITION BY event_id // 10, event_type, user_id % 5
                ORDER BY round(value) DESC, event_id) AS rank
        FROM events) WHERE rank = 1""",
)
def best_predictions(room: Newsroom) -> DataFrame:
    spans = room.table("events").select(
        F.expr("event_id DIV 10").alias("id"), F.col("event_type").alias("label"),
        (F.col("user_id") % 5).alias("start"), (F.col("user_id") % 5 + 4).alias("end"),
        F.round("value").alias("score"), F.col("event_id").alias("ordinal"),
    )
    return mentions.best_predictions(spans)


_WORDS = r"""
    SELECT doc_id, token, position, word, start FROM (
        SELECT doc_id, token, position,
            sum(length(token)) OVER (PARTITION BY doc_id ORDER BY position) - length(token) AS start,
            count(*) FILTER (regexp_matches(token, '\S'))
                OVER (PARTITION BY doc_id ORDER BY position) - 1 AS word
        FROM (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS position
            FROM (SELECT doc_id, regexp_extract_all(text, '\S+|\s+') AS tokens FROM documents)))
    WHERE regexp_matches(token, '\S')"""


@register(
    "word_chunks",
    f"""WITH words AS MATERIALIZED ({_WORDS}),
    sizes AS (SELECT doc_id, max(word) + 1 AS n FROM words GROUP BY doc_id),
    chunks AS (
        SELECT doc_id, n, unnest(range(CAST(greatest(1, ceil((n - 40) / 260.0)) AS BIGINT))) AS chunk
        FROM sizes)
    SELECT c.doc_id AS id, c.chunk, CAST(f.start AS BIGINT) AS chunk_start,
        CAST(l.start + length(l.token) AS BIGINT) AS chunk_end
    FROM chunks c JOIN words f ON f.doc_id = c.doc_id AND f.word = c.chunk * 260
    JOIN words l ON l.doc_id = c.doc_id AND l.word = least(c.chunk * 260 + 300, c.n) - 1""",
)
def word_chunks(room: Newsroom) -> DataFrame:
    documents = room.table("documents").select(F.col("doc_id").alias("id"), "text")
    chunks = mentions.word_chunks(documents, text_column="text", keep_text=False)
    return chunks.select("id", *[F.col(c).cast("bigint").alias(c) for c in chunks.columns[1:]])


@register(
    "chunk_limits",
    r"""SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'text_length'
            WHEN greatest(1, ceil((len(regexp_extract_all(text, '\S+')) - 40) / 260.0)) > 8
            THEN 'chunk_count' END AS problem
        FROM documents""",
)
def chunk_limits(room: Newsroom) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"\S+"))
    problem = mentions.chunk_limit_problem(
        words, F.length("text"), max_chunks=8, max_chars=20_000
    )
    return room.table("documents").select("doc_id", problem.alias("problem"))


@register(
    "name_normalize",
    sql.query(f"SELECT id, {sql.name_key('title')} AS name_key FROM articles"),
)
def name_normalize(room: Newsroom) -> DataFrame:
    return room.articles.select("id", text.name_key(F.col("title")).alias("name_key"))


@register(
    "slugs",
    sql.query(f"""SELECT id, {sql.slug('title')} AS slug, {sql.public_slug('title')} AS public_slug
        FROM articles"""),
)
def slugs(room: Newsroom) -> DataFrame:
    title = F.col("title")
    return room.articles.select(
        "id", text.slugify(title).alias("slug"), text.public_slug(title).alias("public_slug")
    )


@register(
    "paragraph_dedupe",
    r"""SELECT doc_id, sha256(array_to_string(list_filter(lines, lambda p, i:
            p <> '' AND list_position(lines, p) = i), ' ')) AS text_hash
        FROM (SELECT doc_id, list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'),
            lambda p: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p,
                '\p{Cf}+', '', 'g'), '[\t\x1f]', ' ', 'g'), '\p{Cc}+', '', 'g'),
                '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS lines
            FROM documents)""",
)
def paragraph_dedupe(room: Newsroom) -> DataFrame:
    cleaned = text.article_text(F.col("text"), decoded=True)
    return room.table("documents").select("doc_id", F.sha2(cleaned, 256).alias("text_hash"))


@register(
    "content_hash_groups",
    """SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id
        FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents)
        GROUP BY content_hash HAVING count(*) > 1""",
)
def content_hash_groups(room: Newsroom) -> DataFrame:
    hashed = room.table("documents").select(
        F.col("doc_id").alias("id"), identity.content_hash(F.col("text")).alias("content_hash")
    )
    return articles.duplicate_groups(hashed, "content_hash")


@register(
    "entity_types",
    f"""SELECT c_custkey, {sql.entity_kind("c_mktsegment")} AS from_segment,
        {sql.entity_kind("CASE c_nationkey % 5 WHEN 0 THEN ' team' WHEN 1 THEN 'head coach' WHEN 2 THEN 'League' WHEN 3 THEN 'player ' ELSE 'Manager' END")}
            AS from_title
        FROM customer""",
)
def entity_types(room: Newsroom) -> DataFrame:
    titles = F.array(*[F.lit(t) for t in (" team", "head coach", "League", "player ", "Manager")])
    return room.table("customer").select(
        "c_custkey",
        text.entity_type(F.col("c_mktsegment")).alias("from_segment"),
        text.entity_type(F.get(titles, F.col("c_nationkey") % 5)).alias("from_title"),
    )


@register(
    "score_tallies",
    sql.query("""SELECT article_id AS id, count(*) AS raw_entities,
        count(*) FILTER (score >= 0.95) AS persisted_entities,
        count(*) FILTER (score < 0.95) AS skipped_low_score
        FROM mentions GROUP BY article_id"""),
)
def score_tallies(room: Newsroom) -> DataFrame:
    return mentions.article_tallies(room.mentions.withColumnRenamed("article_id", "id"))


@register(
    "persisted_mentions",
    sql.query("""SELECT event_id, article_id, label, score, canonical_entity_id FROM mentions
        WHERE score >= 0.95"""),
)
def persisted_mentions(room: Newsroom) -> DataFrame:
    return mentions.persistable(room.mentions).select(
        "event_id", "article_id", "label", "score", "canonical_entity_id"
    )


@register(
    "text_statistics",
    """SELECT count(*) AS n, avg(n_chars) AS mean, median(n_chars) AS p50,
        list_sort(list(n_chars))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1] AS p90,
        list_sort(list(n_chars))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95,
        list_sort(list(n_chars))[least(CAST(floor(0.99 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p99
        FROM documents""",
)
def text_statistics(room: Newsroom) -> DataFrame:
    return articles.distribution(room.table("documents"), "n_chars")


@register(
    "span_problems",
    sql.query("""
        SELECT event_id, CASE
            WHEN label NOT IN ('click', 'view') THEN 'unknown_label'
            WHEN start < 0 OR stop <= start OR stop > length(doc) THEN 'offsets_outside'
            WHEN substring(doc, start + 1, stop - start) <> claimed THEN 'text_mismatch'
            WHEN trim(substring(doc, start + 1, stop - start), chr(10) || ' ') = '' THEN 'blank_text'
            WHEN score NOT BETWEEN 0 AND 1 THEN 'score_outside' END AS problem
        FROM (
            SELECT event_id, event_type AS label, d.text AS doc, value / 100 AS score,
                CAST(e.props ->> 'k' AS INTEGER) - 3 AS start,
                CAST(e.props ->> 'k' AS INTEGER) - 3 + user_id % 7 AS stop,
                CASE WHEN value < 20 THEN 'the' ELSE substring(d.text,
                    CAST(e.props ->> 'k' AS INTEGER) - 2, user_id % 7) END AS claimed
            FROM events e JOIN documents d ON d.doc_id = e.event_id // 10)"""),
)
def span_problems(room: Newsroom) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = room.table("events").select(
        "event_id", F.expr("event_id DIV 10").alias("doc_id"), "value",
        F.when(F.col("event_type") == "click", "football player")
        .when(F.col("event_type") == "view", "Club").otherwise(F.col("event_type")).alias("label"),
        (k - 3).alias("start"), (k - 3 + F.col("user_id") % 7).cast("int").alias("end"),
        (F.col("value") / 100).alias("score"),
    )
    joined = events.join(
        room.table("documents").select("doc_id", F.col("text").alias("doc")), "doc_id"
    )
    piece = F.substr("doc", F.col("start") + 1, F.col("end") - F.col("start"))
    claimed = joined.withColumn("text", F.when(F.col("value") < 20, "the").otherwise(piece))
    return claimed.select("event_id", mentions.span_problem(F.col("doc")).alias("problem"))


@register(
    "uuid5_ids",
    f"""SELECT c_custkey,
        {sql.uuid5(settings.ENTITY_NAMESPACE, "'CLUB:' || lower(c_name)")} AS entity_id,
        {sql.uuid5(settings.NEWS_URL_NAMESPACE, "'https://é.example/' || c_name")} AS article_id,
        {sql.uuid5(settings.SUMMARY_NAMESPACE, "c_name || ':' || '2024-01-01T03:00:00+00:00' || ':' || '2024-01-01T06:00:00+00:00'")}
            AS summary_id
        FROM customer""",
)
def uuid5_ids(room: Newsroom) -> DataFrame:
    name = F.col("c_name")
    start = F.lit("2024-01-01 03:00:00").cast("timestamp")
    end = F.lit("2024-01-01 06:00:00").cast("timestamp")
    return room.table("customer").select(
        "c_custkey",
        identity.entity_id(F.concat(F.lit("CLUB:"), F.lower(name))).alias("entity_id"),
        identity.article_id(F.concat(F.lit("https://é.example/"), name)).alias("article_id"),
        identity.summary_id(name, start, end).alias("summary_id"),
    )


_SECRET = r"(?i)(authorization|cookie|credential|key|password|secret|token)\s*[:=]\s*\S+"


@register(
    "redacted_documents",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{_SECRET}') THEN '***' ELSE text END AS text,
        '***' AS session_token, event_note
        FROM (SELECT doc_id, text, 'source ' || source AS event_note FROM documents)""",
)
def redacted_documents(room: Newsroom) -> DataFrame:
    rows = room.table("documents").select(
        "doc_id", "text", F.col("lang").alias("session_token"),
        F.map_from_arrays(
            F.array(F.lit("note"), F.lit("api_key")),
            F.array(F.concat(F.lit("source "), "source"), F.col("lang")),
        ).alias("event"),
    )
    return redaction.redact(rows).select(
        "doc_id", "text", "session_token", F.col("event")["note"].alias("event_note")
    )
