"""Queries over data-quality jobs, operations tables and response parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import identity, responses, windows
from newsloom.operators import catalog, quality, ranking, upsert
from newsloom.queries import sql
from newsloom.queries.bindings import NOW, Newsroom
from newsloom.queries.ingest_queries import EVENT_SQL
from newsloom.queries.registry import register
from newsloom.sources import events


def problem_list(names: dict[str, str]) -> str:
    """SQL text of the names whose condition holds, in order."""
    parts = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in names.items())
    return f"coalesce(concat_ws(',', {parts}), '')"


# Pointer events damaged by a rule on the document's language and length.
_DAMAGED_SQL = f"""
    SELECT key, CASE language
        WHEN 'fr' THEN replace(value, '"event_version":1', '"event_version":2')
        WHEN 'es' THEN replace(value, '"causation_id":null,', '')
        WHEN 'de' THEN replace(replace(value, '"producer"', '"x":1,"producer"'), '+00:00', '')
        ELSE CASE WHEN n_chars < 100 THEN left(value, 50) ELSE value END END AS value
    FROM (SELECT e.*, a.language, a.n_chars FROM ({EVENT_SQL}) e JOIN articles a ON a.id = e.key)"""


@register(
    "event_contract_rejects",
    sql.query("""
        SELECT id AS key, CASE language WHEN 'fr' THEN 'event_version' WHEN 'es' THEN 'missing_field'
            WHEN 'de' THEN 'unknown_field,occurred_at'
            ELSE CASE WHEN n_chars < 100 THEN 'not_json' ELSE '' END END AS problems
        FROM articles"""),
)
def event_contract_rejects(room: Newsroom) -> DataFrame:
    sizes = room.table("documents").select("doc_id", "n_chars")
    context = room.articles.join(sizes, "doc_id").select(F.col("id").alias("key"), "language", "n_chars")
    raw = events.crawled_events(room.articles, room.run_time).join(context, "key")
    value = F.col("value")

    def swap(v, old: str, new: str):
        return F.replace(v, F.lit(old), F.lit(new))

    language = F.col("language")
    damaged = (
        F.when(language == "fr", swap(value, '"event_version":1', '"event_version":2'))
        .when(language == "es", swap(value, '"causation_id":null,', ""))
        .when(
            language == "de",
            swap(swap(value, '"producer"', '"x":1,"producer"'), "+00:00", ""),
        )
        .when(F.col("n_chars") < 100, F.left(value, F.lit(50)))
        .otherwise(value)
    )
    checked = quality.check_events(raw.select("key", damaged.alias("value")))
    # Text that is no JSON breaks every rule; the first name says it all.
    listed = F.when(
        F.array_contains("problems", "not_json"), F.lit("not_json")
    ).otherwise(F.array_join("problems", ","))
    return checked.select("key", listed.alias("problems"))


_ARTIFACT_SQL = problem_list(
    {
        "content_type": "page_id % 5 = 0",
        "length_mismatch": "page_id % 3 = 0",
        "hash_mismatch": "page_id % 7 = 0",
        "text_length": f"NOT length(html) BETWEEN 1 AND {quality.MAX_TEXT}",
        "failed_with_content": "page_id % 11 = 0",
        "incomplete_projection": "page_id % 11 <> 0 AND page_id % 13 = 0",
    }
)


@register("artifact_problems", f"SELECT page_id AS id, {_ARTIFACT_SQL} AS problems FROM pages")
def artifact_problems(room: Newsroom) -> DataFrame:
    """Pages as stored artifacts with damaged metadata."""
    n, content = F.col("page_id"), F.encode("html", "UTF-8")
    size = F.octet_length("html")
    artifacts = room.table("pages").select(
        n.alias("id"),
        content.alias("content"),
        F.when(n % 5 == 0, "text/plain").otherwise("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(n % 3 == 0, size + 1).otherwise(size).alias("content_length"),
        F.when(n % 7 == 0, F.lit("0" * 64)).otherwise(F.sha2("html", 256)).alias("content_sha256"),
        F.when(n % 13 != 0, F.lit("Title")).when(n % 11 == 0, F.lit("T")).alias("title"),
        F.col("html").alias("cleaned_text"),
        F.when(n % 11 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
        F.lit("TRAFILATURA").alias("extractor"),
        F.array(F.lit("note")).alias("diagnostics"),
    )
    checked = quality.artifact_problems(artifacts)
    return checked.select("id", F.array_join("problems", ",").alias("problems"))


@register(
    "artifact_conflicts",
    """SELECT conv_id AS id, count(DISTINCT text) AS versions FROM conversations
        GROUP BY conv_id HAVING count(DISTINCT text) > 1""",
)
def artifact_conflicts(room: Newsroom) -> DataFrame:
    """Turns of a conversation as evidence stored under one id."""
    nothing = F.lit(None).cast("string")
    artifacts = room.table("conversations").select(
        F.col("conv_id").alias("id"), F.encode("text", "UTF-8").alias("content"),
        *[
            nothing.alias(c)
            for c in ("content_type", "etag", "last_modified", "title", "status", "extractor")
        ],
        nothing.alias("cleaned_text"), F.array().cast("array<string>").alias("diagnostics"),
    )
    return quality.artifact_conflicts(artifacts)


@register(
    "batch_problems",
    "SELECT o_orderkey AS id, "
    + problem_list(
        {
            "not_terminal": "o_orderstatus = 'O'",
            "negative_count": "least(o_custkey % 50, o_orderkey % 31 - 1, o_custkey % 7) < 0",
            "too_many_outcomes": "o_orderkey % 31 - 1 + o_custkey % 7 > o_custkey % 50",
        }
    )
    + " AS problems FROM orders",
)
def batch_problems(room: Newsroom) -> DataFrame:
    """Orders as crawl batches."""
    status = F.col("o_orderstatus")
    batches = room.table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(status == "O", "RUNNING").when(status == "F", "FAILED").otherwise("PARTIAL").alias("status"),
        (F.col("o_custkey") % 50).alias("discovered_count"),
        (F.col("o_orderkey") % 31 - 1).alias("fetched_count"),
        (F.col("o_custkey") % 7).alias("failed_count"),
    )
    return quality.batch_problems(batches).select("id", F.array_join("problems", ",").alias("problems"))


@register(
    "source_problems",
    "SELECT s_suppkey AS id, "
    + problem_list(
        {
            "name": "s_suppkey % 17 = 0",
            "domain": "s_nationkey % 4 = 0",
            "feed_url": "s_nationkey % 5 = 0",
            "feed_host_not_allowed": "s_nationkey % 6 = 1 AND s_nationkey % 5 <> 0",
            "reliability_tier": "s_suppkey % 7 = 0 OR s_suppkey % 7 = 6",
            "crawl_interval": "s_acctbal <= 0",
        }
    )
    + " AS problems FROM supplier",
)
def source_problems(room: Newsroom) -> DataFrame:
    """Suppliers as source configurations."""
    n, nation = F.col("s_suppkey"), F.col("s_nationkey")
    rows = room.table("supplier").select(
        n.alias("id"),
        F.when(n % 17 == 0, "  ").otherwise(F.col("s_name")).alias("name"),
        F.when(nation % 5 == 0, "ftp://feeds.example.com/rss")
        .when(nation % 6 == 1, "https://example.org/rss")
        .otherwise("https://feeds.example.com/rss").alias("rss_url"),
        F.when(nation % 4 == 0, F.array(F.lit("Example.com."), F.lit("https://x")))
        .otherwise(F.array(F.lit(" Example.com. "))).alias("allowed_domains"),
        F.lit("RSS").alias("source_type"),
        (n % 7).cast("smallint").alias("reliability_tier"),
        F.ceil("s_acctbal").cast("int").alias("crawl_interval_minutes"),
        F.lit(2).cast("smallint").alias("max_concurrency"),
    )
    return quality.source_problems(rows).select("id", F.array_join("problems", ",").alias("problems"))


_REQUESTS_SQL = f"""
    SELECT event_id AS id, user_id AS source_id, ts AS started_at,
        user_id || ':' || {sql.iso(sql.floor3('ts'))} AS idempotency_key FROM events"""


@register(
    "batch_open",
    f"""SELECT idempotency_key, arg_min(id, row(started_at, id)) AS id,
        min(started_at) AS started_at FROM ({_REQUESTS_SQL}) GROUP BY idempotency_key""",
)
def batch_open(room: Newsroom) -> DataFrame:
    """Events as batch requests: half of the keys are stored already."""
    ts = F.col("ts").cast("timestamp")
    requests = room.table("events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), ts.alias("started_at"),
        identity.batch_key(F.col("user_id").cast("string"), windows.floor_window(ts)).alias(
            "idempotency_key"
        ),
    )
    nothing = requests.filter(F.lit(False))
    stored = upsert.open_batches(nothing, requests.filter(F.col("started_at") < F.lit(NOW)))
    return upsert.open_batches(stored, requests).select("idempotency_key", "id", "started_at")


@register(
    "source_versions",
    """SELECT s_suppkey AS id, coalesce(c.name, s_name) AS name,
        s_nationkey % 5 + 1 + CASE WHEN c.name IS NULL THEN 0 ELSE 1 END AS version
        FROM supplier LEFT JOIN (
            SELECT l_suppkey, arg_min('Renamed ' || l_orderkey, row(l_orderkey, l_linenumber, l_partkey,
                l_quantity)) AS name
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
            WHERE l_linenumber = s_nationkey % 5 + 1 GROUP BY l_suppkey) c ON l_suppkey = s_suppkey""",
)
def source_versions(room: Newsroom) -> DataFrame:
    """Lines as change requests to suppliers; only a current version is applied."""
    stored = room.table("supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        (F.col("s_nationkey") % 5 + 1).alias("version"),
    )
    changes = room.table("lineitem").select(
        F.col("l_suppkey").alias("id"), F.concat(F.lit("Renamed "), "l_orderkey").alias("name"),
        F.col("l_linenumber").alias("expected_version"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("seq"),
    )
    return upsert.save_versions(stored, changes)[0].select("id", "name", "version")


@register(
    "alias_conflicts",
    sql.query(f"""
        SELECT alias_key, count(DISTINCT canonical_key) AS owners, min(canonical_key) AS first_owner,
            max(canonical_key) AS last_owner
        FROM (SELECT canonical_key, {sql.name_key('alias')} AS alias_key FROM (
            SELECT canonical_key, canonical_name AS alias FROM catalog
            UNION ALL SELECT canonical_key, unnest(aliases) FROM catalog))
        WHERE alias_key <> '' GROUP BY alias_key HAVING count(DISTINCT canonical_key) > 1"""),
)
def alias_conflicts(room: Newsroom) -> DataFrame:
    return catalog.alias_conflicts(room.catalog)


_CLUBS_SQL = f"""
    SELECT 'League ' || n_name AS league, c_custkey, name, second_name,
        'club:' || {sql.slug('name')} AS canonical_key
    FROM owners JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey"""


@register(
    "catalog_import",
    sql.query(f"""
        SELECT canonical_key, {sql.uuid5(settings.ENTITY_NAMESPACE, 'canonical_key')} AS id,
            arg_max(name, c_custkey) AS canonical_name, arg_max(league, c_custkey) AS league,
            arg_max(CASE WHEN second_name = '' OR lower(second_name) = lower(name) THEN name
                ELSE name || ',' || second_name END, c_custkey) AS aliases
        FROM ({_CLUBS_SQL}) GROUP BY canonical_key"""),
)
def catalog_import(room: Newsroom) -> DataFrame:
    """Catalog rows from customers as clubs, merged by key in two rounds."""
    owners = room._owners()
    nations = room.table("nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("League "), "n_name").alias("league")
    )
    clubs = (
        room.table("customer").select("c_custkey", "c_nationkey")
        .join(nations, "c_nationkey")
        .join(owners.select("c_custkey", "name", "second_name"), "c_custkey")
        .withColumn("key", identity.canonical_key(F.lit("CLUB"), F.col("name"), catalog=True))
        .groupBy("key")
        .agg(*[F.max_by(c, "c_custkey").alias(c) for c in ("league", "name", "second_name")])
        .select(
            "league", F.lit("2024").alias("season"), F.col("name").alias("club"),
            F.array(F.upper("name"), "second_name").alias("alias"),
        )
    )
    loaded = catalog.catalog_documents(clubs, source="customers", now=room.run_time)
    again = upsert.catalog(loaded, loaded)
    return again.select(
        "canonical_key", "id", "canonical_name", F.array_join("leagues", ",").alias("league"),
        F.array_join(F.transform("aliases", lambda a: a["value"]), ",").alias("aliases"),
    )


@register(
    "response_parse",
    r"""SELECT conv_id, turn, CASE role WHEN 'user' THEN left(trim(line, ' #'), 180)
            ELSE 'Turn ' || turn END AS title,
        sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_hash,
        CAST(NULL AS VARCHAR) AS problem
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1] AS line
        FROM conversations)""",
)
def response_parse(room: Newsroom) -> DataFrame:
    """Turns as responses: plain text, bare JSON, fenced JSON, JSON inside prose."""
    body = F.to_json(
        F.struct(F.concat(F.lit("Turn "), "turn").alias("title"), F.col("text").alias("content"))
    )
    kind = F.col("turn") % 3
    response = (
        F.when(F.col("role") == "user", F.col("text"))
        .when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
    )
    parsed = room.table("conversations").select(
        "conv_id", "turn", responses.parse_timeline_item(response).alias("item")
    )
    return parsed.select(
        "conv_id", "turn", "item.title", F.sha2("item.content", 256).alias("content_hash"),
        "item.problem",
    )


@register(
    "window_sequence",
    f"""SELECT user_id, unnest(generate_series({sql.floor3('min(ts)')}, max(ts) - INTERVAL 1 MICROSECOND,
            INTERVAL 3 HOURS)) AS window_start FROM events GROUP BY user_id""",
)
def window_sequence(room: Newsroom) -> DataFrame:
    """All windows between each user's first and last event."""
    ts = F.col("ts").cast("timestamp")
    spans = room.table("events").groupBy("user_id").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    return spans.select(
        "user_id",
        F.explode(windows.covering_starts(F.col("first"), F.col("last"))).alias("window_start"),
    )


# Mentions at volume: orders as articles, parts as entities, lines as mentions.
_VOLUME_TYPE = "CASE p_size % 4 WHEN 0 THEN 'PLAYER' WHEN 1 THEN 'CLUB' WHEN 2 THEN 'COACH' ELSE 'COMPETITION' END"


@register(
    "volume_top_entities",
    f"""WITH pairs AS (
        SELECT DISTINCT o_orderkey, o_orderdate, p_partkey, p_name, {_VOLUME_TYPE} AS entity_type
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
    counts AS (
        SELECT {sql.floor3('o_orderdate')} + to_hours(3 * i) AS window_end, p_partkey, p_name,
            entity_type, count(*) AS n
        FROM pairs, range(1, 9) r(i) GROUP BY ALL)
    SELECT window_end, entity_type, p_partkey AS entity_id, n AS mention_count, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY window_end, entity_type
            ORDER BY n DESC, p_name, p_partkey) AS rank FROM counts
        WHERE entity_type <> 'COMPETITION')
    WHERE rank <= CASE entity_type WHEN 'PLAYER' THEN 50 ELSE 30 END""",
)
def volume_top_entities(room: Newsroom) -> DataFrame:
    size = F.col("p_size") % 4
    kind = (
        F.when(size == 0, "PLAYER").when(size == 1, "CLUB").when(size == 2, "COACH")
        .otherwise("COMPETITION")
    )
    parts = room.table("part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"),
        kind.alias("entity_type"),
    )
    named = room.table("lineitem").select(
        F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id")
    ).join(parts, "entity_id")
    orders = room.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("crawl_date")
    )
    dated = ranking.dated_keys(named, orders)
    tops = ranking.top_per_type(
        ranking.sliding_counts(ranking.bucket_counts(dated)), by=["window_end"]
    )
    return tops.select(
        "window_end", "entity_type", "entity_id", "mention_count",
        F.col("rank").cast("bigint").alias("rank"),
    )
