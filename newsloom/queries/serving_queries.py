"""Serving queries over the published read model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans import serving
from newsloom.queries import sql
from newsloom.queries.bindings import NOW, Newsroom
from newsloom.queries.registry import register

# Ids inside the queries are looked up by a rule, the same on both sides: the
# most popular entity, and the newest article.
_TOP_ENTITY = """(SELECT id FROM entities ORDER BY mention_count_24h DESC, canonical_name, id LIMIT 1)"""
_NEWEST = """(SELECT id FROM source_articles ORDER BY coalesce(published_at, crawled_at) DESC, id DESC LIMIT 1)"""

_ENTITY_COLUMNS = """id, entity_type, canonical_name, canonical_name AS name, slug,
    array_to_string(aliases, ',') AS aliases, mention_count_24h,
    mention_count_24h AS article_count, last_seen_at"""
_POPULAR = "ORDER BY mention_count_24h DESC, canonical_name, id"
_ENTITY_MATCH = """(canonical_name ILIKE '%{0}%' OR list_contains(aliases, '{0}')
    OR len(list_filter(aliases, lambda a: a ILIKE '%{0}%')) > 0)"""


def _entities(frame: DataFrame) -> DataFrame:
    return frame.select(
        "id", "entity_type", "canonical_name", "name", "slug",
        F.array_join("aliases", ",").alias("aliases"),
        F.col("mention_count_24h").cast("bigint").alias("mention_count_24h"),
        F.col("article_count").cast("bigint").alias("article_count"), "last_seen_at",
    )


def _top_entity(room: Newsroom) -> str:
    return serving.top_entities(room.model.entities, 1).first()["id"]


def _newest_article(room: Newsroom) -> DataFrame:
    shown = F.coalesce("published_at", "crawled_at")
    return room.model.articles.orderBy(shown.desc(), F.col("id").desc()).limit(1)


@register("top_entities", sql.query(f"SELECT {_ENTITY_COLUMNS} FROM entities {_POPULAR} LIMIT 10"))
def top_entities(room: Newsroom) -> DataFrame:
    return _entities(serving.top_entities(room.model.entities))


@register(
    "entity_search",
    sql.query(f"""SELECT {_ENTITY_COLUMNS} FROM entities
        WHERE {_ENTITY_MATCH.format("th")} OR slug ILIKE '%th%' {_POPULAR} LIMIT 20"""),
)
def entity_search(room: Newsroom) -> DataFrame:
    return _entities(serving.search_entities(room.model.entities, " th "))


@register(
    "entity_search_wildcard",
    sql.query(f"""SELECT {_ENTITY_COLUMNS} FROM entities
        WHERE {_ENTITY_MATCH.format("e_e%n")} OR slug ILIKE '%e_e%n%' {_POPULAR} LIMIT 20"""),
)
def entity_search_wildcard(room: Newsroom) -> DataFrame:
    return _entities(serving.search_entities(room.model.entities, "e_e%n"))


@register(
    "entity_directory",
    sql.query(f"""SELECT {_ENTITY_COLUMNS} FROM entities WHERE entity_type = 'PLAYER'
        AND {_ENTITY_MATCH.format("e")} {_POPULAR} LIMIT 20 OFFSET 5"""),
)
def entity_directory(room: Newsroom) -> DataFrame:
    return _entities(
        serving.list_entities(
            room.model.entities, entity_type="player", query="e", limit=20, offset=5
        )
    )


@register(
    "entity_directory_total",
    sql.query(f"""SELECT count(*) AS total FROM entities WHERE entity_type = 'PLAYER'
        AND {_ENTITY_MATCH.format("e")}"""),
)
def entity_directory_total(room: Newsroom) -> DataFrame:
    return serving.count_entities(room.model.entities, entity_type="player", query="e")


@register(
    "entity_by_id",
    sql.query(f"SELECT {_ENTITY_COLUMNS} FROM entities WHERE id = {_TOP_ENTITY}"),
)
def entity_by_id(room: Newsroom) -> DataFrame:
    return _entities(serving.entity_by_id(room.model.entities, _top_entity(room)))


@register(
    "entity_by_slug",
    sql.query(f"""SELECT {_ENTITY_COLUMNS} FROM entities WHERE (entity_type, slug) IN (
        SELECT (entity_type, slug) FROM entities WHERE id = {_TOP_ENTITY})"""),
)
def entity_by_slug(room: Newsroom) -> DataFrame:
    row = serving.top_entities(room.model.entities, 1).first()
    return _entities(
        serving.entity_by_slug(
            room.model.entities, row["entity_type"].lower(), f" {row['slug'].upper()} "
        )
    )


@register(
    "entity_client_lookup",
    sql.query(f"""SELECT {_ENTITY_COLUMNS} FROM entities WHERE id = {_TOP_ENTITY}
        AND (canonical_name ILIKE '%' || slug || '%'
            OR len(list_filter(aliases, lambda a: a ILIKE '%' || slug || '%')) > 0)"""),
)
def entity_client_lookup(room: Newsroom) -> DataFrame:
    """Found only where the name or an alias spells the slug: an accent hides it."""
    row = serving.top_entities(room.model.entities, 1).first()
    return _entities(serving.find_entity(room.model.entities, row["entity_type"], row["slug"]))


def _source_text(prefix: str) -> str:
    return f"{prefix}id || '|' || {prefix}title || '|' || {prefix}url || '|' || {prefix}source_name"


_ITEM_SQL = """
    SELECT i.id, i.entity_id, i.window_start, i.window_end, i.title, i.summary, i.article_count,
        coalesce(s.sources, '') AS sources
    FROM ({items}) i LEFT JOIN (
        SELECT l.timeline_item_id, string_agg({source}, chr(10) ORDER BY l.position, a.id) AS sources
        FROM item_links l JOIN source_articles a ON a.id = l.article_id
        GROUP BY l.timeline_item_id) s ON s.timeline_item_id = i.id"""


def _item_sql(items: str) -> str:
    return sql.query(_ITEM_SQL.format(items=items, source=_source_text("a.")))


def _items(frame: DataFrame) -> DataFrame:
    source = lambda s: F.concat_ws("|", s["id"], s["title"], s["url"], s["source_name"])
    return frame.select(
        "id", "entity_id", "window_start", "window_end", "title", "summary",
        F.col("article_count").cast("bigint").alias("article_count"),
        F.array_join(F.transform("source_articles", source), "\n").alias("sources"),
    )


@register(
    "entity_timeline",
    _item_sql(f"""SELECT * FROM items WHERE entity_id = {_TOP_ENTITY}
        ORDER BY window_start DESC, id LIMIT 50 OFFSET 2"""),
)
def entity_timeline(room: Newsroom) -> DataFrame:
    return _items(serving.entity_timeline(room.model, _top_entity(room), offset=2))


@register("all_timelines", _item_sql("SELECT * FROM items"))
def all_timelines(room: Newsroom) -> DataFrame:
    return _items(serving.timeline_view(room.model.items, room.model))


_ARTICLE_SQL = """
    SELECT a.id, coalesce(nullif(a.slug, ''), a.id) AS slug, a.title AS title_en, a.title AS title_vi,
        coalesce(nullif(a.excerpt, ''), nullif(a.description, ''), left(a.body, 240)) AS excerpt_vi,
        sha256(a.body) AS body_hash, coalesce(a.published_at, a.crawled_at) AS published_at,
        coalesce(n.entities, '') AS entities
    FROM ({articles}) a LEFT JOIN (
        SELECT article_id, string_agg(name || '|' || entity_id || '|' || entity_type || '|' || slug,
            ',' ORDER BY name, entity_id) AS entities
        FROM ({entities}) GROUP BY article_id) n ON n.article_id = a.id"""
_ARTICLE_ENTITIES = """SELECT DISTINCT l.article_id, e.id AS entity_id, e.entity_type,
    e.canonical_name AS name, e.slug
    FROM item_links l JOIN entities e ON e.id = l.entity_id"""


def _article_sql(articles: str) -> str:
    return sql.query(_ARTICLE_SQL.format(articles=articles, entities=_ARTICLE_ENTITIES))


def _articles(frame: DataFrame) -> DataFrame:
    entity = lambda e: F.concat_ws("|", e["name"], e["id"], e["entity_type"], e["slug"])
    return frame.select(
        "id", "slug", "title_en", "title_vi", "excerpt_vi",
        F.sha2("body_en", 256).alias("body_hash"), "published_at",
        F.array_join(F.transform("entities", entity), ",").alias("entities"),
    )


_SHOWN = "coalesce(published_at, crawled_at)"


@register(
    "article_list",
    _article_sql(f"SELECT * FROM source_articles ORDER BY {_SHOWN} DESC, id DESC LIMIT 20 OFFSET 10"),
)
def article_list(room: Newsroom) -> DataFrame:
    return _articles(serving.list_articles(room.model, offset=10))


_ARTICLE_MATCH = """(title ILIKE '%{0}%' OR coalesce(description ILIKE '%{0}%', false)
    OR coalesce(body ILIKE '%{0}%', false))"""


@register(
    "article_search_oldest",
    _article_sql(f"""SELECT * FROM source_articles WHERE {_ARTICLE_MATCH.format("tion the")}
        ORDER BY {_SHOWN}, id LIMIT 20"""),
)
def article_search_oldest(room: Newsroom) -> DataFrame:
    return _articles(serving.list_articles(room.model, query="tion the", sort="oldest"))


@register(
    "article_search_total",
    sql.query(f"""SELECT count(*) AS total FROM source_articles
        WHERE {_ARTICLE_MATCH.format("tion the")}"""),
)
def article_search_total(room: Newsroom) -> DataFrame:
    return serving.count_articles(room.model, query="tion the")


def _listed(condition: str) -> str:
    return f"""SELECT * FROM source_articles WHERE id IN (
        SELECT l.article_id FROM item_links l JOIN entities e ON e.id = l.entity_id WHERE {condition})"""


_ENTITY_CONDITION = f"""(e.entity_type, e.slug) IN (
    SELECT (entity_type, slug) FROM entities WHERE id = {_TOP_ENTITY})"""


@register(
    "article_list_by_entity",
    _article_sql(f"{_listed(_ENTITY_CONDITION)} ORDER BY {_SHOWN} DESC, id DESC LIMIT 20"),
)
def article_list_by_entity(room: Newsroom) -> DataFrame:
    row = serving.top_entities(room.model.entities, 1).first()
    return _articles(
        serving.list_articles(
            room.model, entity_type=row["entity_type"].lower(), entity_slug=row["slug"]
        )
    )


@register(
    "article_count_by_type",
    sql.query(f"""SELECT count(*) AS total FROM ({_listed("e.entity_type = 'COACH'")})"""),
)
def article_count_by_type(room: Newsroom) -> DataFrame:
    return serving.count_articles(room.model, entity_type="coach")


@register(
    "article_detail", _article_sql(f"SELECT * FROM source_articles WHERE id = {_NEWEST}")
)
def article_detail(room: Newsroom) -> DataFrame:
    row = _newest_article(room).first()
    return _articles(serving.article_by_id_or_slug(room.model, row["id"].upper()))


@register(
    "article_detail_by_slug", _article_sql(f"SELECT * FROM source_articles WHERE id = {_NEWEST}")
)
def article_detail_by_slug(room: Newsroom) -> DataFrame:
    row = _newest_article(room).first()
    return _articles(serving.article_by_id_or_slug(room.model, row["slug"]))


_SOURCE_SQL = """SELECT id AS source_id, source_name, url AS source_url,
    coalesce(published_at, crawled_at) AS published_at, 1 AS reliability_tier FROM source_articles"""


@register("article_sources", sql.query(f"{_SOURCE_SQL} WHERE id = {_NEWEST}"))
def article_sources(room: Newsroom) -> DataFrame:
    return serving.article_sources(room.model, _newest_article(room).first()["id"])


@register("all_article_sources", sql.query(_SOURCE_SQL))
def all_article_sources(room: Newsroom) -> DataFrame:
    return serving.source_view(room.model.articles)


@register("article_entities", sql.query(_ARTICLE_ENTITIES))
def article_entities(room: Newsroom) -> DataFrame:
    return serving.article_entities(room.model)


@register("all_articles_served", _article_sql("SELECT * FROM source_articles"))
def all_articles_served(room: Newsroom) -> DataFrame:
    return _articles(serving.article_view(room.model.articles, room.model))


@register(
    "trending_entities",
    sql.query(f"""SELECT lower(entity_type) AS type, slug, max(name) AS name,
        count(*) AS article_count FROM ({_ARTICLE_ENTITIES}) GROUP BY ALL
        ORDER BY article_count DESC, name, type, slug LIMIT 6"""),
)
def trending_entities(room: Newsroom) -> DataFrame:
    return serving.trending_entities(serving.article_entities(room.model)).select(
        "type", "slug", "name", "article_count"
    )


@register(
    "trending_clubs",
    sql.query(f"""SELECT lower(entity_type) AS type, slug, max(name) AS name,
        count(*) AS article_count FROM ({_ARTICLE_ENTITIES}) WHERE entity_type = 'CLUB'
        GROUP BY ALL"""),
)
def trending_clubs(room: Newsroom) -> DataFrame:
    rows = serving.article_entities(room.model)
    return serving.trending_entities(rows, entity_type="club", limit=None).select(
        "type", "slug", "name", "article_count"
    )


# Sources: one per supplier; the account balance sets the interval.
_SOURCES_SQL = """
    SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AS enabled,
        CAST(abs(s_acctbal) AS INTEGER) + 15 AS crawl_interval_minutes,
        CASE WHEN s_nationkey > 3 THEN TIMESTAMP '2024-01-20 07:45:00'
            - to_minutes(s_suppkey * 97 % 9000) END AS last_discovered_at,
        TIMESTAMP '2023-01-01' + to_hours(s_nationkey) AS created_at
    FROM supplier"""


def sources(room: Newsroom) -> DataFrame:
    start = F.lit("2023-01-01 00:00:00").cast("timestamp")
    minutes = F.col("s_suppkey") * 97 % 9000
    return room.table("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        (F.bround(F.abs("s_acctbal"), 0).cast("int") + 15).alias("crawl_interval_minutes"),
        F.when(
            F.col("s_nationkey") > 3,
            F.timestamp_seconds(F.unix_seconds(F.lit(NOW)) - minutes * 60),
        ).alias("last_discovered_at"),
        F.timestamp_seconds(F.unix_seconds(start) + F.col("s_nationkey") * 3600).alias("created_at"),
    )


@register(
    "due_sources",
    f"""SELECT id, name, last_discovered_at FROM ({_SOURCES_SQL})
    WHERE enabled AND (last_discovered_at IS NULL
        OR last_discovered_at + to_minutes(crawl_interval_minutes) <= TIMESTAMP '2024-01-20 07:45:00')
    ORDER BY last_discovered_at ASC NULLS FIRST, id LIMIT 100""",
)
def due_sources(room: Newsroom) -> DataFrame:
    return serving.due_sources(sources(room), NOW).select("id", "name", "last_discovered_at")


@register(
    "source_list",
    f"SELECT id, name, created_at FROM ({_SOURCES_SQL}) ORDER BY created_at, id LIMIT 100 OFFSET 3",
)
def source_list(room: Newsroom) -> DataFrame:
    return serving.list_sources(sources(room), offset=3).select("id", "name", "created_at")


