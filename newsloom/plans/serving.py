"""Read-only queries over the read model, each returning a DataFrame.

Every page is a top-k over a filter; nested lists are built only for the rows of
the page, after the page was cut.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.identity import normalize_uuid
from newsloom.plans.publish import ReadModel


def entity_view(entities: DataFrame) -> DataFrame:
    """Serving shape of an entity; ``article_count`` repeats the popularity."""
    name = F.coalesce(text.present(F.col("canonical_name")), "name")
    return entities.select(
        "id",
        "entity_type",
        name.alias("canonical_name"),
        name.alias("name"),
        "slug",
        "aliases",
        "mention_count_24h",
        F.col("mention_count_24h").alias("article_count"),
        "last_seen_at",
    )


def _by_popularity(entities: DataFrame) -> DataFrame:
    return entities.orderBy(F.col("mention_count_24h").desc(), "canonical_name", "id")


def _like(column: Column, query: str) -> Column:
    return F.ilike(column, F.lit(f"%{query}%"))


def matches_entity(query: str, *, with_slug: bool) -> Column:
    """Name (and slug) contain the query, or an alias does, ignoring case.

    ``%`` and ``_`` in the query act as wildcards.
    """
    wanted = query.strip()
    found = (
        _like(F.col("canonical_name"), wanted)
        | F.array_contains("aliases", wanted)
        | F.exists("aliases", lambda a: _like(a, wanted))
    )
    return found | _like(F.col("slug"), wanted) if with_slug else found


def top_entities(entities: DataFrame, limit: int = 10) -> DataFrame:
    _check_limit(limit)
    return entity_view(_by_popularity(entities).limit(limit))


def search_entities(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    found = entities.filter(matches_entity(query, with_slug=True))
    return entity_view(_by_popularity(found).limit(limit))


def _directory(entities: DataFrame, entity_type: str | None, query: str | None) -> DataFrame:
    if entity_type:
        entities = entities.filter(F.col("entity_type") == entity_type.upper())
    if query and query.strip():
        entities = entities.filter(matches_entity(query, with_slug=False))
    return entities


def list_entities(
    entities: DataFrame,
    *,
    entity_type: str | None = None,
    query: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    _check_limit(limit)
    found = _directory(entities, entity_type, query)
    return entity_view(_by_popularity(found).offset(offset).limit(limit))


def count_entities(
    entities: DataFrame, *, entity_type: str | None = None, query: str | None = None
) -> DataFrame:
    return _directory(entities, entity_type, query).agg(F.count("*").alias("total"))


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    return entity_view(entities.filter(F.col("id") == entity_id))


def entity_by_slug(entities: DataFrame, entity_type: str, slug: str) -> DataFrame:
    wanted = (F.col("entity_type") == entity_type.strip().upper()) & (
        F.col("slug") == slug.strip().lower()
    )
    return entity_view(entities.filter(wanted).limit(1))


def find_entity(entities: DataFrame, entity_type: str, slug: str) -> DataFrame:
    """Client lookup: the directory searched by slug text, then by its words.

    The row must have exactly the slug; the slug-text search goes first. All
    matches count, however unpopular, so the slug is compared before anything is cut.
    """
    wanted = slug.lower()
    words = slug.replace("-", " ").strip()
    queries = [slug] if not words or words == slug else [slug, words]
    chosen = None
    for number, query in enumerate(queries):
        matches = _directory(entities.filter(F.lower("slug") == wanted), entity_type, query)
        hit = entity_view(matches).withColumn("_order", F.lit(number))
        chosen = hit if chosen is None else chosen.unionByName(hit)
    return chosen.orderBy("_order", "id").limit(1).drop("_order")


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")


def entity_timeline(
    model: ReadModel, entity_id: str, *, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of an entity's timeline, newest window first, with nested sources."""
    _check_limit(limit)
    page = (
        model.items.filter(F.col("entity_id") == entity_id)
        .orderBy(F.col("window_start").desc(), "id")
        .offset(offset)
        .limit(limit)
    )
    return timeline_view(page, model)


def timeline_view(items: DataFrame, model: ReadModel) -> DataFrame:
    """Items with their source articles in position order."""
    columns = [
        "title", "url", "canonical_url", "source_name", "domain_name", "description",
        "image_url", "published_at",
    ]
    links = model.item_articles.join(
        items.select(F.col("id").alias("timeline_item_id")), "timeline_item_id", "left_semi"
    )
    source = F.struct("position", F.col("article_id").alias("id"), *columns)
    nested = (
        links.join(model.articles.withColumnRenamed("id", "article_id"), "article_id")
        .select("timeline_item_id", source.alias("source"))
        .groupBy(F.col("timeline_item_id").alias("id"))
        .agg(F.array_sort(F.collect_list("source")).alias("source_articles"))
    )
    data = [c for c in items.columns if c not in ("id", "updated_at")]
    return items.join(nested, "id", "left").select(
        "id", *data, F.coalesce("source_articles", F.array()).alias("source_articles")
    )


def _article_filter(
    model: ReadModel, query: str | None, entity_type: str | None, entity_slug: str | None
) -> DataFrame:
    articles = model.articles
    if query and query.strip():
        wanted = query.strip()
        hit = [F.coalesce(_like(F.col(c), wanted), F.lit(False)) for c in ("title", "description", "body")]
        articles = articles.filter(hit[0] | hit[1] | hit[2])
    if entity_slug or entity_type:
        entities = model.entities
        if entity_slug and entity_slug.strip():
            entities = entities.filter(F.col("slug") == entity_slug.strip().lower())
        if entity_type and entity_type.strip():
            entities = entities.filter(F.col("entity_type") == entity_type.strip().upper())
        items = model.items.join(
            entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"
        ).select(F.col("id").alias("timeline_item_id"))
        listed = model.item_articles.join(items, "timeline_item_id", "left_semi").select(
            F.col("article_id").alias("id")
        )
        articles = articles.join(listed, "id", "left_semi")
    return articles


def article_entities(model: ReadModel, articles: DataFrame | None = None) -> DataFrame:
    """Distinct (article, entity) rows through the timeline items."""
    links = model.item_articles
    if articles is not None:
        links = links.join(
            articles.select(F.col("id").alias("article_id")), "article_id", "left_semi"
        )
    items = model.items.select(F.col("id").alias("timeline_item_id"), "entity_id")
    named = model.entities.select(
        F.col("id").alias("entity_id"), "entity_type", F.col("canonical_name").alias("name"), "slug"
    )
    pairs = links.join(items, "timeline_item_id").select("article_id", "entity_id").distinct()
    return pairs.join(named, "entity_id").select(
        "article_id", "entity_id", "entity_type", "name", "slug"
    )


def article_view(articles: DataFrame, model: ReadModel) -> DataFrame:
    """Serving shape of articles with their entities by name."""
    title = F.coalesce(text.present(F.col("title")), F.lit("Untitled"))
    body = F.coalesce(text.present(F.col("body")), text.present(F.col("description")), title)
    excerpt = F.coalesce(
        text.present(F.col("excerpt")), text.present(F.col("description")), F.left(body, F.lit(240))
    )
    entity = F.struct("name", F.col("entity_id").alias("id"), "entity_type", "slug")
    nested = (
        article_entities(model, articles)
        .select(F.col("article_id").alias("id"), entity.alias("entity"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    )
    return articles.join(nested, "id", "left").select(
        "id",
        F.coalesce(text.present(F.col("slug")), "id").alias("slug"),
        title.alias("title_en"),
        title.alias("title_vi"),
        excerpt.alias("excerpt_vi"),
        body.alias("body_en"),
        body.alias("body_vi"),
        F.lit(None).cast("string").alias("story_id"),
        F.coalesce("published_at", "crawled_at").alias("published_at"),
        F.coalesce("entities", F.array()).alias("entities"),
    )


def list_articles(
    model: ReadModel,
    *,
    query: str | None = None,
    entity_type: str | None = None,
    entity_slug: str | None = None,
    sort: str = "newest",
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    _check_limit(limit)
    found = _article_filter(model, query, entity_type, entity_slug)
    shown, key = F.coalesce("published_at", "crawled_at"), F.col("id")
    order = [shown.asc(), key.asc()] if sort == "oldest" else [shown.desc(), key.desc()]
    return article_view(found.orderBy(*order).offset(offset).limit(limit), model)


def count_articles(
    model: ReadModel,
    *,
    query: str | None = None,
    entity_type: str | None = None,
    entity_slug: str | None = None,
) -> DataFrame:
    return _article_filter(model, query, entity_type, entity_slug).agg(F.count("*").alias("total"))


def _article_row(articles: DataFrame, id_or_slug: str) -> DataFrame:
    """The article with this id, else with this slug."""
    as_id = normalize_uuid(F.lit(id_or_slug))
    by_id = F.coalesce(F.col("id") == as_id, F.lit(False))
    return (
        articles.filter(by_id | (F.col("slug") == id_or_slug)).orderBy(by_id.desc(), "id").limit(1)
    )


def article_by_id_or_slug(model: ReadModel, id_or_slug: str) -> DataFrame:
    return article_view(_article_row(model.articles, id_or_slug), model)


def source_view(articles: DataFrame) -> DataFrame:
    return articles.select(
        F.col("id").alias("source_id"),
        F.coalesce(text.present(F.col("source_name")), F.lit("Unknown")).alias("source_name"),
        F.coalesce(text.present(F.col("url")), "canonical_url").alias("source_url"),
        F.coalesce("published_at", "crawled_at").alias("published_at"),
        F.lit(1).alias("reliability_tier"),
    )


def article_sources(model: ReadModel, id_or_slug: str) -> DataFrame:
    return source_view(_article_row(model.articles, id_or_slug))


def trending_entities(
    article_entity_rows: DataFrame, *, entity_type: str | None = None, limit: int | None = 6
) -> DataFrame:
    """Entities of a set of articles by how many of them name each."""
    rows = article_entity_rows
    if entity_type:
        rows = rows.filter(F.col("entity_type") == entity_type.upper())
    counted = rows.groupBy(F.lower("entity_type").alias("type"), "slug").agg(
        F.count("*").alias("article_count"), F.max("name").alias("name")
    )
    if limit is None:
        return counted
    return counted.orderBy(F.col("article_count").desc(), "name", "type", "slug").limit(limit)


def list_sources(sources: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    _check_source_limit(limit)
    return sources.orderBy("created_at", "id").offset(offset).limit(limit)


def is_due(at: Column) -> Column:
    next_run = F.col("last_discovered_at") + F.make_dt_interval(mins=F.col("crawl_interval_minutes"))
    return F.col("enabled") & (F.isnull("last_discovered_at") | (next_run <= at))


def due_sources(sources: DataFrame, at: datetime, *, limit: int = 100) -> DataFrame:
    _check_source_limit(limit)
    due = sources.filter(is_due(F.lit(at)))
    return due.orderBy(F.col("last_discovered_at").asc_nulls_first(), "id").limit(limit)


def _check_source_limit(limit: int) -> None:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
