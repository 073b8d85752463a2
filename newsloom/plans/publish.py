"""Publishing: summaries into the read model, and the popularity refresh."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import popularity as counts
from newsloom.operators import upsert


@dataclass(frozen=True)
class ReadModel:
    """The four read-model tables."""

    entities: DataFrame
    articles: DataFrame
    items: DataFrame
    item_articles: DataFrame


def pending(summaries: DataFrame, limit: int | None = None) -> DataFrame:
    """Completed, unpublished summaries; the first ``limit`` by window if given."""
    open_rows = summaries.filter((F.col("status") == "COMPLETED") & F.isnull("published_at"))
    if limit is None:
        return open_rows
    return open_rows.orderBy("window_start", "id").limit(limit)


def _sequence() -> Column:
    """Publication order of a summary."""
    return F.struct("window_start", F.col("id").alias("summary"))


def entity_changes(summaries: DataFrame, catalog: DataFrame, *, repeats: bool = False) -> DataFrame:
    """Entity rows of the summaries; with ``repeats`` an alias listed twice in the catalog stays twice."""
    known = catalog.select(
        F.col("id").alias("entity_id"), text.alias_values(F.col("aliases"), repeats=repeats).alias("aliases")
    )
    kind = F.coalesce("entity_type", F.lit("CLUB"))
    return summaries.join(known, "entity_id", "left").select(
        F.col("entity_id").alias("id"),
        text.entity_type(kind).alias("entity_type"),
        "canonical_name",
        text.public_slug(F.col("canonical_name")).alias("slug"),
        "aliases",
        F.col("window_end").alias("last_seen_at"),
        _sequence().alias("seq"),
    )


def article_positions(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        F.col("id").alias("item_id"),
        _sequence().alias("seq"),
        F.posexplode("article_ids").alias("position", "article_id"),
    )


def article_changes(
    positions: DataFrame, metadata: DataFrame, contents: DataFrame, now: Column
) -> DataFrame:
    """Read-model rows of the listed articles; ids without metadata give none."""
    wanted = positions.groupBy(F.col("article_id").alias("id")).agg(F.min("seq").alias("seq"))
    # The stored text is chosen before the join: one text moves, and only of the listed articles.
    stored = F.coalesce(text.present(F.col("filtered_content")), text.present(F.col("content")))
    texts = contents.select("id", stored.alias("stored_text"))
    joined = metadata.join(wanted, "id").join(texts, "id", "left")
    title = F.coalesce("title", F.lit("Untitled"))
    body = text.article_body(F.col("stored_text"), F.lit(None), F.col("description"), F.col("title"))
    return joined.select(
        "id",
        title.alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("canonical_url", "url", F.lit("")).alias("canonical_url"),
        F.coalesce("source_name", F.lit("Unknown")).alias("source_name"),
        F.coalesce("domain_name", F.lit("unknown.com")).alias("domain_name"),
        "description",
        "image_url",
        F.col("published_time").alias("published_at"),
        F.coalesce("crawl_date", now).alias("crawled_at"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        text.article_slug(title, F.col("id")).alias("slug"),
        body.alias("body"),
        text.excerpt(F.col("description"), body).alias("excerpt"),
        F.coalesce(text.present(F.col("language")), F.lit("en")).alias("language"),
        "seq",
    )


def item_changes(summaries: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Timeline items with their entity's surviving id."""
    survivors = entity_map.select(F.col("id").alias("entity_id"), F.col("entity_id").alias("survivor"))
    count = F.coalesce("article_count", F.size("article_ids"))
    return summaries.join(survivors, "entity_id", "left").select(
        "id",
        F.coalesce("survivor", "entity_id").alias("entity_id"),
        "window_start",
        "window_end",
        F.coalesce(text.present(F.col("short_description")), "canonical_name").alias("title"),
        F.coalesce("aggregated_news", F.lit("")).alias("summary"),
        F.greatest(F.lit(1), count).alias("article_count"),
        F.col("entities_50").alias("key_entities_50"),
        F.col("entities_80").alias("key_entities_80"),
        _sequence().alias("seq"),
    )


def publish(
    model: ReadModel,
    summaries: DataFrame,
    catalog: DataFrame,
    metadata: DataFrame,
    contents: DataFrame,
    now: Column,
    *,
    repeats: bool = False,
) -> ReadModel:
    """All given summaries at once; publishing them again changes nothing."""
    entities, entity_map = upsert.entities(model.entities, entity_changes(summaries, catalog, repeats=repeats))
    positions = article_positions(summaries)
    articles, article_map = upsert.source_articles(
        model.articles, article_changes(positions, metadata, contents, now)
    )
    items, item_map = upsert.timeline_items(model.items, item_changes(summaries, entity_map))
    links = (
        positions.join(item_map.withColumnRenamed("id", "item_id"), "item_id")
        .join(
            article_map.select(F.col("id").alias("article_id"), F.col("article_id").alias("stored")),
            "article_id",
        )
        .select("timeline_item_id", F.col("stored").alias("article_id"), "position", "seq")
    )
    return ReadModel(entities, articles, items, upsert.item_articles(model.item_articles, links))


def mark_published(summaries: DataFrame, published: DataFrame, now: Column) -> DataFrame:
    """Set ``published_at`` on the published summaries."""
    done = published.select("id", F.lit(True).alias("_done"))
    return (
        summaries.join(done, "id", "left")
        .withColumn("published_at", F.when(F.col("_done"), now).otherwise(F.col("published_at")))
        .drop("_done")
    )


def active_entities(
    metadata: DataFrame, mentions: DataFrame, catalog: DataFrame, now: datetime, *, repeats: bool = False
) -> DataFrame:
    """Popularity rows with slug and aliases, ready for the upsert."""
    known = catalog.select(
        F.col("id").alias("entity_id"), text.alias_values(F.col("aliases"), repeats=repeats).alias("aliases")
    )
    counted = counts.popularity(metadata, mentions, catalog, now)
    return counted.join(known, "entity_id", "left").select(
        F.col("entity_id").alias("id"),
        "entity_type",
        "canonical_name",
        text.public_slug(F.col("canonical_name")).alias("slug"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        "last_seen_at",
        "mention_count_24h",
    )


def refresh_popularity(
    model: ReadModel, metadata: DataFrame, mentions: DataFrame, catalog: DataFrame, now: datetime, *,
    repeats: bool = False,
) -> ReadModel:
    refreshed, _ = upsert.popularity(
        model.entities, active_entities(metadata, mentions, catalog, now, repeats=repeats)
    )
    return ReadModel(refreshed, model.articles, model.items, model.item_articles)


def publish_pending(
    model: ReadModel,
    summaries: DataFrame,
    catalog: DataFrame,
    metadata: DataFrame,
    contents: DataFrame,
    mentions: DataFrame,
    now: datetime,
    *,
    limit: int | None = None,
) -> tuple[ReadModel, DataFrame]:
    """Publish, refresh popularity, backfill; returns the model and the marked summaries."""
    moment = F.lit(now).cast("timestamp")
    chosen = pending(summaries, limit)
    published = publish(model, chosen, catalog, metadata, contents, moment)
    refreshed = refresh_popularity(published, metadata, mentions, catalog, now)
    filled = upsert.backfill_articles(refreshed.articles, metadata, contents)
    return (
        ReadModel(refreshed.entities, filled, refreshed.items, refreshed.item_articles),
        mark_published(summaries, chosen, moment),
    )
