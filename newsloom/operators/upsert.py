"""Keyed upserts as set operations: old table and changes in, new table out.

Several changes for one key are applied in the order of their ``seq`` column,
which here means they are first folded to one change per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text


def last(column: str) -> Column:
    """Value of the latest change."""
    return F.max_by(column, "seq").alias(column)


def last_present(column: str) -> Column:
    """Latest value that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win; ``new`` holds one row per key. Old rows keep their columns."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is not stored; the old table is not rewritten."""
    return new.join(old.select(*keys), keys, "left_anti")


def merge(
    old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column]
) -> DataFrame:
    """Full outer merge; ``rules`` give each non-key column from ``old.x``/``new.x``.

    Columns without a rule keep the old value where the row existed and take the
    new one on insert.
    """
    condition = None
    for key in keys:
        equal = F.col(f"old.{key}") == F.col(f"new.{key}")
        condition = equal if condition is None else condition & equal
    existed = F.col("_in_old").isNotNull()
    changed = F.col("_in_new").isNotNull()
    joined = (
        old.withColumn("_in_old", F.lit(True)).alias("old")
        .join(new.withColumn("_in_new", F.lit(True)).alias("new"), condition, "full_outer")
    )
    columns = []
    for name in old.columns:
        before, after = F.col(f"old.{name}"), (
            F.col(f"new.{name}") if name in new.columns else F.lit(None)
        )
        if name in keys:
            value = F.coalesce(before, after)
        elif name in rules:
            value = (
                F.when(existed & changed, rules[name]).when(existed, before).otherwise(after)
            )
        else:
            value = F.when(existed, before).otherwise(after)
        columns.append(value.cast(old.schema[name].dataType).alias(name))
    return joined.select(*columns)


def entities(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert entities by id, else by (type, slug).

    ``changes``: id, entity_type, canonical_name, slug, aliases, last_seen_at,
    seq and optionally mention_count_24h; any number of rows per id. Returns the
    new table and a map ``id -> entity_id`` of the surviving id for every changed
    id, so that dependants never point to a row that lost the slug conflict.
    """
    counted = "mention_count_24h" in changes.columns
    filled = F.when(F.size("aliases") > 0, F.col("aliases"))
    staged = changes.withColumn("aliases", filled)
    folded = staged.groupBy("id").agg(
        last("entity_type"),
        last("canonical_name"),
        last("slug"),
        last_present("aliases"),
        F.max("last_seen_at").alias("last_seen_at"),
        *([last_present("mention_count_24h")] if counted else []),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("seq"),
    )
    known = folded.join(old.select("id", F.lit(True).alias("known")), "id", "left")
    by_id = known.filter("known").drop("known")
    rest = known.filter("known IS NULL").drop("known")

    # Slugs after the updates by id: an updated row may have given its slug up.
    holders = (
        old.select("id", "entity_type", "slug")
        .join(by_id.select("id"), "id", "left_anti")
        .unionByName(by_id.select("id", "entity_type", "slug"))
        .groupBy("entity_type", "slug")
        .agg(F.min("id").alias("holder"))
    )
    founders = rest.groupBy("entity_type", "slug").agg(F.min_by("id", "first_seq").alias("founder"))
    owners = founders.join(holders, ["entity_type", "slug"], "left").select(
        "entity_type", "slug", F.coalesce("holder", "founder").alias("entity_id")
    )
    placed = rest.join(owners, ["entity_type", "slug"])
    id_map = by_id.select("id", F.col("id").alias("entity_id")).unionByName(
        placed.select("id", "entity_id")
    )

    target = by_id.withColumn("entity_id", F.col("id")).unionByName(placed.select(*by_id.columns, "entity_id"))
    patch = target.groupBy(F.col("entity_id").alias("id")).agg(
        last("entity_type"),
        last("canonical_name"),
        last("slug"),
        last_present("aliases"),
        F.max("last_seen_at").alias("last_seen_at"),
        *([last_present("mention_count_24h")] if counted else []),
    )
    empty = F.array().cast("array<string>")
    new = patch.withColumn("name", F.col("canonical_name")).withColumn("_new_aliases", F.col("aliases"))
    new = new.withColumn("aliases", F.coalesce("aliases", empty)).withColumn(
        "mention_count_24h",
        F.coalesce("mention_count_24h", F.lit(0)) if counted else F.lit(0),
    )
    rules = {
        "entity_type": F.col("new.entity_type"),
        "name": F.col("new.canonical_name"),
        "canonical_name": F.col("new.canonical_name"),
        "slug": F.col("new.slug"),
        "aliases": F.coalesce("new._new_aliases", "old.aliases"),
        "last_seen_at": F.greatest("old.last_seen_at", "new.last_seen_at"),
    }
    if counted:
        rules["mention_count_24h"] = F.col("new.mention_count_24h")
    return merge(old, new, ["id"], rules), id_map


def source_articles(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert articles by canonical URL.

    Returns the new table and a map ``id -> article_id`` of the surviving ids.
    Text columns keep what is there where the change has nothing; the first slug
    stays; identity columns are never updated.
    """
    ordered = changes.withColumn("seq", F.struct("seq", "id"))
    folded = ordered.groupBy("canonical_url").agg(
        F.min_by("id", "seq").alias("id"),
        *[
            F.min_by(c, "seq").alias(c)
            for c in ("url", "source_name", "domain_name", "crawled_at", "content_hash")
        ],
        F.min_by("slug", "seq").alias("slug"),
        *[last(c) for c in ("title", "description", "image_url", "published_at")],
        *[last_present(c) for c in ("body", "excerpt", "language")],
    )
    rules = {
        "title": F.col("new.title"),
        "description": F.col("new.description"),
        "image_url": F.col("new.image_url"),
        "published_at": F.col("new.published_at"),
        "slug": F.coalesce("old.slug", "new.slug"),
        "body": F.coalesce("new.body", "old.body"),
        "excerpt": F.coalesce("new.excerpt", "old.excerpt"),
        "language": F.coalesce("new.language", "old.language"),
    }
    merged = merge(old, folded, ["canonical_url"], rules)
    survivors = merged.select("canonical_url", F.col("id").alias("article_id"))
    id_map = changes.select("id", "canonical_url").distinct().join(survivors, "canonical_url")
    return merged, id_map.select("id", "article_id")


def timeline_items(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert items by (entity, window); a stored item keeps its id.

    Returns the new table and a map ``id -> timeline_item_id``.
    """
    keys = ["entity_id", "window_start", "window_end"]
    data = ["title", "summary", "article_count", "key_entities_50", "key_entities_80"]
    folded = changes.groupBy(*keys).agg(
        F.min_by("id", "seq").alias("id"), *[last(c) for c in data]
    )
    merged = merge(old, folded, keys, {c: F.col(f"new.{c}") for c in data})
    survivors = merged.select(*keys, F.col("id").alias("timeline_item_id"))
    id_map = changes.select("id", *keys).distinct().join(survivors, keys)
    return merged, id_map.select("id", "timeline_item_id")


def item_articles(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert the item-article map; the position is replaced."""
    keys = ["timeline_item_id", "article_id"]
    folded = changes.groupBy(*keys).agg(last("position"))
    return merge(old, folded, keys, {"position": F.col("new.position")})


def popularity(old: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Popularity refresh: insert missing entities, set counts, reset the rest.

    ``active``: id, entity_type, canonical_name, slug, aliases, last_seen_at,
    mention_count_24h, one row per (id, name, type). An active id that lost its
    slug to a stored row is not inserted; it is returned in the second frame.
    """
    one = active.groupBy("id").agg(
        *[
            F.max_by(c, F.struct("mention_count_24h", "canonical_name", "entity_type")).alias(c)
            for c in ("entity_type", "canonical_name", "slug", "aliases")
        ],
        F.max("mention_count_24h").alias("mention_count_24h"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    missing = one.join(old.select("id"), "id", "left_anti")
    taken = old.select("entity_type", "slug").distinct()
    free = missing.join(taken, ["entity_type", "slug"], "left_anti")
    first = free.groupBy("entity_type", "slug").agg(F.min("id").alias("id"))
    refused = missing.join(first.select("id"), "id", "left_anti")
    live = one.join(refused.select("id"), "id", "left_anti").withColumn("name", F.col("canonical_name"))
    merged = merge(
        old,
        live.select(*[c for c in old.columns if c in live.columns]),
        ["id"],
        {
            "mention_count_24h": F.col("new.mention_count_24h"),
            "last_seen_at": F.greatest("old.last_seen_at", "new.last_seen_at"),
        },
    )
    in_play = live.select("id", F.lit(True).alias("_active"))
    reset = (
        merged.join(in_play, "id", "left")
        .withColumn(
            "mention_count_24h",
            F.when(F.col("_active"), F.col("mention_count_24h")).otherwise(0),
        )
        .drop("_active")
    )
    return reset, refused


def catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog import by canonical key: id and created_at are set on insert only."""
    updated = [c for c in old.columns if c not in ("id", "created_at", "canonical_key")]
    return merge(old, new, ["canonical_key"], {c: F.col(f"new.{c}") for c in updated})


def backfill_articles(
    old: DataFrame, metadata: DataFrame, contents: DataFrame
) -> DataFrame:
    """Fill missing slug, body, excerpt and language of stored articles."""
    gaps = old.filter(F.isnull("slug") | F.isnull("body") | F.isnull("excerpt"))
    meta = metadata.select(
        "id",
        F.col("description").alias("meta_description"),
        F.col("title").alias("meta_title"),
        F.col("language").alias("meta_language"),
    )
    texts = contents.select("id", "content", "filtered_content")
    joined = gaps.join(meta, "id", "left").join(texts, "id", "left")
    description = F.coalesce(text.present(F.col("meta_description")), "description")
    body = text.article_body(
        F.col("filtered_content"), F.col("content"), description, F.col("title")
    )
    title = F.coalesce(
        text.present(F.col("title")), F.col("meta_title"), F.lit("Untitled")
    )
    filled = joined.select(
        "id",
        F.coalesce("slug", text.article_slug(title, F.col("id"))).alias("slug"),
        F.coalesce("body", body).alias("body"),
        F.coalesce("excerpt", text.excerpt(description, body)).alias("excerpt"),
        F.coalesce("language", text.present(F.col("meta_language")), F.lit("en")).alias("language"),
    )
    return merge(
        old, filled, ["id"], {c: F.col(f"new.{c}") for c in ("slug", "body", "excerpt", "language")}
    )


def open_batches(old: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch per idempotency key: the stored one, else the first request's.

    Returns one row per requested key.
    """
    columns = requests.columns
    first = requests.groupBy("idempotency_key").agg(
        *[
            F.min_by(c, F.struct("started_at", "id")).alias(c)
            for c in columns
            if c != "idempotency_key"
        ]
    )
    stored = old.select(*columns).join(first.select("idempotency_key"), "idempotency_key", "left_semi")
    opened = first.join(old.select("idempotency_key"), "idempotency_key", "left_anti")
    return stored.select(*columns).unionByName(opened.select(*columns))


def save_versions(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply changes whose ``expected_version`` still holds; the rest conflict.

    One change per id can match a version; the first by ``seq`` wins. Returns the
    new table and the refused changes.
    """
    current = changes.join(
        old.select("id", F.col("version").alias("stored_version")), "id", "left"
    ).withColumn("holds", F.coalesce(F.col("stored_version") == F.col("expected_version"), F.lit(False)))
    winner = (
        current.filter("holds").groupBy("id").agg(F.min("seq").alias("seq"))
    )
    accepted = current.join(winner, ["id", "seq"], "left_semi")
    refused = current.join(winner, ["id", "seq"], "left_anti").select(*changes.columns)
    fields = [c for c in old.columns if c in changes.columns and c != "id"]
    new = accepted.select("id", *fields, (F.col("stored_version") + 1).alias("version"))
    rules = {c: F.col(f"new.{c}") for c in [*fields, "version"]}
    return merge(old, new, ["id"], rules), refused
