"""The entity catalog: alias lookup, rewrite rules and alias conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import identity, text


def active(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("status") == "ACTIVE")


def alias_rows(entities: DataFrame) -> DataFrame:
    """One row per name and alias: owner columns, ``alias`` and its ``ordinal``.

    The canonical name comes first (ordinal 0), then the aliases in order.
    """
    name = F.trim("canonical_name")
    values = F.concat(F.array(name), F.transform("aliases", lambda a: F.trim(a["value"])))
    return entities.select(
        "id",
        F.coalesce("canonical_key", "id").alias("canonical_key"),
        F.upper(F.coalesce("entity_type", F.lit("CLUB"))).alias("entity_type"),
        name.alias("canonical_name"),
        F.posexplode(values).alias("ordinal", "alias"),
    ).filter(F.col("alias") != "")


def _last(columns: list[str], order: list[Column]) -> list[Column]:
    key = F.struct(*order)
    return [F.max_by(c, key).alias(c) for c in columns]


def lookup(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by label and name key, by name key), each key once.

    When two entities claim one key the last by canonical key wins, as it would
    when loading the catalog in that order.
    """
    names = alias_rows(entities).withColumn("name_key", text.name_key(F.col("alias")))
    order = [F.col("canonical_key"), F.col("ordinal")]
    columns = ["id", "canonical_name"]
    by_label = names.groupBy(F.col("entity_type").alias("label"), "name_key").agg(
        *_last(columns, order)
    )
    by_any = names.groupBy("name_key").agg(*_last(columns, order))
    return by_label, by_any


def rewrite_rules(entities: DataFrame) -> DataFrame:
    """Aliases that differ from their canonical name, each once (last owner wins)."""
    rules = alias_rows(entities).withColumn("folded", text.casefold(F.col("alias")))
    order = [F.col("canonical_key"), F.col("ordinal")]
    return (
        rules.filter(
            (F.col("ordinal") > 0) & (F.col("folded") != text.casefold(F.col("canonical_name")))
        )
        .groupBy("folded")
        .agg(*_last(["alias", "canonical_name"], order))
        .select("alias", "canonical_name")
    )


def alias_conflicts(entities: DataFrame) -> DataFrame:
    """Normalised aliases claimed by more than one canonical key."""
    names = alias_rows(entities).select(
        text.name_key(F.col("alias")).alias("alias_key"), "canonical_key"
    )
    owners = names.filter(F.col("alias_key") != "").groupBy("alias_key").agg(
        F.countDistinct("canonical_key").alias("owners"),
        F.min("canonical_key").alias("first_owner"),
        F.max("canonical_key").alias("last_owner"),
    )
    return owners.filter(F.col("owners") > 1)


def catalog_documents(
    clubs: DataFrame, *, source: str, now: Column, entity_type: str = "CLUB"
) -> DataFrame:
    """Catalog rows from ``league, season, club, alias`` rows.

    ``alias`` is the array of raw aliases. Each normalised alias stays once, in
    order, with the club name first.
    """
    name = text.strip(F.col("club"))
    raw = F.concat(F.array(name), F.coalesce("alias", F.array().cast("array<string>")))
    flat = clubs.select(
        "league",
        "season",
        name.alias("canonical_name"),
        F.posexplode(raw).alias("ordinal", "raw_alias"),
    ).select(
        "league",
        "season",
        "canonical_name",
        "ordinal",
        text.strip(F.col("raw_alias")).alias("value"),
        text.name_key(F.col("raw_alias")).alias("normalized_value"),
    )
    first = Window.partitionBy("league", "season", "canonical_name", "normalized_value").orderBy(
        "ordinal"
    )
    kept = flat.filter(F.col("normalized_value") != "").withColumn(
        "rank", F.row_number().over(first)
    )
    entry = F.struct("ordinal", "value", "normalized_value")
    # One club's alias list: bounded by its own catalog row.
    grouped = (
        kept.filter("rank = 1")
        .groupBy("league", "season", "canonical_name")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    key = identity.canonical_key(F.lit(entity_type), F.col("canonical_name"), catalog=True)
    return grouped.select(
        identity.entity_id(key).alias("id"),
        F.lit(entity_type).alias("entity_type"),
        key.alias("canonical_key"),
        "canonical_name",
        text.name_key(F.col("canonical_name")).alias("canonical_name_normalized"),
        F.array("league").alias("leagues"),
        F.array("season").alias("seasons"),
        F.transform(
            "entries",
            lambda e: F.struct(
                e["value"].alias("value"),
                e["normalized_value"].alias("normalized_value"),
                F.lit(False).alias("case_sensitive"),
            ),
        ).alias("aliases"),
        F.transform("entries", lambda e: e["normalized_value"]).alias("alias_values_normalized"),
        F.lit("ACTIVE").alias("status"),
        F.lit(source).alias("source"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
