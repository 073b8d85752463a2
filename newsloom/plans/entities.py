"""Entity processing: rewrite, extract, threshold, resolve, replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.operators import aliases, articles, catalog, mentions

MODEL_NAME, MODEL_VERSION = "catalog-alias", "catalog-v1"


def catalog_rules(entities: DataFrame) -> DataFrame:
    """(alias, label) rules of the default extraction."""
    named = catalog.alias_rows(entities).filter(F.col("entity_type").isin(*settings.ENTITY_TYPES))
    return named.select("alias", F.col("entity_type").alias("label")).distinct()


def filtered_contents(contents: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, filtered_content) of all articles that have content."""
    rules = catalog.rewrite_rules(catalog.active(entities))
    usable = contents.filter(F.col("content").isNotNull()).select("id", "content")
    return aliases.rewrite_aliases(usable, rules).select("id", "filtered_content")


def extract_mentions(
    filtered: DataFrame, entities: DataFrame, extractor: mentions.EntityExtractor | None = None
) -> DataFrame:
    """Resolved mention rows (id, span, canonical id and name) above the threshold.

    Offsets refer to the rewritten text. Without an extractor the catalog's own
    names and aliases are found, however many there are.
    """
    known = catalog.active(entities)
    if extractor is None:
        spans = mentions.catalog_spans(filtered, catalog_rules(known))
    else:
        spans = mentions.extract_spans(filtered, extractor)
    return mentions.resolve(mentions.persistable(spans), known)


def news_entities(
    articles_in: DataFrame,
    found: DataFrame,
    contents: DataFrame,
    now: Column,
    *,
    model: tuple[str, str] = (MODEL_NAME, MODEL_VERSION),
) -> DataFrame:
    """One row per article; articles without content get an error marker."""
    span = F.struct(
        "start", "end", "label", "text", "score", "canonical_entity_id", "canonical_name"
    )
    # One article's own spans.
    grouped = found.groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    with_content = contents.filter(F.col("content").isNotNull()).select(
        "id", F.lit(True).alias("has_content")
    )
    rows = articles_in.select("id").join(with_content, "id", "left").join(grouped, "id", "left")
    return _entity_rows(rows, now, model)


def _entity_rows(rows: DataFrame, now: Column, model: tuple[str, str]) -> DataFrame:
    """``news_entities`` rows of (``id``, ``spans``, ``has_content``)."""
    return rows.select(
        "id",
        F.coalesce(
            F.transform(
                "spans",
                lambda s: F.struct(
                    *[s[c].alias(c) for c in ("label", "text", "score", "start", "end")],
                    s["canonical_entity_id"].alias("canonical_entity_id"),
                    s["canonical_name"].alias("canonical_name"),
                ),
            ),
            F.array(),
        ).alias("entities"),
        F.lit(model[0]).alias("model_name"),
        F.lit(model[1]).alias("model_version"),
        now.alias("processed_at"),
        F.when(F.col("has_content").isNull(), "article_content_not_found").alias("error"),
    )


def process(
    metadata: DataFrame,
    contents: DataFrame,
    entities: DataFrame,
    now: Column,
    *,
    extractor: mentions.EntityExtractor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(news_entities rows, filtered contents) for the given articles."""
    mine = contents.join(metadata.select("id"), "id", "left_semi")
    # Texts move once, to the ids that they belong to; ids and texts that come again count as often.
    ids = metadata.groupBy("id").agg(F.count("*").alias("copies"))
    texts = ids.join(mine.filter(F.col("content").isNotNull()).select("id", "content"), "id", "left")
    together = texts.repartition("id").sortWithinPartitions("id")
    rules = catalog.rewrite_rules(catalog.active(entities))
    rewritten = aliases.rewrite_aliases(together, rules, keep=("copies",), dealt=True)
    filtered = rewritten.filter(F.col("filtered_content").isNotNull()).select("id", "filtered_content")
    if extractor is not None:
        return news_entities(metadata, extract_mentions(filtered, entities, extractor), mine, now), filtered
    known = catalog.active(entities)
    found = mentions.catalog_mentions(rewritten, catalog_rules(known), known, keep=("copies",))
    copies = F.sequence(F.lit(1), F.col("copies") * F.greatest("texts", F.lit(1)))
    rows = found.select("id", "texts", "found", F.explode(copies)).select(
        "id", mentions.placed(F.col("found")).alias("spans"), F.when(F.col("texts") > 0, True).alias("has_content")
    )
    return _entity_rows(rows, now, (MODEL_NAME, MODEL_VERSION)), filtered


def process_backlog(
    metadata: DataFrame,
    contents: DataFrame,
    done: DataFrame,
    entities: DataFrame,
    now: Column,
    *,
    limit: int | None = None,
    extractor: mentions.EntityExtractor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """:func:`process` for articles without entities, newest first up to ``limit``."""
    return process(
        articles.backlog(metadata, done, limit), contents, entities, now, extractor=extractor
    )


def reprocess_totals(found: DataFrame, contents: DataFrame) -> DataFrame:
    """Documents, entities and entities per document of a full reprocess."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    documents = contents.filter(F.col("content").isNotNull()).select(
        one.alias("documents"), none.alias("entities")
    )
    counted = documents.unionByName(found.select(none.alias("documents"), one.alias("entities")))
    return counted.agg(
        F.sum("documents").alias("documents"), F.sum("entities").alias("entities")
    ).withColumn(
        "entities_per_document", F.col("entities") / F.nullif("documents", F.lit(0))
    )
