"""Data-quality jobs: each adds a ``problems`` array or lists offending keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import schemas, settings
from newsloom.functions import urls
from newsloom.functions.identity import UUID_PATTERN

# Artifact limits.
CONTENT_TYPES = ("text/html", "application/xhtml+xml")
EXTRACTORS = ("TRAFILATURA", "BEAUTIFULSOUP")
MAX_CONTENT_BYTES = 5_000_000
MAX_ETAG, MAX_LAST_MODIFIED = 512, 128
MAX_TITLE, MAX_TEXT = 512, 1_000_000
MAX_DIAGNOSTICS, MAX_DIAGNOSTIC_LENGTH = 10, 200

# Batch and source rules.
TERMINAL_STATUSES = ("COMPLETED", "PARTIAL", "FAILED")


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that are true; a null outcome is not a problem."""
    named = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return F.filter(named, lambda n: n.isNotNull())


def _one_of(column: Column, *values: str) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """Check stored artifacts against their metadata and projection.

    Columns: id, content (binary), content_type, etag, last_modified,
    content_length, content_sha256, title, cleaned_text, status, extractor,
    diagnostics.
    """
    c = F.col
    failed = c("status") == "FAILED"
    # octet_length, not the array size, so that content stays a flat binary.
    size = F.octet_length("content")
    rules = {
        "empty_content": F.coalesce(size, F.lit(0)) == 0,
        "content_too_large": size > MAX_CONTENT_BYTES,
        "content_type": ~_one_of(c("content_type"), *CONTENT_TYPES),
        "etag_too_long": F.length("etag") > MAX_ETAG,
        "last_modified_too_long": F.length("last_modified") > MAX_LAST_MODIFIED,
        "length_mismatch": ~c("content_length").eqNullSafe(size),
        "hash_mismatch": ~c("content_sha256").eqNullSafe(F.sha2("content", 256)),
        "status": ~_one_of(c("status"), "SUCCESS", "PARTIAL", "FAILED"),
        "title_length": ~F.length("title").between(1, MAX_TITLE),
        "text_length": ~F.length("cleaned_text").between(1, MAX_TEXT),
        "diagnostics": c("diagnostics").isNull()
        | (F.size("diagnostics") > MAX_DIAGNOSTICS)
        | F.exists("diagnostics", lambda d: ~F.length(d).between(1, MAX_DIAGNOSTIC_LENGTH)),
        "failed_with_content": failed
        & (c("title").isNotNull() | c("cleaned_text").isNotNull() | c("extractor").isNotNull()),
        "failed_without_diagnostics": failed & (F.size("diagnostics") == 0),
        "incomplete_projection": ~failed
        & (
            c("title").isNull()
            | c("cleaned_text").isNull()
            | ~_one_of(c("extractor"), *EXTRACTORS)
        ),
    }
    return artifacts.withColumn("problems", problems(rules))


def artifact_conflicts(artifacts: DataFrame) -> DataFrame:
    """Ids stored with different evidence: content, headers or projection differ."""
    evidence = F.sha2(
        F.to_json(
            F.struct(
                F.sha2("content", 256).alias("content"),
                "content_type",
                "etag",
                "last_modified",
                "title",
                "cleaned_text",
                "status",
                "extractor",
                "diagnostics",
            )
        ),
        256,
    )
    return (
        artifacts.select("id", evidence.alias("evidence"))
        .groupBy("id")
        .agg(F.countDistinct("evidence").alias("versions"))
        .filter(F.col("versions") > 1)
    )


def _uuid(column: Column) -> Column:
    return F.coalesce(F.lower(column).rlike(UUID_PATTERN), F.lit(False))


def _aware_time(column: Column) -> Column:
    """ISO time with a zone that is a real time."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})$"
    return column.rlike(shape) & F.try_to_timestamp(column).isNotNull()


def _text(column: Column, longest: int, pattern: str | None = None) -> Column:
    fits = F.length(column).between(1, longest)
    return F.coalesce(fits & column.rlike(pattern) if pattern else fits, F.lit(False))


def event_problems(raw: Column) -> tuple[Column, Column]:
    """(parsed event, problems) of a JSON pointer event."""
    event = F.from_json(raw, schemas.CRAWLED_EVENT)
    payload = event["payload"]
    keys = F.json_object_keys(raw)
    payload_keys = F.json_object_keys(F.get_json_object(raw, "$.payload"))
    names = schemas.CRAWLED_EVENT_FIELDS
    payload_names = schemas.CRAWLED_PAYLOAD_FIELDS

    def listed(fields: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(f) for f in fields])

    rules = {
        "not_json": keys.isNull(),
        "missing_field": (F.size(F.array_except(listed(names), keys)) > 0)
        | (F.size(F.array_except(listed(payload_names), payload_keys)) > 0)
        | (keys.isNotNull() & payload_keys.isNull()),
        "unknown_field": (F.size(F.array_except(keys, listed(names))) > 0)
        | (F.size(F.array_except(payload_keys, listed(payload_names))) > 0),
        "event_id": ~_uuid(event["event_id"]),
        "event_type": ~_one_of(event["event_type"], settings.CRAWLED_EVENT),
        "event_version": ~event["event_version"].eqNullSafe(1),
        "occurred_at": ~F.coalesce(_aware_time(event["occurred_at"]), F.lit(False)),
        "producer": ~_one_of(event["producer"], settings.CRAWLED_PRODUCER),
        "correlation_id": ~_uuid(event["correlation_id"]),
        "causation_id": event["causation_id"].isNotNull() & ~_uuid(event["causation_id"]),
        "aggregate_type": ~_one_of(event["aggregate_type"], settings.CRAWLED_AGGREGATE),
        "aggregate_id": ~_uuid(event["aggregate_id"]),
        "idempotency_key": ~_text(event["idempotency_key"], 256),
        "article_id": ~_uuid(payload["article_id"]),
        "canonical_url": ~_text(payload["canonical_url"], 2083, r"^(?i:https?)://[^/?#\s]+"),
        "source_name": ~_text(payload["source_name"], 200),
        "published_time": payload["published_time"].isNotNull()
        & ~_aware_time(payload["published_time"]),
        "aggregate_mismatch": F.lower(event["aggregate_id"]) != F.lower(payload["article_id"]),
    }
    return event, problems(rules)


def check_events(df: DataFrame, column: str = "value") -> DataFrame:
    event, found = event_problems(F.col(column))
    return df.withColumn("event", event).withColumn("problems", found)


def batch_problems(batches: DataFrame) -> DataFrame:
    """Completion rules of crawl batches."""
    counts = [F.col(c) for c in ("discovered_count", "fetched_count", "failed_count")]
    rules = {
        "not_terminal": ~_one_of(F.col("status"), *TERMINAL_STATUSES),
        "negative_count": F.least(*counts) < 0,
        "too_many_outcomes": counts[1] + counts[2] > counts[0],
    }
    return batches.withColumn("problems", problems(rules))


def source_problems(sources: DataFrame) -> DataFrame:
    """Configuration rules of sources."""
    name_length = F.length(F.trim("name"))
    normalized = F.transform("allowed_domains", lambda d: urls.normalize_domain(d))
    parts = urls.url_parts(F.col("rss_url"))
    host = urls.normalize_domain(parts["host"])
    rules = {
        "name": ~F.coalesce(name_length.between(1, 200), F.lit(False)),
        "no_domains": F.coalesce(F.size("allowed_domains"), F.lit(0)) <= 0,
        "domain": F.exists(normalized, lambda d: d.isNull()),
        "feed_url": parts["scheme"].isNull() | parts["credentials"] | host.isNull(),
        "feed_host_not_allowed": ~urls.host_is_allowed(host, normalized),
        "source_type": ~_one_of(F.col("source_type"), "RSS", "SITEMAP", "HTML"),
        "reliability_tier": ~F.col("reliability_tier").between(1, 5),
        "crawl_interval": F.col("crawl_interval_minutes") <= 0,
        "max_concurrency": F.col("max_concurrency") <= 0,
    }
    return sources.withColumn("problems", problems(rules))


def duplicate_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Violations of a unique key: one row per repeated key."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return (
        df.filter(complete)
        .groupBy(*keys)
        .count()
        .filter("count > 1")
        .select(
            F.lit(table).alias("table_name"),
            F.lit("unique(" + ",".join(keys) + ")").alias("rule"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.col("count").alias("rows"),
        )
    )


def orphans(child: DataFrame, table: str, key: str, parent: DataFrame) -> DataFrame:
    """Violations of a foreign key: one row per missing parent."""
    return (
        child.join(parent.select(F.col("id").alias(key)), key, "left_anti")
        .groupBy(key)
        .count()
        .select(
            F.lit(table).alias("table_name"),
            F.lit(f"foreign({key})").alias("rule"),
            F.col(key).alias("key"),
            F.col("count").alias("rows"),
        )
    )


def bad_values(df: DataFrame, table: str, rule: str, broken: Column, key: str = "id") -> DataFrame:
    return df.filter(broken).select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.col(key).alias("key"),
        F.lit(1).cast("bigint").alias("rows"),
    )


def constraint_violations(
    entities: DataFrame, articles: DataFrame, items: DataFrame, item_articles: DataFrame
) -> DataFrame:
    """All key, reference, enum and check constraints of the read model."""
    checks = [
        duplicate_keys(entities, "entities", ["id"]),
        duplicate_keys(entities, "entities", ["entity_type", "slug"]),
        bad_values(
            entities, "entities", "enum(entity_type)",
            ~F.col("entity_type").isin(*settings.ENTITY_TYPES),
        ),
        duplicate_keys(articles, "source_articles", ["id"]),
        duplicate_keys(articles, "source_articles", ["canonical_url"]),
        duplicate_keys(articles, "source_articles", ["slug"]),
        duplicate_keys(items, "entity_timeline_items", ["entity_id", "window_start", "window_end"]),
        bad_values(
            items, "entity_timeline_items", "check(article_count)", F.col("article_count") <= 0
        ),
        orphans(items, "entity_timeline_items", "entity_id", entities),
        duplicate_keys(item_articles, "timeline_item_articles", ["timeline_item_id", "article_id"]),
        orphans(item_articles, "timeline_item_articles", "article_id", articles),
        orphans(item_articles, "timeline_item_articles", "timeline_item_id", items),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
