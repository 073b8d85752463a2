"""Explicit schemas (DDL) of every collection, read-model table and event."""

CANONICAL_ENTITIES = (
    "id STRING, entity_type STRING, canonical_key STRING, canonical_name STRING,"
    " canonical_name_normalized STRING, leagues ARRAY<STRING>, seasons ARRAY<STRING>,"
    " aliases ARRAY<STRUCT<value: STRING, normalized_value: STRING, case_sensitive: BOOLEAN>>,"
    " alias_values_normalized ARRAY<STRING>, status STRING, source STRING,"
    " created_at TIMESTAMP, updated_at TIMESTAMP"
)

NEWS_METADATA = (
    "id STRING, url STRING, canonical_url STRING, domain_name STRING, source_name STRING,"
    " title STRING, description STRING, published_time TIMESTAMP, crawl_date TIMESTAMP,"
    " image_url STRING, tags ARRAY<STRING>, article_keywords ARRAY<STRING>,"
    " content_hash STRING, language STRING"
)

NEWS_CONTENT = (
    "id STRING, content STRING, filtered_content STRING, cleaned_at TIMESTAMP,"
    " filtered_at TIMESTAMP, extractor STRING, extraction_status STRING"
)

MENTION = (
    "STRUCT<label: STRING, text: STRING, score: DOUBLE, start: INT, end: INT,"
    " canonical_entity_id: STRING, canonical_name: STRING>"
)

NEWS_ENTITIES = (
    f"id STRING, entities ARRAY<{MENTION}>, model_name STRING, model_version STRING,"
    " processed_at TIMESTAMP, error STRING"
)

SUMMARIES = (
    "id STRING, entity_id STRING, canonical_name STRING, entity_type STRING,"
    " window_start TIMESTAMP, window_end TIMESTAMP, article_ids ARRAY<STRING>,"
    " article_count INT, entities_50 ARRAY<STRING>, entities_80 ARRAY<STRING>,"
    " aggregated_news STRING, short_description STRING, status STRING,"
    " error_message STRING, published_at TIMESTAMP, created_at TIMESTAMP,"
    " updated_at TIMESTAMP"
)

ENTITIES = (
    "id STRING, entity_type STRING, name STRING, canonical_name STRING, slug STRING,"
    " aliases ARRAY<STRING>, mention_count_24h INT, last_seen_at TIMESTAMP,"
    " updated_at TIMESTAMP"
)

SOURCE_ARTICLES = (
    "id STRING, title STRING, url STRING, canonical_url STRING, source_name STRING,"
    " domain_name STRING, description STRING, image_url STRING, published_at TIMESTAMP,"
    " crawled_at TIMESTAMP, content_hash STRING, slug STRING, body STRING,"
    " excerpt STRING, language STRING, updated_at TIMESTAMP"
)

TIMELINE_ITEMS = (
    "id STRING, entity_id STRING, window_start TIMESTAMP, window_end TIMESTAMP,"
    " title STRING, summary STRING, article_count INT, key_entities_50 ARRAY<STRING>,"
    " key_entities_80 ARRAY<STRING>, updated_at TIMESTAMP"
)

TIMELINE_ITEM_ARTICLES = (
    "timeline_item_id STRING, article_id STRING, position INT"
)

SOURCES = (
    "id STRING, name STRING, rss_url STRING, allowed_domains ARRAY<STRING>,"
    " source_type STRING, reliability_tier SMALLINT, enabled BOOLEAN,"
    " crawl_interval_minutes INT, max_concurrency SMALLINT,"
    " last_discovered_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP,"
    " version INT"
)

CRAWL_BATCHES = (
    "id STRING, source_id STRING, idempotency_key STRING, window_started_at TIMESTAMP,"
    " status STRING, discovered_count INT, fetched_count INT, failed_count INT,"
    " started_at TIMESTAMP, completed_at TIMESTAMP"
)

CRAWLED_PAYLOAD_FIELDS = ("article_id", "canonical_url", "source_name", "published_time")
CRAWLED_EVENT_FIELDS = (
    "event_id", "event_type", "event_version", "occurred_at", "producer", "correlation_id",
    "causation_id", "aggregate_type", "aggregate_id", "idempotency_key", "payload",
)
# Every value but the version is read as text and checked by rules.
CRAWLED_EVENT = (
    "event_id STRING, event_type STRING, event_version INT, occurred_at STRING,"
    " producer STRING, correlation_id STRING, causation_id STRING,"
    " aggregate_type STRING, aggregate_id STRING, idempotency_key STRING,"
    " payload STRUCT<article_id: STRING, canonical_url: STRING, source_name: STRING,"
    " published_time: STRING>"
)

CANDIDATES = (
    "source_name STRING, ordinal BIGINT, url STRING, title STRING,"
    " published_at TIMESTAMP, description STRING, image_url STRING"
)
