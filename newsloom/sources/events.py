"""Pointer events: what is published after an article's content is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import identity


def crawled_events(articles: DataFrame, now: Column) -> DataFrame:
    """Key and compact JSON value for ``articles`` (id, canonical_url, source_name).

    The event id is derived from the article and the time instead of drawn at
    random, so that a retried task publishes the same event.
    """
    occurred = identity.iso_utc(now)
    payload = F.struct(
        F.col("id").alias("article_id"),
        "canonical_url",
        "source_name",
        F.lit(None).cast("string").alias("published_time"),
    )
    event = F.struct(
        identity.uuid5(
            settings.NEWS_URL_NAMESPACE, F.concat_ws(":", F.lit(settings.CRAWLED_EVENT), "id", occurred)
        ).alias("event_id"),
        F.lit(settings.CRAWLED_EVENT).alias("event_type"),
        F.lit(1).alias("event_version"),
        occurred.alias("occurred_at"),
        F.lit(settings.CRAWLED_PRODUCER).alias("producer"),
        F.col("id").alias("correlation_id"),
        F.lit(None).cast("string").alias("causation_id"),
        F.lit(settings.CRAWLED_AGGREGATE).alias("aggregate_type"),
        F.col("id").alias("aggregate_id"),
        F.col("id").alias("idempotency_key"),
        payload.alias("payload"),
    )
    return articles.select(
        F.col("id").alias("key"),
        F.to_json(event, {"ignoreNullFields": "false"}).alias("value"),
    )


def publish(events: DataFrame, *, brokers: str | None = None, path: str | None = None) -> None:
    """Send events to the topic, or append them as text files where no broker is."""
    if brokers:
        (
            events.write.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("topic", settings.CRAWLED_TOPIC)
            .save()
        )
    else:
        events.select("value").write.mode("append").text(path)
