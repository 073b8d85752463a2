"""The collections of the newsroom, derived from the driver tables.

Articles come from ``documents``, catalog entities from ``customer`` named by a
word of their document, mentions from ``events``. The derived collections are
written once per session to the shared folder, as the jobs would write them, and
every query reads them from there with column pruning and filter pushdown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import identity, text
from newsloom.operators import upsert
from newsloom.plans import publish as publishing
from newsloom.plans import timeline
from newsloom.plans.publish import ReadModel
from newsloom.queries.sql import LONG_WORD, SECOND_WORD
from newsloom.session import SPREAD_BYTES, shared_folder, spread

FIRST_DAY = datetime(2024, 1, 1, tzinfo=UTC)
LAST_DAY = datetime(2024, 1, 31, tzinfo=UTC)
NOW = datetime(2024, 1, 20, 7, 45, tzinfo=UTC)
# Reported as "now" of the runs that write the collections.
RUN_TIME = datetime(2024, 1, 31, 1, 30, tzinfo=UTC)
SPLIT = datetime(2024, 1, 16, tzinfo=UTC)

TEXT_TABLES = ("documents", "pages", "conversations")

_written: dict[tuple[str, str, str], str] = {}


class StoredModel:
    """A stored read model: each table is built when it is first asked for."""

    def __init__(self, **tables: Callable[[], DataFrame]) -> None:
        self._tables = tables

    entities = property(lambda self: self._tables["entities"]())
    articles = property(lambda self: self._tables["articles"]())
    items = property(lambda self: self._tables["items"]())
    item_articles = property(lambda self: self._tables["item_articles"]())


class Newsroom:
    """Driver tables of one folder and the collections derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # Text work is heavy per byte and the local file of a table is one split.
        return spread(table, SPREAD_BYTES) if name in TEXT_TABLES else table

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _written:
            place = hashlib.sha256(self.folder.encode()).hexdigest()[:12]
            path = f"{shared_folder(self.spark)}/newsloom/{key[0]}/{place}/{name}"
            build().write.mode("overwrite").parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])

    # Collections

    @property
    def articles(self) -> DataFrame:
        return self._stored("news_metadata", self._articles)

    @property
    def contents(self) -> DataFrame:
        """Texts by article; the rewritten text, where there is one, equals the text, which is stored once."""
        stored = self._stored("news_content", self._contents)
        return stored.select("id", "content", F.when(F.col("rewritten"), F.col("content")).alias("filtered_content"))

    @property
    def catalog(self) -> DataFrame:
        return self._stored("canonical_entities", self._catalog)

    @property
    def mentions(self) -> DataFrame:
        return self._stored("mentions", self._mentions)

    @property
    def summaries(self) -> DataFrame:
        return self._stored("entity_timeline_summaries", self._summaries)

    @property
    def model(self) -> StoredModel:
        """The published read model after a popularity refresh at ``NOW``."""
        published = self.published
        return StoredModel(
            entities=lambda: self._stored("entities", self.refreshed_entities),
            articles=lambda: published.articles,
            items=lambda: published.items,
            item_articles=lambda: published.item_articles,
        )

    @property
    def published(self) -> StoredModel:
        names = ("entities", "articles", "items", "item_articles")
        built: list[ReadModel] = []

        def part(name: str) -> Callable[[], DataFrame]:
            def build() -> DataFrame:
                if not built:
                    built.append(
                        publishing.publish(
                            self.empty_model(), self.summaries, self.catalog, self.articles,
                            self.contents, self.run_time, repeats=True,
                        )
                    )
                return getattr(built[0], name)

            return lambda: self._stored(f"published_{name}", build)

        return StoredModel(**{n: part(n) for n in names})

    def refreshed_entities(self) -> DataFrame:
        """The published entities after a popularity refresh at ``NOW``."""
        active = publishing.active_entities(self.articles, self.mentions, self.catalog, NOW, repeats=True)
        return upsert.popularity(self.published.entities, active)[0]

    @property
    def run_time(self) -> Column:
        return F.lit(RUN_TIME).cast("timestamp")

    def empty_model(self) -> ReadModel:
        def empty(schema):
            return self.spark.createDataFrame([], schema)

        return ReadModel(
            empty(schemas.ENTITIES),
            empty(schemas.SOURCE_ARTICLES),
            empty(schemas.TIMELINE_ITEMS),
            empty(schemas.TIMELINE_ITEM_ARTICLES),
        )

    # Derivations

    @staticmethod
    def _article_path() -> Column:
        return F.concat(
            F.lit("https://www."), "source", F.lit(".example.com/"), "lang",
            F.lit("/articles/"), F.col("doc_id").cast("string"),
        )

    def _articles(self) -> DataFrame:
        path = self._article_path()
        minutes = F.col("doc_id") * 7919 % 43200
        crawled = F.timestamp_seconds(F.lit(int(FIRST_DAY.timestamp())) + minutes * 60)
        nothing = F.array().cast("array<string>")
        lines = F.split("text", "\n", 3)
        return self.table("documents").select(
            identity.article_id(path).alias("id"),
            F.concat(path, F.lit("?utm_source=rss#top")).alias("url"),
            path.alias("canonical_url"),
            F.concat(F.lit("www."), "source", F.lit(".example.com")).alias("domain_name"),
            F.col("source").alias("source_name"),
            F.coalesce(text.present(F.left(lines[0], F.lit(500))), F.lit("Untitled")).alias("title"),
            text.present(F.left(F.get(lines, 1), F.lit(1000))).alias("description"),
            F.when(
                F.col("lang") != "de",
                F.timestamp_seconds(
                    F.unix_seconds(crawled) - (F.col("doc_id") * 31 % 100) * 3600
                ),
            ).alias("published_time"),
            crawled.alias("crawl_date"),
            F.lit(None).cast("string").alias("image_url"),
            nothing.alias("tags"),
            nothing.alias("article_keywords"),
            identity.content_hash(F.col("text")).alias("content_hash"),
            F.col("lang").alias("language"),
            "doc_id",
        )

    def _contents(self) -> DataFrame:
        """Texts of usable length; rewritten texts are missing for one language."""
        texts = self.table("documents").filter("n_chars >= 40")
        # The id follows from the document's own row: no text moves for it.
        return texts.select(
            identity.article_id(self._article_path()).alias("id"),
            F.col("text").alias("content"),
            (F.col("lang") != "es").alias("rewritten"),
        )

    def _owners(self) -> DataFrame:
        return self._stored("owners", self._named_owners)

    def _named_owners(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        kind = (
            F.when(segment == "BUILDING", "CLUB")
            .when(segment == "FURNITURE", "COACH")
            .when(segment == "HOUSEHOLD", "COMPETITION")
            .otherwise("PLAYER")
        )
        people = self.table("customer").select("c_custkey", "c_acctbal", kind.alias("entity_type"))
        names = self.table("documents").select(
            F.col("doc_id").alias("c_custkey"),
            F.regexp_extract("text", LONG_WORD, 0).alias("name"),
            F.regexp_extract("text", SECOND_WORD, 1).alias("second_name"),
        )
        return (
            people.join(names, "c_custkey")
            .filter(F.col("name") != "")
            .withColumn(
                "canonical_key",
                identity.canonical_key(F.col("entity_type"), F.col("name"), catalog=True),
            )
        )

    def _catalog(self) -> DataFrame:
        owners = self._owners()
        values = F.filter(F.array(text.upper(F.col("name")), "second_name"), lambda v: v != "")
        aliases = F.transform(
            values,
            lambda v: F.struct(
                v.alias("value"), F.lower(v).alias("normalized_value"),
                F.lit(False).alias("case_sensitive"),
            ),
        )
        status = F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE")
        rows = owners.select(
            "canonical_key", "c_custkey", "entity_type", "name", aliases.alias("aliases"),
            status.alias("status"),
        )
        return rows.groupBy("canonical_key").agg(
            *[
                F.max_by(c, "c_custkey").alias(a)
                for c, a in (
                    ("entity_type", "entity_type"), ("name", "canonical_name"),
                    ("aliases", "aliases"), ("status", "status"),
                )
            ]
        ).withColumn("id", identity.entity_id(F.col("canonical_key")))

    def _mentions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        events = self.table("events").select(
            F.expr("event_id DIV 10").alias("doc_id"), F.col("user_id").alias("c_custkey"),
            "event_id", "event_type", "value", k.alias("k"),
        )
        known = identity.entity_id(F.col("canonical_key"))
        runtime_key = F.concat(
            F.upper("entity_type"), F.lit(":"), F.regexp_replace("canonical_key", "^[^:]*:", "")
        )
        owners = self._owners().select(
            "c_custkey", "entity_type", "name", known.alias("known_id"),
            identity.entity_id(runtime_key).alias("fallback_id"),
        )
        articles = self.articles.select(F.col("id").alias("article_id"), "doc_id")
        kind = F.col("event_type")
        return (
            events.join(owners, "c_custkey")
            .join(articles, "doc_id")
            .select(
                "article_id",
                "event_id",
                F.when(kind == "error", "COMPETITION")
                .when(kind == "purchase", "CLUB")
                .otherwise(F.col("entity_type"))
                .alias("label"),
                F.col("name").alias("text"),
                ((F.col("k") + 900) / F.lit(1000.0)).alias("score"),
                F.when(F.col("value") < 1, F.lit(None))
                .when(F.col("k") < 10, F.col("fallback_id"))
                .otherwise(F.col("known_id"))
                .alias("canonical_entity_id"),
                F.col("name").alias("canonical_name"),
            )
        )

    def _summaries(self) -> DataFrame:
        return timeline.summarize(
            self.articles, self.contents, self.mentions,
            start=FIRST_DAY, end=LAST_DAY, now=RUN_TIME,
        )
