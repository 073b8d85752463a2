"""Timeline summaries: one per (entity, 3-hour window), all windows in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import identity, responses, windows
from newsloom.operators import articles as article_ops
from newsloom.operators import mentions as mention_ops
from newsloom.operators import ranking
from newsloom.operators.popularity import in_range

# What the text generator is asked to do with the reports above it.
REQUEST = (
    "Write one timeline entry about the subject from these reports alone; leave out what does not concern it."
    ' Answer with a JSON object of two strings and nothing else: "title", a short headline, and "content", the summary.'
)

# Prompt in, response text out; raising drops that row only.
TextGenerator = Callable[[str], str]


def recent_range(now: datetime, days: int) -> tuple[datetime, datetime]:
    """Start and end of the closed windows of the last ``days`` days."""
    if days < 1:
        raise ValueError("days must be positive")
    _, end = windows.window_at(now, back=1)
    return end - timedelta(days=days), end


def window_keys(
    articles: DataFrame, mentions: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """Dated entity keys needed for windows in ``[start, end)``.

    The first windows look back 24 hours, so reading starts that much earlier.
    """
    lookback = start - timedelta(hours=settings.POPULARITY_HOURS)
    scanned = in_range(articles, F.lit(lookback), F.lit(end))
    typed = mentions.filter(
        F.upper(F.coalesce("label", F.lit("CLUB"))).isin(*settings.TOP_ENTITIES_BY_TYPE)
    )
    return ranking.dated_keys(mention_ops.named(typed), scanned)


def top_entities(dated: DataFrame) -> DataFrame:
    """Top-N entity keys per type for every window end."""
    return ranking.top_per_type(
        ranking.sliding_counts(ranking.bucket_counts(dated)), by=["window_end"]
    )


def window_pairs(dated: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """(window, entity, article) for articles of a window that mention a top entity.

    Two labels of one entity id would give one summary id; the label with more
    articles is kept, then the first by name.
    """
    inside = in_range(dated, F.lit(start), F.lit(end)).withColumn(
        "window_start", windows.floor_window(F.col("crawl_date"))
    )
    pairs = inside.withColumn("window_end", windows.window_end(F.col("window_start")))
    tops = top_entities(dated).filter(F.col("window_articles") > 0)
    order = F.struct(
        (-F.col("mention_count")).alias("n"), "entity_type", "canonical_name"
    )
    chosen = tops.groupBy("window_end", "entity_id").agg(
        F.min_by("entity_type", order).alias("entity_type"),
        F.min_by("canonical_name", order).alias("canonical_name"),
    )
    return pairs.join(chosen, ["window_end", *ranking.KEY], "left_semi")


def with_summary_id(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "id",
        identity.summary_id(F.col("entity_id"), F.col("window_start"), F.col("window_end")),
    )


def ranked_articles(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Top articles of each (window, entity) with their rank."""
    counted = ranking.count_mentions(pairs, texts)
    return ranking.top_articles(counted, by=["window_start", "window_end", *ranking.KEY])


def article_lists(ranked: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (window, entity): chosen articles, newest first (at most five)."""
    entry = F.struct("crawl_date", "rank", "article_id", *extra)
    return ranked.groupBy("window_start", "window_end", *ranking.KEY).agg(
        ranking.newest_first(F.collect_list(entry)).alias("chosen")
    )


def prompt(name: Column, kind: Column, chosen: Column) -> Column:
    """Generator request: the subject, its numbered reports (newest first) and what to do."""

    def report(a: Column, i: Column) -> Column:
        head = F.concat_ws(" ", F.lit("Report"), i + 1, F.lit("of"), F.size(chosen), F.lit("of"), identity.iso_utc(a["crawl_date"]))
        return F.concat(head, F.lit(": "), a["title"], F.lit("\n"), a["content"])

    subject = F.concat(F.lit("Subject: "), name, F.lit(" ("), F.lower(kind), F.lit(")"))
    return F.concat_ws("\n\n", subject, F.array_join(F.transform(chosen, report), "\n\n"), F.lit(REQUEST))


def template_response(name: Column, chosen: Column) -> Column:
    """Default generator: a fixed, repeatable summary built in the JVM."""
    count = F.size(chosen)
    title = F.concat(name, F.lit(": "), count.cast("string"), F.lit(" new articles"))
    titles = F.array_join(F.transform(chosen, lambda a: a["title"]), "; ")
    return F.to_json(
        F.struct(title.alias("title"), F.concat(F.lit("Latest reports: "), titles).alias("content"))
    )


def generate(requests: DataFrame, generator: TextGenerator) -> DataFrame:
    """Run a text generator over ``prompt``; a failing row gets a null response."""
    schema = mention_ops.keyed_schema(requests, "response STRING")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for request in batch["prompt"]:
                try:
                    answers.append(generator(request))
                except Exception:  # noqa: BLE001 - the row is retried by the next run
                    answers.append(None)
            yield pd.DataFrame({"id": batch["id"], "response": answers})

    return requests.select("id", "prompt").mapInPandas(run, schema)


def summarize(
    articles: DataFrame,
    contents: DataFrame,
    mentions: DataFrame,
    *,
    start: datetime,
    end: datetime,
    now: datetime,
    existing: DataFrame | None = None,
    force: bool = False,
    generator: TextGenerator | None = None,
) -> DataFrame:
    """New summaries for every closed window in ``[start, end)``.

    Pairs with a COMPLETED summary in ``existing`` are left out unless forced;
    pairs whose response cannot be used give no row and stay open.
    """
    dated = window_keys(articles, mentions, start, end)
    pairs = with_summary_id(window_pairs(dated, start, end))
    if existing is not None and not force:
        done = existing.filter(F.col("status") == "COMPLETED").select("id")
        pairs = pairs.join(done, "id", "left_anti")
    scanned = in_range(articles, F.lit(start), F.lit(end))
    texts = article_ops.with_text(scanned, contents)
    ranked = ranked_articles(pairs.drop("id"), texts)
    # The template names titles alone; only a generator is shown the texts.
    extra = ("title",) if generator is None else ("title", "content")
    source = scanned.select("id", F.coalesce("title", F.lit("")).alias("title")) if generator is None else texts
    shown = source.select(F.col("id").alias("article_id"), *extra)
    lists = article_lists(ranked.join(shown, "article_id"), extra=extra)
    if generator is None:
        answered = with_summary_id(lists).withColumn(
            "response", template_response(F.col("canonical_name"), F.col("chosen"))
        )
    else:
        from newsloom.session import cut_lineage

        requests = cut_lineage(
            with_summary_id(lists).withColumn(
                "prompt", prompt(F.col("canonical_name"), F.col("entity_type"), F.col("chosen"))
            )
        )
        answered = requests.drop("prompt").join(generate(requests, generator), "id")
    item = answered.withColumn("_item", responses.parse_timeline_item(F.col("response")))
    nothing = F.array().cast("array<string>")
    return item.filter(F.isnull("_item.problem")).select(
        "id",
        "entity_id",
        "canonical_name",
        "entity_type",
        "window_start",
        "window_end",
        F.transform("chosen", lambda a: a["article_id"]).alias("article_ids"),
        F.size("chosen").alias("article_count"),
        nothing.alias("entities_50"),
        nothing.alias("entities_80"),
        F.col("_item.content").alias("aggregated_news"),
        F.col("_item.title").alias("short_description"),
        F.lit("COMPLETED").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(now).cast("timestamp").alias("created_at"),
        F.lit(now).cast("timestamp").alias("updated_at"),
    )


def summarize_recent(
    articles: DataFrame,
    contents: DataFrame,
    mentions: DataFrame,
    *,
    now: datetime,
    days: int = 7,
    existing: DataFrame | None = None,
    force: bool = False,
    generator: TextGenerator | None = None,
) -> DataFrame:
    """Existing COMPLETED summaries of the recent windows plus the new ones.

    A stored summary is passed on only where its window still ranks the entity,
    as a rerun of that window would report it.
    """
    start, end = recent_range(now, days)
    new = summarize(
        articles, contents, mentions,
        start=start, end=end, now=now, existing=existing, force=force, generator=generator,
    )
    if existing is None or force:
        return new
    pairs = with_summary_id(window_pairs(window_keys(articles, mentions, start, end), start, end))
    kept = existing.filter(F.col("status") == "COMPLETED").join(
        pairs.select("id").distinct(), "id", "left_semi"
    )
    return kept.unionByName(new)


def window_starts(articles: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Starts of the windows that hold at least one article."""
    scanned = in_range(articles, F.lit(start), F.lit(end))
    return scanned.select(windows.floor_window(F.col("crawl_date")).alias("window_start")).distinct()
