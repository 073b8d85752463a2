"""Article collections: backlogs, candidate selection, seeding, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import identity, text, urls


def backlog(metadata: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles without a row in ``done``, newest first.

    With a limit this is a top-k over the anti join; without one the order is
    left to the reader, since a total sort of a backlog serves nobody.
    """
    open_rows = metadata.join(done.select("id"), "id", "left_anti")
    if limit is None:
        return open_rows
    return open_rows.orderBy(F.col("crawl_date").desc(), "id").limit(limit)


def with_filtered(contents: DataFrame, filtered: DataFrame) -> DataFrame:
    """Contents with the rewritten texts of ``filtered`` (``id``, ``filtered_content``) put in."""
    newer = filtered.select("id", F.col("filtered_content").alias("_newer"))
    text_in = F.coalesce("_newer", "filtered_content")
    return contents.join(newer, "id", "left").withColumn("filtered_content", text_in).drop("_newer")


def with_text(metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """Articles with their texts: content falls back to the title, filtered to content."""
    content = text.present(F.col("content"))
    # Each text is chosen before the join, so that a caller of one moves one.
    texts = contents.select(
        "id",
        content.alias("content"),
        F.coalesce(text.present(F.col("filtered_content")), content).alias("filtered_content"),
    )
    title = F.coalesce("title", F.lit(""))
    return metadata.select("id", "title", "crawl_date").join(texts, "id", "left").select(
        "id",
        title.alias("title"),
        "crawl_date",
        F.coalesce("content", title).alias("content"),
        F.coalesce("filtered_content", title).alias("filtered_content"),
    )


def identify(candidates: DataFrame, *, idna: bool = True) -> DataFrame:
    """Add ``canonical_url``, ``id`` and ``url_problem`` to rows with a url."""
    named = candidates.withColumn("_url", urls.url_identity(F.col("url"), idna=idna))
    return (
        named.withColumn("canonical_url", F.col("_url.canonical_url"))
        .withColumn("url_problem", F.col("_url.problem"))
        .withColumn("id", identity.article_id(F.col("canonical_url")))
        .drop("_url")
    )


def first_seen(identified: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The earliest row of each article id: lowest ``ordinal``, then source and url.

    A grouped minimum, so copies of one article collapse before the shuffle.
    """
    others = [c for c in identified.columns if c not in ("id", *by)]
    row = F.struct("ordinal", *[c for c in others if c != "ordinal"])
    order = F.struct("ordinal", *[c for c in ("source_name", "url") if c in others])
    return (
        identified.filter(F.col("id").isNotNull())
        .groupBy(*by, "id")
        .agg(F.min_by(row, order).alias("_row"))
        .select(*by, "id", "_row.*")
    )


def select_new_candidates(
    identified: DataFrame,
    stored: DataFrame,
    *,
    candidate_limit: int | None = None,
    fetch_limit: int | None = None,
) -> DataFrame:
    """Per source: the distinct candidates that are not stored, in input order with their position.

    A crawl policy may look at the first ``candidate_limit`` candidates of a source
    only and fetch ``fetch_limit`` of them; :func:`candidate_cuts` counts what that leaves out.
    """
    if any(limit is not None and limit < 1 for limit in (candidate_limit, fetch_limit)):
        raise ValueError("crawl limits must be positive")
    order = Window.partitionBy("source_name").orderBy("ordinal", "id")
    considered = first_seen(identified, by=("source_name",))
    if candidate_limit is not None:
        place = considered.withColumn("_seen", F.row_number().over(order))
        considered = place.filter(F.col("_seen") <= candidate_limit).drop("_seen")
    fresh = considered.join(stored.select("id"), "id", "left_anti").withColumn("position", F.row_number().over(order))
    return fresh if fetch_limit is None else fresh.filter(F.col("position") <= fetch_limit)


def candidate_cuts(
    identified: DataFrame, stored: DataFrame, *, candidate_limit: int | None = None, fetch_limit: int | None = None
) -> DataFrame:
    """Per source: new candidates, those that the limits keep, and those they cut."""
    kept = select_new_candidates(identified, stored, candidate_limit=candidate_limit, fetch_limit=fetch_limit)
    every = first_seen(identified, by=("source_name",)).join(stored.select("id"), "id", "left_anti")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = every.select("source_name", one.alias("fresh"), none.alias("kept")).unionByName(
        kept.select("source_name", none.alias("fresh"), one.alias("kept"))
    )
    counted = rows.groupBy("source_name").agg(F.sum("fresh").alias("fresh"), F.sum("kept").alias("kept"))
    return counted.withColumn("cut", F.col("fresh") - F.col("kept"))


def seed_metadata(identified: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """New metadata rows for candidates not stored yet; one per article id."""
    fresh = first_seen(identified).join(stored.select("id"), "id", "left_anti")
    empty = F.array().cast("array<string>")
    title = F.coalesce(text.present(F.col("title")), F.lit("Untitled"))
    return fresh.select(
        "id",
        "url",
        "canonical_url",
        urls.url_host(F.col("canonical_url")).alias("domain_name"),
        "source_name",
        F.left(text.strip(title), F.lit(500)).alias("title"),
        F.when(
            F.coalesce("description", F.lit("")) != "",
            F.left(text.strip(F.col("description")), F.lit(1000)),
        ).alias("description"),
        F.col("published_at").alias("published_time"),
        now.alias("crawl_date"),
        F.when(
            F.coalesce("image_url", F.lit("")) != "", text.strip(F.col("image_url"))
        ).alias("image_url"),
        empty.alias("tags"),
        empty.alias("article_keywords"),
        F.lit("").alias("content_hash"),
        F.lit("en").alias("language"),
    )


def seed_tallies(identified: DataFrame, stored: DataFrame) -> DataFrame:
    """Discovered, seeded and existing candidates per source and in total.

    The total row has a null source. A candidate counts as seeded when it is the
    first of its article and the article is not stored.
    """
    first = (
        identified.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.min_by("source_name", F.struct("ordinal", "source_name")).alias("first_source")
        )
        .join(stored.select("id", F.lit(True).alias("known")), "id", "left")
    )
    seeded = (
        first.filter(F.col("known").isNull())
        .groupBy(F.col("first_source").alias("source_name"))
        .agg(F.count("*").alias("seeded"))
    )
    discovered = identified.groupBy("source_name").agg(
        F.count("id").alias("discovered"), F.count_if(F.col("id").isNull()).alias("rejected")
    )
    per_source = discovered.join(seeded, "source_name", "left").select(
        "source_name", "discovered", "rejected", F.coalesce("seeded", F.lit(0)).alias("seeded")
    )
    totals = per_source.rollup("source_name").agg(
        *[F.sum(c).alias(c) for c in ("discovered", "rejected", "seeded")]
    )
    return totals.withColumn("existing", F.col("discovered") - F.col("seeded"))


def content_rows(extracted: DataFrame, now: Column) -> DataFrame:
    """Content rows of usable extractions (id, text, extractor, status)."""
    usable = extracted.filter(
        (F.col("extraction_status") != "FAILED") & (F.coalesce("text", F.lit("")) != "")
    )
    return usable.select(
        "id",
        F.col("text").alias("content"),
        now.alias("cleaned_at"),
        F.coalesce("extractor", F.lit("UNKNOWN")).alias("extractor"),
        "extraction_status",
    )


def apply_content(metadata: DataFrame, extracted: DataFrame) -> DataFrame:
    """Metadata with the content hash set, and the title where it was missing."""
    new = extracted.filter(
        (F.col("extraction_status") != "FAILED") & (F.coalesce("text", F.lit("")) != "")
    ).select(
        "id",
        identity.content_hash(F.col("text")).alias("_hash"),
        F.left(text.present(text.strip(F.col("title"))), F.lit(500)).alias("_title"),
    )
    missing = F.coalesce("title", F.lit("")).isin("", "Untitled")
    return (
        metadata.join(new, "id", "left")
        .withColumn("content_hash", F.coalesce("_hash", "content_hash"))
        .withColumn("title", F.when(missing, F.coalesce("_title", "title")).otherwise(F.col("title")))
        .drop("_hash", "_title")
    )


def full_articles(extracted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Metadata and content rows written together from fetched pages.

    ``extracted`` has requested_url, final_url, source_name and the extraction
    columns; here the domain keeps a port.
    """
    rows = extracted.withColumn("canonical_url", urls.canonical_url(F.col("final_url"), idna=True))
    rows = rows.withColumn("id", identity.article_id(F.col("canonical_url"))).filter(
        F.col("id").isNotNull()
        & (F.col("extraction_status") != "FAILED")
        & F.col("text").isNotNull()
    )
    empty = F.array().cast("array<string>")
    metadata = rows.select(
        "id",
        F.col("requested_url").alias("url"),
        "canonical_url",
        urls.url_authority(F.col("canonical_url")).alias("domain_name"),
        "source_name",
        F.coalesce(text.present(F.col("title")), F.lit("Untitled")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("timestamp").alias("published_time"),
        now.alias("crawl_date"),
        F.lit(None).cast("string").alias("image_url"),
        empty.alias("tags"),
        empty.alias("article_keywords"),
        identity.content_hash(F.col("text")).alias("content_hash"),
        F.lit("en").alias("language"),
    )
    return metadata, content_rows(rows, now)


def duplicate_groups(articles: DataFrame, key: str) -> DataFrame:
    """Groups of articles sharing ``key``: size and first id. Counts only, no pairs."""
    return (
        articles.filter(text.present(F.col(key)).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .filter(F.col("copies") > 1)
    )


def extraction_tallies(extracted: DataFrame) -> DataFrame:
    failed = (F.col("extraction_status") == "FAILED") | (F.coalesce("text", F.lit("")) == "")
    return extracted.agg(
        F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed")
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Mean, median and p90/p95/p99 of an integer column, exactly.

    A quantile is the element at index ``int(q * n)`` of the sorted column. It is
    found digit by digit: one count per next digit (of 256) among the values that
    share the digits found so far, for all quantiles at once. The counts merge on
    the map side and at most 256 per wanted element reach the driver, whatever the
    number and range of the values; nothing is sorted and no task sees all rows.
    """
    values = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("bigint").alias("v"))
    n, total, low, high = values.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.min("v"), F.max("v")).first()
    wanted = {"p90": 0.9, "p95": 0.95, "p99": 0.99}
    schema = "n BIGINT, mean DOUBLE, p50 DOUBLE, p90 BIGINT, p95 BIGINT, p99 BIGINT"
    if not n:
        return df.sparkSession.createDataFrame([(0, None, None, None, None, None)], schema)
    places = {name: min(int(q * n), n - 1) for name, q in wanted.items()} | {"low": (n - 1) // 2, "high": n // 2}
    found = _elements(values, sorted(set(places.values())), low, high)
    at = {name: found[place] for name, place in places.items()}
    row = (n, float(total) / n, (at["low"] + at["high"]) / 2, at["p90"], at["p95"], at["p99"])
    return df.sparkSession.createDataFrame([row], schema)


def _elements(values: DataFrame, places: list[int], low: int, high: int) -> dict[int, int]:
    """The elements at some places of the sorted column ``v``, whose range is known."""
    shift = max(0, ((high - low).bit_length() - 1) // 8 * 8)
    height = F.col("v") - F.lit(low)  # from 0 up
    open_ = {place: (0, place) for place in places}  # leading digits so far, and the place among values that share them
    while True:
        prefix = F.shiftright(height, shift + 8) if shift + 8 < 64 else F.lit(0).cast("bigint")
        counted = values.filter(prefix.isin(sorted({p for p, _ in open_.values()}))).groupBy(
            F.shiftright(height, shift).alias("digits")
        ).agg(F.count("*").alias("c"))
        cells = sorted((row["digits"], row["c"]) for row in counted.collect())
        for place, (leading, rest) in open_.items():
            for digits, count in cells:
                if digits >> 8 != leading:
                    continue
                if rest < count:
                    open_[place] = (digits, rest)
                    break
                rest -= count
        if not shift:
            return {place: low + digits for place, (digits, _) in open_.items()}
        shift -= 8


def approximate_distribution(df: DataFrame, value: str, *, error: float = 1e-4) -> DataFrame:
    """As :func:`distribution` in one pass, by mergeable sketches: quantiles whose rank is off by ``error * n`` at most."""
    quantiles = F.percentile_approx(F.col(value).cast("bigint"), [0.5, 0.9, 0.95, 0.99], int(1 / error))
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), quantiles.alias("q")).select(
        "n", "mean", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))]
    )
