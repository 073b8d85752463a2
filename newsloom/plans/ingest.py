"""Ingest: candidates to metadata rows, fetched pages to content rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import html, text
from newsloom.operators import articles
from newsloom.operators.mentions import keyed_schema
from newsloom.session import spread

# Names stored with the result.
PRIMARY, FALLBACK = "TRAFILATURA", "BEAUTIFULSOUP"

_EXTRACTION = (
    "extraction_status STRING, extractor STRING, raw_title STRING, raw_text STRING,"
    " diagnostics ARRAY<STRING>"
)


def discover(candidates: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new metadata rows, tallies per source and in total)."""
    identified = articles.identify(candidates)
    return (
        articles.seed_metadata(identified, stored, now),
        articles.seed_tallies(identified, stored),
    )


def _useful(found: tuple[str | None, str] | None) -> tuple[str | None, str] | None:
    if found is None:
        return None
    title, body = (found[0] or "").strip() or None, (found[1] or "").strip()
    return (title, body) if len(body) >= settings.MIN_TEXT_LENGTH else None


def extract_pages(
    pages: DataFrame,
    *,
    primary: html.ContentExtractor | None = None,
    fallback: html.ContentExtractor = html.main_content,
) -> DataFrame:
    """Title and text of pages (id, url, html) with status and diagnostics.

    ``primary`` is the caller's extractor and gives SUCCESS; the built-in rules
    are the fallback and give PARTIAL. One pass over the pages, no shuffle; the
    raw texts leave it with entities resolved and NFC composed.
    """
    schema = keyed_schema(pages, _EXTRACTION)
    names = [
        "id", "extraction_status", "extractor", "raw_title", "raw_text", "diagnostics"
    ]

    def attempt(extractor, name: str, page: str, url: str, notes: list[str]):
        try:
            found = _useful(extractor(page, url))
        except Exception as error:  # noqa: BLE001 - recorded with the row
            notes.append(f"{name}_extractor_error:{type(error).__name__}")
            return None
        if found is None:
            notes.append(f"{name}_extractor_returned_no_content")
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, url, page in zip(batch["id"], batch["url"], batch["html"], strict=True):
                notes: list[str] = []
                found = status = used = None
                if primary is None:
                    notes.append("primary_extractor_returned_no_content")
                else:
                    found = attempt(primary, "primary", page, url, notes)
                    if found:
                        status, used, notes = "SUCCESS", PRIMARY, []
                if found is None:
                    found = attempt(fallback, "fallback", page, url, notes)
                    status, used = ("PARTIAL", FALLBACK) if found else ("FAILED", None)
                title, body = found or (None, None)
                rows.append((key, status, used, text.decoded(title), text.decoded(body), notes))
            yield pd.DataFrame(rows, columns=names)

    return spread(pages.select("id", "url", "html")).mapInPandas(run, schema)


def process_pages(pages: DataFrame, **extractors) -> DataFrame:
    """Extraction plus text normalisation; nothing left means FAILED."""
    raw = extract_pages(pages, **extractors)
    cleaned = raw.select(
        "id",
        "extraction_status",
        "extractor",
        text.present(text.article_text(F.col("raw_title"), decoded=True)).alias("title"),
        text.present(text.article_text(F.col("raw_text"), decoded=True)).alias("text"),
        "diagnostics",
    )
    emptied = (F.col("extraction_status") != "FAILED") & F.isnull("text")
    return cleaned.select(
        "id",
        F.when(emptied, "FAILED").otherwise(F.col("extraction_status")).alias("extraction_status"),
        F.when(~emptied, F.col("extractor")).alias("extractor"),
        F.when(~emptied, F.col("title")).alias("title"),
        "text",
        F.when(
            emptied,
            F.concat("diagnostics", F.array(F.lit("normalization_returned_no_content"))),
        ).otherwise(F.col("diagnostics")).alias("diagnostics"),
    )


def extract_backlog(
    metadata: DataFrame,
    contents: DataFrame,
    pages: DataFrame,
    now: Column,
    *,
    limit: int | None = None,
    source_names: list[str] | None = None,
    **extractors,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(content rows, updated metadata rows, tallies) for articles without content.

    ``pages`` holds the fetched html by article id.
    """
    wanted = metadata
    if source_names:
        wanted = metadata.filter(F.col("source_name").isin(*source_names))
    todo = articles.backlog(wanted, contents, limit)
    fetched = pages.join(todo.select("id"), "id", "left_semi")
    extracted = process_pages(fetched, **extractors)
    return (
        articles.content_rows(extracted, now),
        articles.apply_content(todo, extracted),
        articles.extraction_tallies(extracted),
    )
