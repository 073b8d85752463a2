"""Deterministic ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions.text import slugify

UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based uuid (RFC 4122, version 5) of a string column."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    )
    # Variant bits: keep the two low bits of the nibble, force the high ones to 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with ``+00:00``; the fraction appears only when not zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )


def article_id(canonical_url: Column) -> Column:
    return F.when(
        canonical_url.isNotNull(), uuid5(settings.NEWS_URL_NAMESPACE, canonical_url)
    )


def canonical_key(entity_type: Column, name: Column, *, catalog: bool = False) -> Column:
    """``TYPE:slug``. Catalog imports lower-case the type, runtime ids upper-case it."""
    kind = F.lower(entity_type) if catalog else F.upper(entity_type)
    return F.concat(kind, F.lit(":"), slugify(name))


def entity_id(key: Column) -> Column:
    return uuid5(settings.ENTITY_NAMESPACE, key)


def summary_id(entity: Column, window_start: Column, window_end: Column) -> Column:
    return uuid5(
        settings.SUMMARY_NAMESPACE,
        F.concat_ws(":", entity, iso_utc(window_start), iso_utc(window_end)),
    )


def batch_key(source: Column, window_start: Column) -> Column:
    return F.concat_ws(":", source, iso_utc(window_start))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def normalize_uuid(value: Column) -> Column:
    """Lower-case canonical form; anything that is not a uuid becomes null."""
    lowered = F.lower(F.trim(value))
    compact = F.regexp_replace(lowered, "^urn:uuid:|[{}-]", "")
    rebuilt = F.concat_ws(
        "-",
        F.substring(compact, 1, 8),
        F.substring(compact, 9, 4),
        F.substring(compact, 13, 4),
        F.substring(compact, 17, 4),
        F.substring(compact, 21, 12),
    )
    return F.when(compact.rlike("^[0-9a-f]{32}$"), rebuilt)
