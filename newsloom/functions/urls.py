"""URL columns: canonical form, host checks, acceptability and its reasons."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import settings
from newsloom.functions.binding import let
from newsloom.functions.text import NON_ASCII, present, strip

# scheme, authority, path, query with its mark; the fragment is dropped.
_PARTS = r"(?s)^(?i:(https?))://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
_HOST_PORT = r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::([0-9]*))?$"
_PLAIN_HOST = r"(?s)^(?i:https?)://(?:[^/?#]*@)?([^/?#@:\[\]]*)"

# Query parameters that only track the reader.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMETERS = ("fbclid", "gclid", "mc_cid", "mc_eid")


@F.pandas_udf(T.StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def encode(host: str | None) -> str | None:
        if host is None:
            return None
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    return hosts.map(encode)


def _cleaned(url: Column) -> Column:
    # Tabs and line ends inside a URL are ignored by URL parsers.
    return F.regexp_replace(strip(url), r"[\t\r\n]", "")


def _split(text: Column) -> Column:
    """Struct of scheme, authority, path and query of a cleaned URL text."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _PARTS, i)

    fields = F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("authority"),
        part(3).alias("path"),
        F.substr(part(4), F.lit(2)).alias("query"),
    )
    return F.when(part(1) != "", fields)  # a match has a scheme


def _with_host(split: Column) -> Column:
    def located(host_port: Column) -> Column:
        matched = host_port.rlike(_HOST_PORT)
        host = F.lower(F.regexp_extract(host_port, _HOST_PORT, 1))
        return F.struct(
            split["scheme"].alias("scheme"),
            F.contains(split["authority"], F.lit("@")).alias("credentials"),
            split["authority"].alias("authority"),
            F.when(matched, F.regexp_replace(host, r"[\[\]]", "")).alias("host"),
            F.when(matched, present(F.regexp_extract(host_port, _HOST_PORT, 2)))
            .try_cast("bigint")
            .alias("port"),
            split["path"].alias("path"),
            split["query"].alias("query"),
        )

    return let(F.regexp_replace(split["authority"], "^.*@", ""), located)


def url_parts(url: Column) -> Column:
    """Struct of scheme, credentials flag, authority, host, port, path and query.

    The scheme is null for anything that is not an http(s) URL, the host when it
    cannot be read.
    """
    return let(_cleaned(url), lambda text: let(_split(text), _with_host))


def _valid_host(encoded: Column) -> Column:
    """A lower-case host in ASCII without the trailing dot; null when it is not valid."""
    labels = F.split(F.regexp_replace(encoded, r"\.$", ""), r"\.", -1)
    valid = F.forall(labels, lambda x: F.length(x).between(1, 63)) & ~encoded.rlike(NON_ASCII)
    return F.when(valid, F.rtrim(encoded, F.lit(".")))


def _located(url: Column, idna: bool, body: Callable[[Column, Column], Column]) -> Column:
    """``body(parts, ascii host)``, each computed once.

    Only non-ASCII hosts reach the Arrow UDF. It cannot take a value from inside
    a lambda, so its host is cut from the URL by a plain pattern.
    """
    if not idna:
        return let(
            url_parts(url),
            lambda parts: let(_valid_host(parts["host"]), lambda host: body(parts, host)),
        )
    name = F.lower(F.regexp_extract(_cleaned(url), _PLAIN_HOST, 1))
    encoded = _idna(F.when(name.rlike(NON_ASCII), name))
    both = F.struct(url_parts(url).alias("parts"), encoded.alias("encoded"))
    return let(
        both,
        lambda b: let(
            _valid_host(F.coalesce(b["encoded"], b["parts"]["host"])),
            lambda host: body(b["parts"], host),
        ),
    )


def _unquote(text: Column) -> Column:
    # A % that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _quote(text: Column) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """Query without tracking parameters, sorted by key and value, re-encoded."""
    fields = F.filter(F.split(query, "&", -1), lambda f: f != "")
    pairs = F.transform(
        fields,
        lambda f: F.struct(
            _unquote(F.substring_index(f, "=", 1)).alias("key"),
            F.when(F.contains(f, F.lit("=")), _unquote(F.regexp_replace(f, "^[^=]*=", "")))
            .otherwise(F.lit(""))
            .alias("value"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.startswith(F.lower(p["key"]), F.lit(TRACKING_PREFIX))
        & ~F.lower(p["key"]).isin(*TRACKING_PARAMETERS),
    )
    return F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(_quote(p["key"]), F.lit("="), _quote(p["value"])),
        ),
        "&",
    )


def _problem(length: Column, parts: Column, host: Column) -> Column:
    return (
        F.when(length.isNull() | ~length.between(1, 2083), "length")
        .when(parts["scheme"].isNull(), "scheme_or_host")
        .when(parts["credentials"], "credentials")
        .when(parts["host"].isNull() | (F.coalesce(parts["port"], F.lit(0)) > 65535), "host_or_port")
        .when(parts["host"] == "", "scheme_or_host")
        .when(host.isNull() | (host == ""), "host_or_port")
    )


def _assembled(parts: Column, host: Column) -> Column:
    literal = F.when(
        F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))
    ).otherwise(host)
    default_port = F.when(parts["scheme"] == "https", 443).otherwise(80)
    port = F.when(
        parts["port"].isNotNull() & (parts["port"] != default_port),
        F.concat(F.lit(":"), parts["port"].cast("string")),
    ).otherwise("")
    path = F.when(parts["path"] == "", "/").otherwise(parts["path"])
    query = let(
        F.coalesce(canonical_query(parts["query"]), F.lit("")),
        lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )
    return F.concat(parts["scheme"], F.lit("://"), literal, port, path, query)


def url_identity(url: Column, *, idna: bool = False) -> Column:
    """Struct of the canonical URL and, where there is none, the problem.

    International host names need ``idna=True``, which adds an Arrow UDF that
    sees only those hosts; without it they are reported as a host problem.
    """
    length = F.length(strip(url))

    def judge(parts: Column, host: Column) -> Column:
        return let(
            _problem(length, parts, host),
            lambda problem: F.struct(
                F.when(problem.isNull(), _assembled(parts, host)).alias("canonical_url"),
                problem.alias("problem"),
            ),
        )

    return _located(url, idna, judge)


def url_problem(url: Column, *, idna: bool = False) -> Column:
    """Why a URL has no canonical form; null when it has one."""
    length = F.length(strip(url))
    return _located(url, idna, lambda parts, host: _problem(length, parts, host))


def canonical_url(url: Column, *, idna: bool = False) -> Column:
    """Stable form of a news URL; null when :func:`url_problem` names a reason."""
    return url_identity(url, idna=idna)["canonical_url"]


def url_host(canonical: Column) -> Column:
    """Host of a canonical URL, without the port."""
    return F.regexp_extract(canonical, r"^https?://(\[[^\]]*\]|[^/:?#]*)", 1)


def url_authority(canonical: Column) -> Column:
    """Host of a canonical URL with the port, if it shows one."""
    return F.regexp_extract(canonical, r"^https?://([^/?#]*)", 1)


def normalize_domain(value: Column) -> Column:
    """Plain lower-case host name; null when it carries a scheme, path or port."""
    return let(F.rtrim(F.lower(strip(value)), F.lit(".")), _plain_domain)


def _plain_domain(name: Column) -> Column:
    return F.when((name != "") & ~name.rlike("[/:]"), _valid_host(name))


def host_is_allowed(host: Column, domains: Column) -> Column:
    """Host equals one of the domains or is below one of them."""
    return F.exists(
        domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))
    )


def _unsafe(parts: Column, host: Column, domains: Column) -> Column:
    return (
        F.when(parts["scheme"].isNull(), "scheme")
        .when(parts["host"] == "", "no_host")
        .when(parts["credentials"], "credentials")
        .when(
            host.isNull()
            | F.contains(host, F.lit(":"))
            | (F.coalesce(parts["port"], F.lit(0)) > 65535),
            "host_or_port",
        )
        .when(~F.coalesce(parts["port"], F.lit(80)).isin(80, 443), "port")
        .when(~host_is_allowed(host, domains), "not_allowed")
    )


def url_safety_problem(url: Column, domains: Column, *, idna: bool = False) -> Column:
    """First failed static safety rule of a URL; null when all pass."""
    return _located(url, idna, lambda parts, host: _unsafe(parts, host, domains))


def entry_url(url: Column, domains: Column, *, idna: bool = False) -> Column:
    """URL of a feed entry without its fragment; null when it is not acceptable."""

    def accept(parts: Column, host: Column) -> Column:
        query = F.when(
            F.coalesce(parts["query"], F.lit("")) != "", F.concat(F.lit("?"), parts["query"])
        ).otherwise("")
        path = F.when(parts["path"] == "", "/").otherwise(parts["path"])
        return F.when(
            _unsafe(parts, host, domains).isNull(),
            F.concat(parts["scheme"], F.lit("://"), parts["authority"], path, query),
        )

    return _located(url, idna, accept)


def url_path(url: Column) -> Column:
    """Lower-case path without trailing slashes, for article patterns."""
    path = F.regexp_extract(_cleaned(url), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.rtrim(F.lower(path), F.lit("/"))


def within_age(published: Column, now: Column, max_days: int = settings.MAX_AGE_DAYS) -> Column:
    """Undated, or at most ``max_days`` old and at most one day ahead."""
    return published.isNull() | published.between(
        now - F.expr(f"INTERVAL {max_days} DAYS"), now + F.expr("INTERVAL 1 DAY")
    )
