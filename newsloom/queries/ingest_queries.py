"""Queries over URLs, feeds, sitemaps, listings, candidates and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import identity, urls
from newsloom.functions.dates import feed_time
from newsloom.operators import articles
from newsloom.plans import ingest
from newsloom.queries import sql
from newsloom.queries.bindings import NOW, Newsroom
from newsloom.queries.registry import register
from newsloom.session import spread
from newsloom.sources import events, feeds

# Page URLs in the many spellings a crawler meets: upper-case scheme, default
# port, repeated, tracking and blank parameters, fragments.
_SPELLED_SQL = r"""
    SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
        regexp_replace(regexp_replace(url, '^https://([^/]*)', 'HTTPS://\1:443'),
            '^http://([^/]*)', 'http://\1:' || CASE WHEN page_id % 2 = 0 THEN 80 ELSE 8080 END)
        || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&' ELSE '?' END
        || CASE WHEN contains(url, '#') THEN '' ELSE 'b=2&b=1&UTM_Medium=x&fbclid=1&empty&z=a%20b*~' END
        AS url
    FROM pages"""
_QUERY_SQL = r"""
    array_to_string(list_transform(list_sort(list_filter(list_transform(
        list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda f: f <> ''),
        lambda f: {'key': regexp_extract(f, '^[^=]*'), 'value': regexp_replace(f, '^[^=]*=?', '')}),
        lambda p: NOT starts_with(lower(p.key), 'utm_')
            AND lower(p.key) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid'))),
        lambda p: p.key || '=' || replace(replace(p.value, '%20', '+'), '*', '%2A')), '&')"""
_CANONICAL_SQL = rf"""
    SELECT page_id, html, host, url, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END
        AS canonical_url
    FROM (
        SELECT *, {_QUERY_SQL} AS query, regexp_replace(regexp_replace(lower(regexp_extract(url,
            '^[^:]*://[^/?#]*')), '^https://(.*):443$', 'https://\1'), '^http://(.*):80$', 'http://\1')
            || coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/') AS base
        FROM ({_SPELLED_SQL}))"""
_ID_SQL = sql.uuid5(settings.NEWS_URL_NAMESPACE, "canonical_url")


def spelled_pages(room: Newsroom) -> DataFrame:
    url = F.col("url")
    port = F.when(F.col("page_id") % 2 == 0, "http://$1:80").otherwise("http://$1:8080")
    ported = F.regexp_replace(
        F.regexp_replace(url, "^https://([^/]*)", "HTTPS://$1:443"), F.lit("^http://([^/]*)"), port
    )
    extra = "b=2&b=1&UTM_Medium=x&fbclid=1&empty&z=a%20b*~"
    has = lambda mark: F.contains(url, F.lit(mark))
    tail = (
        F.when(has("#"), "").when(has("?"), F.lit("&" + extra)).otherwise(F.lit("?" + extra))
    )
    return room.table("pages").select(
        "page_id", "html", F.regexp_extract(url, "^https?://([^/?#]*)", 1).alias("host"),
        F.concat(ported, tail).alias("url"),
    )


def _identified(room: Newsroom) -> DataFrame:
    return articles.identify(spelled_pages(room), idna=False)


@register(
    "canonical_urls",
    f"SELECT page_id, canonical_url, {_ID_SQL} AS id FROM ({_CANONICAL_SQL})",
)
def canonical_urls(room: Newsroom) -> DataFrame:
    return _identified(room).select("page_id", "canonical_url", "id")


@register(
    "canonical_urls_idna",
    f"SELECT page_id, canonical_url, {_ID_SQL} AS id FROM ({_CANONICAL_SQL})",
)
def canonical_urls_idna(room: Newsroom) -> DataFrame:
    """The same with the path for international host names switched on."""
    return articles.identify(spelled_pages(room), idna=True).select("page_id", "canonical_url", "id")


@register(
    "url_duplicates",
    f"""SELECT canonical_url, count(*) AS copies, min(id) AS first_id FROM (
        SELECT canonical_url, {_ID_SQL} AS id FROM (
            SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([^:]*://[^/]*)$', '\\1/')
                AS canonical_url FROM pages))
        GROUP BY canonical_url HAVING count(*) > 1""",
)
def url_duplicates(room: Newsroom) -> DataFrame:
    """Pages that differ only in query and fragment."""
    bare = room.table("pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return articles.duplicate_groups(articles.identify(bare, idna=False), "canonical_url")


_BROKEN_SQL = r"""
    SELECT page_id, CASE page_id % 8
        WHEN 0 THEN 'ftp' || substring(url, position(':' IN url))
        WHEN 1 THEN replace(url, '://', '://user:pw@')
        WHEN 2 THEN regexp_replace(url, '^([^:]*://[^/]*)', '\1:99999')
        WHEN 3 THEN regexp_replace(url, '^([^:]*://)[^/]*', '\1')
        WHEN 4 THEN '   '
        WHEN 5 THEN regexp_replace(url, '^([^:]*://)', '\1a..')
        WHEN 6 THEN url || '/' || repeat('x', 2083)
        ELSE ' ' || url || ' ' END AS url
    FROM pages"""


def broken_urls(room: Newsroom) -> DataFrame:
    url, kind = F.col("url"), F.col("page_id") % 8
    return room.table("pages").select(
        "page_id",
        F.when(kind == 0, F.regexp_replace(url, "^[^:]*", "ftp"))
        .when(kind == 1, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(kind == 2, F.regexp_replace(url, "^([^:]*://[^/]*)", "$1:99999"))
        .when(kind == 3, F.regexp_replace(url, "^([^:]*://)[^/]*", "$1"))
        .when(kind == 4, F.lit("   "))
        .when(kind == 5, F.regexp_replace(url, "^([^:]*://)", "$1a.."))
        .when(kind == 6, F.concat(url, F.lit("/"), F.repeat(F.lit("x"), F.lit(2083))))
        .otherwise(F.concat(F.lit(" "), url, F.lit(" ")))
        .alias("url"),
    )


@register(
    "url_rejects",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'scheme_or_host' WHEN 1 THEN 'credentials'
        WHEN 2 THEN 'host_or_port' WHEN 3 THEN 'scheme_or_host' WHEN 4 THEN 'length'
        WHEN 5 THEN 'host_or_port' WHEN 6 THEN 'length' END AS problem FROM pages""",
)
def url_rejects(room: Newsroom) -> DataFrame:
    return broken_urls(room).select("page_id", urls.url_problem(F.col("url")).alias("problem"))


@register(
    "url_safety",
    r"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'scheme' WHEN 1 THEN 'credentials'
        WHEN 2 THEN 'host_or_port' WHEN 3 THEN 'no_host' WHEN 4 THEN 'scheme'
        WHEN 5 THEN 'host_or_port'
        ELSE CASE WHEN NOT regexp_matches(url, '^https?://([^/?#]*\.)?example\.(com|net)([/?#]|$)')
            THEN 'not_allowed' END END AS problem FROM pages""",
)
def url_safety(room: Newsroom) -> DataFrame:
    domains = F.array(F.lit("example.com"), F.lit("example.net"))
    return broken_urls(room).select(
        "page_id", urls.url_safety_problem(F.col("url"), domains).alias("problem")
    )


# Candidates: every page is found by the source of its host, twice over.
_CANDIDATES_SQL = f"""
    SELECT host AS source_name, page_id AS ordinal, url, canonical_url, {_ID_SQL} AS id
    FROM ({_CANONICAL_SQL})
    UNION ALL
    SELECT host, page_id + 1000000000, url, canonical_url, {_ID_SQL} FROM ({_CANONICAL_SQL})"""
_STORED_SQL = f"SELECT DISTINCT {_ID_SQL} AS id FROM ({_CANONICAL_SQL}) WHERE contains(url, '#')"


def _candidates(room: Newsroom) -> DataFrame:
    first = _identified(room).select(
        F.col("host").alias("source_name"), F.col("page_id").alias("ordinal"), "url",
        "canonical_url", "id",
        F.concat(F.lit("Page "), "page_id").alias("title"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(None).cast("string").alias("description"),
        F.lit(" https://img.example.com/x.png ").alias("image_url"),
    )
    again = first.withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    return first.unionByName(again)


def _stored(room: Newsroom) -> DataFrame:
    return _identified(room).filter(F.contains("url", F.lit("#"))).select("id").distinct()


@register(
    "new_candidates",
    f"""WITH c AS ({_CANDIDATES_SQL}),
    firsts AS (SELECT source_name, id, min(ordinal) AS ordinal FROM c GROUP BY source_name, id),
    seen AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ordinal) AS n FROM firsts),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ordinal) AS position
        FROM seen WHERE id NOT IN ({_STORED_SQL}))
    SELECT source_name, id, ordinal, position FROM fresh""",
)
def new_candidates(room: Newsroom) -> DataFrame:
    chosen = articles.select_new_candidates(_candidates(room), _stored(room))
    return chosen.select(
        "source_name", "id", "ordinal", F.col("position").cast("bigint").alias("position")
    )


@register(
    "candidate_cuts",
    f"""WITH c AS ({_CANDIDATES_SQL}),
    firsts AS (SELECT source_name, id, min(ordinal) AS ordinal FROM c GROUP BY source_name, id),
    seen AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ordinal) AS n FROM firsts),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ordinal) AS place
        FROM seen WHERE n <= {settings.CANDIDATE_LIMIT} AND id NOT IN ({_STORED_SQL})),
    counted AS (SELECT source_name, count(*) AS fresh FROM seen WHERE id NOT IN ({_STORED_SQL}) GROUP BY 1),
    held AS (SELECT source_name, count(*) AS kept FROM fresh WHERE place <= 20 GROUP BY 1)
    SELECT source_name, fresh, coalesce(kept, 0) AS kept, fresh - coalesce(kept, 0) AS cut FROM counted LEFT JOIN held USING (source_name)""",
)
def candidate_cuts(room: Newsroom) -> DataFrame:
    """What a crawl policy of 20 pages a source leaves out."""
    return articles.candidate_cuts(
        _candidates(room), _stored(room), candidate_limit=settings.CANDIDATE_LIMIT, fetch_limit=20
    )


@register(
    "seeded_metadata",
    f"""WITH c AS ({_CANDIDATES_SQL})
    SELECT id, arg_min(url, ordinal) AS url, canonical_url, any_value(source_name) AS domain_name,
        any_value(source_name) AS source_name, 'Page ' || min(ordinal) AS title,
        'https://img.example.com/x.png' AS image_url
    FROM c WHERE id NOT IN ({_STORED_SQL}) GROUP BY id, canonical_url""",
)
def seeded_metadata(room: Newsroom) -> DataFrame:
    rows, _ = ingest.discover(
        _candidates(room).drop("canonical_url", "id"), _stored(room), room.run_time
    )
    return rows.select(
        "id", "url", "canonical_url", "domain_name", "source_name", "title", "image_url"
    )


@register(
    "crawl_tallies",
    f"""WITH c AS ({_CANDIDATES_SQL}),
    seeds AS (SELECT arg_min(source_name, ordinal) AS source_name FROM c
        WHERE id NOT IN ({_STORED_SQL}) GROUP BY id),
    per AS (SELECT d.source_name, d.discovered, coalesce(s.seeded, 0) AS seeded
        FROM (SELECT source_name, count(id) AS discovered FROM c GROUP BY source_name) d
        LEFT JOIN (SELECT source_name, count(*) AS seeded FROM seeds GROUP BY source_name) s
            USING (source_name))
    SELECT source_name, CAST(sum(discovered) AS BIGINT) AS discovered,
        CAST(sum(seeded) AS BIGINT) AS seeded,
        CAST(sum(discovered) - sum(seeded) AS BIGINT) AS existing
    FROM per GROUP BY ROLLUP (source_name)""",
)
def crawl_tallies(room: Newsroom) -> DataFrame:
    tallies = articles.seed_tallies(_candidates(room), _stored(room))
    return tallies.select("source_name", "discovered", "seeded", "existing")


@register(
    "age_filter",
    sql.query(f"""SELECT id, published_time FROM articles
        WHERE published_time IS NULL OR (published_time >= {sql.NOW} - INTERVAL 10 DAYS
            AND published_time <= {sql.NOW} + INTERVAL 1 DAY)"""),
)
def age_filter(room: Newsroom) -> DataFrame:
    recent = urls.within_age(F.col("published_time"), F.lit(NOW), 10)
    return room.articles.filter(recent).select("id", "published_time")


def _rules(room: Newsroom) -> DataFrame:
    """Article patterns of the top-level domains, which stand in for sources."""
    return room.spark.createDataFrame(
        [("com", "^/(en|fr)/", None), ("net", "/[0-9]+$", "^/es/"), ("org", None, r"\.html$")],
        "source_name STRING, include STRING, exclude STRING",
    )


_PATTERN_SQL = r"""CASE tld WHEN 'com' THEN regexp_matches(path, '^/(en|fr)/')
    WHEN 'net' THEN regexp_matches(path, '/[0-9]+$') AND NOT regexp_matches(path, '^/es/')
    ELSE NOT regexp_matches(path, '\.html$') END"""
_TLD_SQL = r"regexp_extract(url, '^https?://[^/?#]*\.([a-z]+)', 1)"
_PATH_SQL = r"rtrim(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/')"


@register(
    "article_patterns",
    f"""SELECT page_id, tld AS source_name, url FROM (
        SELECT page_id, url, {_TLD_SQL} AS tld, {_PATH_SQL} AS path FROM pages)
        WHERE {_PATTERN_SQL}""",
)
def article_patterns(room: Newsroom) -> DataFrame:
    tld = F.regexp_extract("url", r"^https?://[^/?#]*\.([a-z]+)", 1)
    pages = room.table("pages").select("page_id", tld.alias("source_name"), "url")
    return feeds.matches_source(pages, _rules(room)).select("page_id", "source_name", "url")


_LINKS_SQL = r"""
    SELECT page_id, unnest(range(len(links))) AS ordinal, unnest(links) AS link, base, tld
    FROM (SELECT page_id, regexp_extract_all(regexp_replace(html,
            '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
            '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) AS links,
        regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base,
        regexp_extract(url, '^https?://[^/?#]*\.([a-z]+)', 1) AS tld FROM pages)"""


def _listing_pages(room: Newsroom) -> DataFrame:
    tld = F.regexp_extract("url", r"^https?://[^/?#]*\.([a-z]+)", 1)
    return room.table("pages").select(
        "page_id", tld.alias("source_name"), F.col("url").alias("base_url"),
        urls.url_host(F.col("url")).alias("domain"), "html",
    )


@register(
    "page_links",
    f"""SELECT page_id, ordinal, regexp_extract(replace(CASE WHEN starts_with(link, '/')
            THEN base || link ELSE link END, '&amp;', '&'), '^([^#]*)', 1) AS url
        FROM ({_LINKS_SQL})""",
)
def page_links(room: Newsroom) -> DataFrame:
    links = feeds.page_links(_listing_pages(room))
    return links.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "url")


@register(
    "listing_entries",
    rf"""WITH l AS (
        SELECT page_id, tld, url, min(ordinal) AS ordinal FROM (
            SELECT page_id, tld, ordinal, regexp_extract(replace(CASE WHEN starts_with(link, '/')
                THEN base || link ELSE link END, '&amp;', '&'), '^([^#]*)', 1) AS url, base
            FROM ({_LINKS_SQL}))
        WHERE starts_with(url, base) GROUP BY page_id, tld, url),
    ranked AS (SELECT * FROM (SELECT *, {_PATH_SQL} AS path FROM l) WHERE {_PATTERN_SQL})
    SELECT page_id, tld AS source_name, ordinal, url,
        coalesce(nullif(left(replace(string_split(url, '/')[-1], '-', ' '), 500), ''), url) AS title
    FROM ranked""",
)
def listing_entries(room: Newsroom) -> DataFrame:
    found = feeds.listing_entries(_listing_pages(room), _rules(room))
    return found.select("page_id", "source_name", "ordinal", "url", "title")


_DROP = "|".join(
    rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "nav", "footer", "aside", "form", "svg")
)


@register("page_main_text")
def page_main_text(room: Newsroom) -> DataFrame:
    """Extraction and normalisation of every page (tree rules: no SQL form)."""
    pages = room.table("pages").select(F.col("page_id").alias("id"), "url", "html")
    return ingest.process_pages(pages).select(
        "id", "extraction_status", "extractor", "title", F.sha2("text", 256).alias("text_hash"),
        F.array_join("diagnostics", ",").alias("diagnostics"),
    )


@register(
    "page_status",
    rf"""SELECT page_id AS id, CASE WHEN length(trim(regexp_replace(regexp_extract(
            regexp_replace(html, '(?is){_DROP}', '', 'g'), '(?is)<article\b[^>]*>(.*)</article>', 1),
            '<[^>]*>', ' ', 'g'))) >= 40 THEN 'PARTIAL' ELSE 'FAILED' END AS extraction_status
        FROM pages""",
)
def page_status(room: Newsroom) -> DataFrame:
    pages = room.table("pages").select(F.col("page_id").alias("id"), "url", "html")
    return ingest.process_pages(pages).select("id", "extraction_status")


@register("extraction_backlog")
def extraction_backlog(room: Newsroom) -> DataFrame:
    """Content rows of pages whose article has no content yet, by article id."""
    pages = _identified(room).select("id", "url", "html").dropDuplicates(["id"])
    metadata = pages.select(
        "id", F.lit("Untitled").alias("title"), F.lit("").alias("content_hash"),
        F.lit(NOW).cast("timestamp").alias("crawl_date"), F.lit("pages").alias("source_name"),
    )
    rows, _, _ = ingest.extract_backlog(metadata, _stored(room), pages, room.run_time)
    return rows.select("id", F.sha2("content", 256).alias("content_hash"), "extraction_status")


# Feeds: every document is a feed and its lines are the entries. One feed in five is clean RSS; the others
# have bare ampersands and HTML entities, are cut off, are Atom, or are RDF.
_LINE_SQL = r"""
    SELECT doc_id, source, lang, unnest(range(len(lines))) AS ordinal, unnest(lines) AS line
    FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS lines FROM documents)"""


def feed_documents(room: Newsroom) -> DataFrame:
    def escaped(value):
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            value = F.replace(value, F.lit(mark), F.lit(entity))
        plain = F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
        return F.when(value.rlike(r"[\x00-\x1f]"), plain).otherwise(value)

    def said(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    link = said("https://feed.", F.col("source"), ".example.com/", F.col("lang"), "/", F.col("doc_id").cast("string"), "/")
    form = F.pmod("doc_id", F.lit(5))

    def entry(line, i):
        number, hour = i.cast("string"), (i % 10).cast("string")
        title = F.when(form == 1, said(escaped(line), " R&D&nbsp;caf&eacute;")).otherwise(escaped(line))
        target = F.when(i % 7 == 3, "mailto:x").otherwise(said(link, number, "?a=1&amp;b=2#top"))
        guid = F.concat_ws("-", F.col("doc_id"), i)
        story = said(
            "&lt;p&gt;Line ", number, "&lt;/p&gt; of &lt;b&gt;feed&lt;/b&gt;&lt;script&gt;if (a) { b(); }&lt;/script&gt;"
        )
        image = said(" https://img.example.com/", number, ".png ")
        time = (
            F.when(form == 1, said("Saturday, 20 January 2024 0", hour, ":30 EST"))
            .when(form == 2, said("20 Jan 24 0", hour, ":30:00 BST"))
            .otherwise(said("Sat, 20 Jan 2024 0", hour, ":30:00 GMT"))
        )
        rss = said(
            "<item><title>", title, "</title><link>", target, "</link><guid isPermaLink='false'>", guid, "</guid><pubDate>",
            time, "</pubDate><description>", story, "</description><enclosure url='", image, "' type='image/png'/></item>",
        )
        atom = said(
            "<entry><title>", title, "</title><link rel='enclosure' href='", image, "'/><link href='", target, "'/><id>", guid,
            "</id><updated>2024-01-20T0", hour, ":30:00Z</updated><summary>", story, "</summary></entry>",
        )
        rdf = said(
            "<item rdf:about='", guid, "'><title>", title, "</title><link>", target, "</link><dc:date>2024-01-20T0", hour,
            ":30:00+02:00</dc:date><description><![CDATA[<p>Line ", number, "</p> of <b>feed</b>]]></description><media:content url='",
            image, "'/></item>",
        )
        return F.when(form == 3, atom).when(form == 4, rdf).otherwise(rss)

    items = F.array_join(F.transform(F.split("text", "\n", -1), entry), "")
    payload = (
        F.when(form == 1, said("<rss><channel><image><title>Logo</title></image><title>Feed & Co</title>", items, "</channel></rss>"))
        .when(form == 2, said("<rss><channel><title>Feed</title>", F.regexp_replace(items, "</item>$", "<comments>cut o")))
        .when(form == 3, said("<feed xmlns='http://www.w3.org/2005/Atom'><title>Feed</title>", items, "</feed>"))
        .when(form == 4, said("<rdf:RDF><channel rdf:about='f'><title>Feed</title></channel>", items, "</rdf:RDF>"))
        .otherwise(said("<rss version='2.0'><channel><title>Feed</title>", items, "</channel></rss>"))
    )
    return spread(room.table("documents").select("doc_id", "source", "lang", "text")).select(
        F.col("doc_id").alias("feed_id"), F.col("source").alias("source_name"),
        F.array(F.lit("example.com")).alias("allowed_domains"), payload.alias("payload"),
    )


_CLEAN_LINE = (
    r"regexp_replace(regexp_replace(line, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"
    r" || CASE WHEN doc_id % 5 = 1 THEN ' R&D' || chr(160) || 'café' ELSE '' END,"
    r" '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')"
)


@register(
    "feed_entries",
    rf"""SELECT doc_id AS feed_id, ordinal, left(doc_id || '-' || ordinal, 1000) AS guid,
        left(title, 500) AS title,
        'https://feed.' || source || '.example.com/' || lang || '/' || doc_id || '/' || ordinal
            || '?a=1&b=2' AS url,
        TIMESTAMP '2024-01-20 00:30:00' + to_hours(ordinal % 10)
            + to_hours(CASE doc_id % 5 WHEN 1 THEN 5 WHEN 2 THEN -1 WHEN 4 THEN -2 ELSE 0 END) AS published_at,
        'Line ' || ordinal || ' of feed' AS description,
        'https://img.example.com/' || ordinal || '.png' AS image_url
    FROM (SELECT *, {_CLEAN_LINE} AS title FROM ({_LINE_SQL}))
    WHERE title <> '' AND ordinal % 7 <> 3""",
)
def feed_entries(room: Newsroom) -> DataFrame:
    """Entries of clean, damaged and cut-off feeds in three formats."""
    return feeds.feed_entries(feed_documents(room)).select(
        "feed_id", "ordinal", "guid", "title", "url", "published_at", "description", "image_url"
    )


@register(
    "feed_report",
    rf"""SELECT doc_id AS feed_id, CASE doc_id % 5 WHEN 1 THEN 'Feed & Co' ELSE 'Feed' END AS feed_title,
        CASE doc_id % 5 WHEN 1 THEN 'references' WHEN 2 THEN 'unclosed entries, damaged entries, open document' END AS parse_warning,
        least(count(*) FILTER (ok), 10) AS entries, count(*) FILTER (NOT ok) AS skipped,
        greatest(count(*) FILTER (ok) - 10, 0) AS cut, count(*) FILTER (ok) > 10 AS truncated,
        count(*) FILTER (ok) = 0 AS unusable
    FROM (SELECT doc_id, {_CLEAN_LINE} <> '' AND ordinal % 7 <> 3 AS ok FROM ({_LINE_SQL}))
    GROUP BY doc_id""",
)
def feed_report(room: Newsroom) -> DataFrame:
    """The same feeds under a policy of ten entries: what is kept, skipped, cut and damaged."""
    return feeds.feed_report(feed_documents(room), max_entries=10).drop("source_name")


@register(
    "feed_dates",
    """SELECT event_id, CASE event_id % 8 WHEN 2 THEN date_trunc('minute', CAST(ts AS TIMESTAMP))
            WHEN 5 THEN date_trunc('day', CAST(ts AS TIMESTAMP)) WHEN 7 THEN NULL
            ELSE date_trunc('second', CAST(ts AS TIMESTAMP)) END AS published_at
        FROM events""",
)
def feed_dates(room: Newsroom) -> DataFrame:
    """Event times written in the ways of feeds, and read back."""
    ts, way = F.col("ts").cast("timestamp"), F.pmod("event_id", F.lit(8))
    ways = {
        0: ("EEE, dd MMM yyyy HH:mm:ss", " GMT", 0), 1: ("EEEE, d MMMM yyyy HH:mm:ss", " EST", -300),
        2: ("d MMM yy HH:mm", " +0530", 330), 3: ("yyyy-MM-dd'T'HH:mm:ss", "Z", 0), 4: ("EEE MMM d HH:mm:ss yyyy", "", 0),
        5: ("yyyy-MM-dd", "", 0), 6: ("dd-MMM-yyyy HH:mm:ss", " BST", 60),
    }
    written = F.lit("sometime")
    for number, (pattern, zone, minutes) in ways.items():
        local = F.timestamp_add("MINUTE", F.lit(minutes), ts)
        written = F.when(way == number, F.concat(F.date_format(local, pattern), F.lit(zone))).otherwise(written)
    return room.table("events").select("event_id", feed_time(written).alias("published_at"))


_MAP_BASE = "regexp_replace(url, '[?#].*$', '')"


def sitemap_documents(room: Newsroom) -> DataFrame:
    """A sitemap per page: three article URLs below it (every seventh map is cut off in the third), and twelve child maps."""
    base = F.regexp_replace("url", "[?#].*$", "")

    def entry(i: int):
        day = F.date_format(F.date_sub(F.lit("2024-01-20").cast("date"), (F.col("page_id") % 20).cast("int") * i), "yyyy-MM-dd")
        return F.concat(
            F.lit("<url><loc> "), base, F.lit(f"/a-story-{i} </loc><lastmod>"), day,
            F.lit("T00:00:00+00:00</lastmod></url>"),
        )

    tld = F.regexp_extract("url", r"^https?://[^/?#]*\.([a-z]+)", 1)
    last = F.when(F.col("page_id") % 7 == 0, F.lit("<url><loc>https://cut")).otherwise(F.concat(entry(2), F.lit("</urlset>")))
    return room.table("pages").select(
        tld.alias("source_name"), F.col("page_id").alias("map_ordinal"), base.alias("base"),
        F.concat(F.lit("<urlset>"), entry(0), entry(1), last).alias("payload"),
        F.concat(
            F.lit("<sitemapindex>"),
            *[F.concat(F.lit("<sitemap><loc>"), base, F.lit(f"/{i}.xml</loc></sitemap>")) for i in range(12)],
            F.lit("</sitemapindex>"),
        ).alias("index_payload"),
    )


def _map_rules(room: Newsroom) -> DataFrame:
    return _rules(room).withColumn("include", F.replace("include", F.lit("+$"), F.lit("+")))


_MAP_ENTRIES_SQL = rf"""SELECT * FROM (SELECT *, {_PATH_SQL} AS path FROM (
        SELECT page_id, page_id * 1000000 + i AS ordinal, {_TLD_SQL} AS tld, {_MAP_BASE} || '/a-story-' || i AS url,
            'a story ' || i AS title, TIMESTAMP '2024-01-20' - to_days(CAST(page_id % 20 * i AS INTEGER)) AS published_at
        FROM pages, range(3) r(i) WHERE page_id % 7 <> 0 OR i < 2))
    WHERE {_PATTERN_SQL.replace("'/[0-9]+$'", "'/[0-9]+'")}
        AND published_at >= {sql.NOW} - INTERVAL 30 DAYS AND published_at <= {sql.NOW} + INTERVAL 1 DAY"""


@register("sitemap_entries", f"SELECT tld AS source_name, ordinal, url, title, published_at FROM ({_MAP_ENTRIES_SQL})")
def sitemap_entries(room: Newsroom) -> DataFrame:
    found = feeds.sitemap_entries(sitemap_documents(room), _map_rules(room), now=NOW)
    return found.select("source_name", "ordinal", "url", "title", "published_at")


@register(
    "sitemap_children",
    f"SELECT {_TLD_SQL} AS source_name, {_MAP_BASE} || '/' || i || '.xml' AS url FROM pages, range(12) r(i)",
)
def sitemap_children(room: Newsroom) -> DataFrame:
    maps = sitemap_documents(room).withColumn("payload", F.col("index_payload"))
    return feeds.sitemap_children(maps).select("source_name", "url")


def map_forest(room: Newsroom) -> tuple[DataFrame, DataFrame]:
    """Roots and documents: an index per source and twelve pages, which names half of their maps, itself and a second
    index; that one names the other half, the first index, and a map that is not there."""
    maps = sitemap_documents(room).withColumn("group", F.floor(F.col("map_ordinal") / 12))
    maps = maps.withColumn("url", F.concat("base", F.lit("/map-"), F.col("map_ordinal").cast("string"), F.lit(".xml")))
    place = F.concat(F.lit("https://index.example/"), "source_name", F.lit("/"), F.col("group").cast("string"))

    def index(groups: DataFrame, odd: int, name: str, more: tuple[str, ...]) -> DataFrame:
        named = F.transform(F.array_sort(F.collect_set(F.when(F.col("map_ordinal") % 2 == odd, F.col("url")))), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>")))
        others = [F.concat(F.lit("<sitemap><loc>"), place, F.lit(f"{m}</loc></sitemap>")) for m in more]
        return groups.agg(F.concat(F.lit("<sitemapindex>"), *others, F.array_join(named, ""), F.lit("</sitemapindex>")).alias("payload")).select(
            "source_name", F.concat(place, F.lit(name)).alias("url"), "payload"
        )

    groups = maps.groupBy("source_name", "group")
    first = index(groups, 0, "", ("", "/b.xml"))
    second = index(groups, 1, "/b.xml", ("", "/gone.xml"))
    documents = maps.select("url", "payload").unionByName(first.select("url", "payload")).unionByName(second.select("url", "payload"))
    return first.select("source_name", "url"), documents


@register("sitemap_flow", f"SELECT tld AS source_name, url, title, published_at FROM ({_MAP_ENTRIES_SQL})")
def sitemap_flow(room: Newsroom) -> DataFrame:
    """Two levels of indexes with cycles, missing and cut-off maps: every reachable article URL once per map."""
    roots, documents = map_forest(room)
    entries, _ = feeds.sitemap_flow(roots, documents, _map_rules(room), now=NOW)
    return entries.select("source_name", "url", "title", "published_at")


@register(
    "sitemap_report",
    f"""WITH g AS (SELECT {_TLD_SQL} AS source_name, count(DISTINCT page_id // 12) AS n, count(*) AS pages,
            sum(CASE WHEN page_id % 7 = 0 THEN 2 ELSE 3 END)::BIGINT AS urls FROM pages GROUP BY 1),
        f AS (SELECT tld AS source_name, count(*) AS fitting FROM ({_MAP_ENTRIES_SQL}) GROUP BY 1)
        SELECT source_name, pages + 3 * n AS maps, n AS missing, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS cut_children,
            urls, coalesce(fitting, 0) AS fitting, greatest(coalesce(fitting, 0) - 50, 0) AS cut
        FROM g LEFT JOIN f USING (source_name)""",
)
def sitemap_report(room: Newsroom) -> DataFrame:
    """The same maps under a policy of fifty candidates per source: maps read, missing ones, URLs, and what is cut."""
    roots, documents = map_forest(room)
    return feeds.sitemap_flow(roots, documents, _map_rules(room), now=NOW, limit=50)[1]


@register(
    "source_candidates",
    rf"""SELECT source_name, count(*) AS candidates, count(title) AS titles FROM (
        SELECT source AS source_name, title FROM (SELECT *, {_CLEAN_LINE} AS title FROM ({_LINE_SQL}))
            WHERE title <> '' AND ordinal % 7 <> 3
        UNION ALL SELECT tld, title FROM ({_MAP_ENTRIES_SQL})
        UNION ALL SELECT tld, url FROM (SELECT DISTINCT page_id, tld, url, {_PATH_SQL} AS path FROM (
            SELECT page_id, tld, regexp_extract(replace(CASE WHEN starts_with(link, '/') THEN base || link ELSE link END,
                '&amp;', '&'), '^([^#]*)', 1) AS url, base FROM ({_LINKS_SQL})) WHERE starts_with(url, base))
            WHERE {_PATTERN_SQL.replace("'/[0-9]+$'", "'/[0-9]+'")})
    GROUP BY source_name""",
)
def source_candidates(room: Newsroom) -> DataFrame:
    """Feeds, sitemap indexes and listing pages, each read by its source's type, counted per source."""
    feed = feed_documents(room).withColumn("url", F.concat(F.lit("https://feeds.example/"), F.col("feed_id").cast("string")))
    roots, maps = map_forest(room)
    pages = _listing_pages(room)
    none = F.lit(None).cast("array<string>")
    sources = (
        feed.select("source_name", F.lit("rss").alias("source_type"), "url", "allowed_domains")
        .unionByName(roots.select("source_name", F.lit("SITEMAP").alias("source_type"), "url", none.alias("allowed_domains")))
        .unionByName(pages.select("source_name", F.lit("HTML").alias("source_type"), F.col("base_url").alias("url"), none.alias("allowed_domains")))
    )
    documents = (
        feed.select("url", "payload")
        .unionByName(maps)
        .unionByName(pages.select(F.col("base_url").alias("url"), F.col("html").alias("payload")))
    )
    rows = feeds.source_candidates(sources, documents, _map_rules(room), now=NOW)
    return rows.groupBy("source_name").agg(F.count("*").alias("candidates"), F.count("title").alias("titles"))


@register(
    "articles_without_content",
    """SELECT o_orderkey AS id, o_orderdate AS crawl_date FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def articles_without_content(room: Newsroom) -> DataFrame:
    """Orders stand for articles and their lines for content, at volume."""
    metadata = room.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("crawl_date")
    )
    done = room.table("lineitem").select(F.col("l_orderkey").alias("id"))
    return articles.backlog(metadata, done, 20)


@register(
    "articles_without_entities",
    sql.query("""SELECT id, crawl_date FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
)
def articles_without_entities(room: Newsroom) -> DataFrame:
    """Labelled documents stand for processed articles."""
    done = room.articles.join(room.table("labels").select("doc_id"), "doc_id", "left_semi")
    return articles.backlog(room.articles, done).select("id", "crawl_date")


@register(
    "stored_content",
    sql.query("""SELECT id, content_hash, CASE WHEN language = 'fr' THEN 'New ' || language
            ELSE title END AS title FROM articles WHERE n_chars >= 40
        UNION ALL
        SELECT id, '' AS content_hash, CASE WHEN language = 'fr' THEN 'Untitled' ELSE title END
        FROM articles WHERE n_chars < 40"""),
)
def stored_content(room: Newsroom) -> DataFrame:
    """Content written for usable articles: hash set, missing titles filled."""
    french = F.col("language") == "fr"
    metadata = room.articles.withColumn("content_hash", F.lit("")).withColumn(
        "title", F.when(french, "Untitled").otherwise(F.col("title"))
    )
    extracted = room.contents.join(room.articles.select("id", "language"), "id").select(
        "id", F.col("content").alias("text"), F.concat(F.lit(" New "), "language").alias("title"),
        F.lit("PARTIAL").alias("extraction_status"),
    )
    return articles.apply_content(metadata, extracted).select("id", "content_hash", "title")


@register(
    "full_articles",
    f"""SELECT {_ID_SQL} AS id, canonical_url, regexp_extract(canonical_url, '://([^/?#]*)', 1) AS domain_name,
        sha256(html) AS content_hash FROM ({_CANONICAL_SQL})""",
)
def full_articles(room: Newsroom) -> DataFrame:
    fetched = spelled_pages(room).select(
        F.col("url").alias("requested_url"), F.col("url").alias("final_url"),
        F.col("host").alias("source_name"), F.lit(None).cast("string").alias("title"),
        F.col("html").alias("text"), F.lit("SUCCESS").alias("extraction_status"),
        F.lit("TRAFILATURA").alias("extractor"),
    )
    metadata, _ = articles.full_articles(fetched, room.run_time)
    return metadata.select("id", "canonical_url", "domain_name", "content_hash")


_EVENT_ID = sql.uuid5(
    settings.NEWS_URL_NAMESPACE, "'news.crawled:' || id || ':2024-01-31T01:30:00+00:00'"
)
EVENT_SQL = f"""
    SELECT id AS key, '{{"event_id":"' || {_EVENT_ID} || '","event_type":"news.crawled","event_version":1,'
        || '"occurred_at":"2024-01-31T01:30:00+00:00","producer":"crawler-service","correlation_id":"'
        || id || '","causation_id":null,"aggregate_type":"news_article","aggregate_id":"' || id
        || '","idempotency_key":"' || id || '","payload":{{"article_id":"' || id
        || '","canonical_url":"' || canonical_url || '","source_name":"' || source_name
        || '","published_time":null}}}}' AS value
    FROM articles"""


@register("crawled_events", sql.query(EVENT_SQL))
def crawled_events(room: Newsroom) -> DataFrame:
    return events.crawled_events(room.articles, room.run_time)


@register(
    "batch_keys",
    f"""SELECT event_id, user_id || ':' || {sql.iso(sql.floor3('ts'))} AS batch_key FROM events""",
)
def batch_keys(room: Newsroom) -> DataFrame:
    from newsloom.functions.windows import floor_window

    start = floor_window(F.col("ts").cast("timestamp"))
    return room.table("events").select(
        "event_id", identity.batch_key(F.col("user_id").cast("string"), start).alias("batch_key")
    )
