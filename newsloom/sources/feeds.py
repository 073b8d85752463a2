"""Feeds, sitemaps and HTML listings as candidate rows.

Payload frames have one row per fetched document: source_name, payload and, for
feeds, allowed_domains. Element order is kept in ``ordinal``. Damaged documents
lose only what is damaged (see :mod:`newsloom.sources.xml_pieces`).

Lists are exploded with the outer form and filtered afterwards: from the inner
form Spark infers a size filter below it, which would parse every payload twice.
No limit holds unless the caller states one, and what a limit cuts is counted.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import html, text, urls
from newsloom.functions.binding import let
from newsloom.functions.dates import feed_time
from newsloom.session import cut_lineage
from newsloom.sources import xml_pieces

_MEDIA = "ARRAY<STRUCT<_url: STRING>>"
#: Fields of an entry in RSS, RDF and Atom alike.
ENTRY = (
    "`_rdf:about` STRING, title STRING, link ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>,"
    " guid STRUCT<_VALUE: STRING, _isPermaLink: STRING>, id STRING, pubDate STRING, published STRING, updated STRING,"
    " `dc:date` STRING, description STRING, summary STRING, content STRING, `content:encoded` STRING,"
    f" `media:thumbnail` {_MEDIA}, `media:content` {_MEDIA}, enclosure {_MEDIA}"
)
_ENTRY_FIELDS = (
    "title", "link", "guid", "id", "pubDate", "published", "updated", "dc:date", "description", "summary", "content",
    "content:encoded", "media:thumbnail", "media:content", "enclosure",
)
_FEED_ROOTS = ("rss", "feed", "rdf:RDF", "channel")
_WARNINGS = {"mended": "references", "unclosed": "unclosed entries", "damaged": "damaged entries"}


def _first_url(media: Column) -> Column:
    return text.strip(F.try_element_at(media, F.lit(1))["_url"])


def _entry(e: Column) -> dict[str, Column]:
    """The fields of an RSS, RDF or Atom entry under one name each."""

    def href(wanted: Column) -> Column:
        return F.try_element_at(wanted, F.lit(1))["_href"]

    written = F.try_element_at(F.filter(e["link"], lambda x: text.strip(x["_VALUE"]) != ""), F.lit(1))["_VALUE"]
    alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    enclosed = F.filter(e["link"], lambda x: x["_rel"] == "enclosure")
    guid = text.present(text.strip(e["guid"]["_VALUE"]))
    permanent = F.when(F.coalesce(F.lower(e["guid"]["_isPermaLink"]), F.lit("true")) != "false", guid)
    return {
        "link": F.coalesce(written, href(alternate), permanent),
        "title": e["title"],
        "guid": F.coalesce(guid, text.present(text.strip(e["id"])), e["_rdf:about"]),
        "published_at": F.coalesce(*[feed_time(e[n]) for n in ("pubDate", "published", "updated", "dc:date")]),
        "description": F.coalesce(*[text.present(e[n]) for n in ("description", "summary", "content", "content:encoded")]),
        "image_url": F.coalesce(
            _first_url(e["media:thumbnail"]),
            _first_url(e["media:content"]),
            _first_url(e["enclosure"]),
            text.strip(href(enclosed)),
        ),
    }


def _feed_title(head: Column) -> Column:
    """The title outside of all entries; that of the feed's image is none."""
    bare = F.regexp_replace(head, r"(?is)<(image|textinput)\b.*?</\1\s*>", "")
    title = F.regexp_extract(bare, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    parsed = F.from_xml(F.concat(F.lit("<f><t>"), xml_pieces.mended(title), F.lit("</t></f>")), "t STRING")
    return text.present(text.strip(parsed["t"]))


def _parsed(feeds: DataFrame, brief: bool = False) -> DataFrame:
    """Feeds with the array of all entries and that of the usable ones, in order.

    A feed is one row, so its entries are judged, ordered and cut inside the row
    and no entry is shuffled. ``brief`` entries have what they are judged by and
    no further field: nothing else drops fields out of an array of structs.
    """
    found = xml_pieces.records(F.col("payload"), ("item", "entry"), _FEED_ROOTS, ENTRY, _ENTRY_FIELDS)
    parsed = feeds.withColumn("_feed", found).drop("payload")

    def judged(r: Column, i: Column) -> Column:
        fields = _entry(r["value"])
        return F.struct(
            i.cast("bigint").alias("ordinal"),
            urls.entry_url(fields.pop("link"), F.col("allowed_domains")).alias("url"),
            text.strip(F.coalesce(fields.pop("title"), F.lit(""))).alias("title"),
            *[value.alias(name) for name, value in fields.items() if not brief],
            *[r[flag].alias(flag) for flag in _WARNINGS],
        )

    judged_entries = parsed.withColumn("_entries", F.transform("_feed.records", judged))
    usable = F.filter("_entries", lambda e: e["url"].isNotNull() & (e["title"] != ""))
    return judged_entries.withColumn("_usable", usable)


def _checked(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError("a limit must be positive")


def feed_entries(feeds: DataFrame, *, max_entries: int | None = None) -> DataFrame:
    """Usable entries of RSS, RDF and Atom feeds.

    ``feeds`` has feed_id, source_name, allowed_domains and payload. A limit per
    feed is the caller's policy; what lies beyond it is reported by :func:`feed_report`.
    """
    _checked(max_entries)
    usable = F.col("_usable") if max_entries is None else F.slice("_usable", 1, max_entries)
    entries = (
        _parsed(feeds)
        .select("feed_id", "source_name", F.posexplode_outer(usable).alias("position", "e"))
        .filter(F.col("e").isNotNull())
    )
    description = text.present(F.left(html.html_text(F.col("e.description")), F.lit(1000)))
    return entries.select(
        "feed_id",
        "source_name",
        F.col("e.ordinal").alias("ordinal"),
        (F.col("position") + 1).alias("position"),
        F.left(text.strip(F.coalesce(F.col("e.guid"), "e.url")), F.lit(1000)).alias("guid"),
        F.left("e.title", F.lit(500)).alias("title"),
        F.col("e.url").alias("url"),
        F.col("e.published_at").alias("published_at"),
        description.alias("description"),
        text.present(F.col("e.image_url")).alias("image_url"),
    )


def feed_report(feeds: DataFrame, *, max_entries: int | None = None) -> DataFrame:
    """Per feed: title, usable, skipped and cut entries, what was damaged, and feeds without any entry."""
    _checked(max_entries)

    def count(name: str) -> Column:
        return F.coalesce(F.array_size(name), F.lit(0)).cast("bigint")

    def warned(flag: str) -> Column:
        return F.when(F.exists("_entries", lambda e: e[flag]), F.lit(_WARNINGS[flag]))

    warnings = [warned(flag) for flag in _WARNINGS]
    warnings += [F.when(F.col("_feed.open"), F.lit("open document")), F.when(F.size("_entries") == 0, F.lit("no entries"))]
    counted = _parsed(feeds, brief=True).select(
        "feed_id",
        "source_name",
        _feed_title(F.col("_feed.head")).alias("feed_title"),
        text.present(F.concat_ws(", ", *warnings)).alias("parse_warning"),
        count("_entries").alias("found"),
        count("_usable").alias("usable"),
    )
    kept = F.col("usable") if max_entries is None else F.least("usable", F.lit(max_entries).cast("bigint"))
    return counted.select(
        "feed_id",
        "source_name",
        "feed_title",
        "parse_warning",
        kept.alias("entries"),
        (F.col("found") - F.col("usable")).alias("skipped"),
        (F.col("usable") - kept).alias("cut"),
        (F.col("usable") > kept).alias("truncated"),
        (F.col("usable") == 0).alias("unusable"),
    )


def _map_records(payload: Column) -> Column:
    """URL and child-map records of a sitemap document: whether a child, location, date and position."""
    found = xml_pieces.records(
        payload, ("url", "sitemap"), ("urlset", "sitemapindex"), "loc STRING, lastmod STRING", ("loc", "lastmod")
    )
    listed = F.transform(
        found["records"],
        lambda r, i: F.struct(
            (F.lower(r["name"]) == "sitemap").alias("child"),
            text.present(text.strip(r["value"]["loc"])).alias("url"),
            feed_time(r["value"]["lastmod"]).alias("published_at"),
            i.alias("position"),
        ),
    )
    return F.filter(listed, lambda r: r["url"].isNotNull())


def _map_candidates(rows: DataFrame, rules: DataFrame, now: datetime, max_days: int) -> DataFrame:
    """Rows (source_name, url, published_at, ...) that fit pattern and age, with a title."""
    kept = matches_source(rows, rules).filter(urls.within_age(F.col("published_at"), F.lit(now), max_days))
    return kept.select(
        *rows.columns,
        text.title_from_url(F.col("url")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("image_url"),
    )


def _first_of_source(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    if limit is None:
        return rows
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def sitemap_entries(maps: DataFrame, rules: DataFrame, *, now: datetime, limit: int | None = None,
                    max_days: int = settings.MAX_AGE_DAYS) -> DataFrame:
    """Article URLs of sitemaps (source_name, map_ordinal, payload), at most ``limit`` per source if given.

    ``rules`` are the article patterns of :func:`matches_source`.
    """
    _checked(limit)
    rows = (
        maps.select("source_name", "map_ordinal", F.explode_outer(_map_records(F.col("payload"))).alias("e"))
        .filter(F.col("e").isNotNull() & ~F.col("e.child"))
        .select(
            "source_name",
            (F.col("map_ordinal") * 1_000_000 + F.col("e.position")).alias("ordinal"),
            "e.url",
            "e.published_at",
        )
    )
    return _first_of_source(_map_candidates(rows, rules, now, max_days), "ordinal", limit)


def sitemap_children(maps: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Child sitemaps named by index documents, in order, the first ``limit`` of each if given."""
    _checked(limit)
    children = F.filter(_map_records(F.col("payload")), lambda r: r["child"])
    kept = children if limit is None else F.slice(children, 1, limit)
    return (
        maps.select("source_name", F.posexplode_outer(kept).alias("map_ordinal", "e"))
        .filter(F.col("e").isNotNull())
        .select("source_name", "map_ordinal", "e.url")
    )


def sitemap_flow(roots: DataFrame, documents: DataFrame, rules: DataFrame, *, now: datetime,
                 max_days: int = settings.MAX_AGE_DAYS, limit: int | None = None,
                 children: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates below root sitemaps (source_name, url), and a report per source.

    ``documents`` (url, payload) are the fetched maps. Level by level, the maps of
    the frontier are read, their URLs collected, and the children that no earlier
    level has had become the next frontier, so cycles end and every map is read
    once per source. A map that is missing or holds no record is counted and
    costs nothing else. ``children`` cuts the children of one index and ``limit``
    the candidates of a source; both are off by default and what they cut is counted.

    The candidates' ``path`` holds the positions from the root down, which order them.
    """
    _checked(limit)
    _checked(children)
    fetched = documents.select("url", "payload").dropDuplicates(["url"])
    frontier = roots.select("source_name", "url").distinct().withColumn("path", F.array().cast("array<int>"))
    visited = frontier.select("source_name", "url")
    levels: list[DataFrame] = []
    while True:
        read = frontier.join(fetched, "url", "left").select(
            "source_name", "url", "path", F.col("payload").isNull().alias("missing"),
            _map_records(F.col("payload")).alias("records"),
        )
        level = cut_lineage(read)
        levels.append(level)
        named = F.filter("records", lambda r: r["child"])
        found = level.select(
            "source_name", "path", F.explode(named if children is None else F.slice(named, 1, children)).alias("e")
        )
        below = found.groupBy("source_name", F.col("e.url").alias("url")).agg(
            F.min(F.concat("path", F.array(F.col("e.position")))).alias("path")
        )
        frontier = cut_lineage(below.join(visited, ["source_name", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("source_name", "url"))
    maps = levels[0]
    for level in levels[1:]:
        maps = maps.unionByName(level)
    listed = maps.select("source_name", "path", F.explode(F.filter("records", lambda r: ~r["child"])).alias("e")).select(
        "source_name", F.concat("path", F.array(F.col("e.position"))).alias("path"), "e.url", "e.published_at"
    )
    fitting = _map_candidates(listed, rules, now, max_days)
    entries = _first_of_source(fitting, "path", limit)
    cut_children = F.lit(0) if children is None else F.greatest(F.size(named) - children, F.lit(0))
    counted = maps.groupBy("source_name").agg(
        F.count("*").alias("maps"),
        F.count_if("missing").alias("missing"),
        F.count_if(~F.col("missing") & (F.size("records") == 0)).alias("empty"),
        F.sum(cut_children.cast("bigint")).alias("cut_children"),
        F.sum(F.size(F.filter("records", lambda r: ~r["child"])).cast("bigint")).alias("urls"),
    )
    fits = fitting.groupBy("source_name").agg(F.count("*").alias("fitting"))
    report = counted.join(fits, "source_name", "left").withColumn("fitting", F.coalesce("fitting", F.lit(0).cast("bigint")))
    kept = F.col("fitting") if limit is None else F.least("fitting", F.lit(limit).cast("bigint"))
    return entries, report.withColumn("cut", F.col("fitting") - kept)


_LOC = r"(?is)<loc\b[^>]*>(.*?)</loc>"
_HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _with_links(pages: DataFrame) -> DataFrame:
    """Pages with ``_links``: ``loc`` elements first, then anchors, in order.

    Root-relative anchors become absolute and fragments are cut.
    """
    base = F.regexp_extract("base_url", r"^([A-Za-z]+://[^/?#]*)", 1)
    # Comments and script text hold no elements.
    markup = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    bare = pages.withColumn("_markup", markup).withColumn("_base", base).drop("html")
    locs = F.regexp_extract_all("_markup", F.lit(_LOC), F.lit(1))
    anchors = F.regexp_extract_all("_markup", F.lit(_HREF), F.lit(0))

    def target(anchor: Column) -> Column:
        value = F.regexp_extract(anchor, r"(?is)\shref\s*=\s*(.*)$", 1)
        return let(
            F.regexp_replace(value, "^[\"']|[\"']$", ""),
            lambda h: F.when(F.startswith(h, F.lit("/")), F.concat("_base", h)).otherwise(h),
        )

    def plain(link: Column) -> Column:
        return F.substring_index(F.replace(link, F.lit("&amp;"), F.lit("&")), "#", 1)

    links = F.concat(F.transform(locs, lambda v: text.strip(v)), F.transform(anchors, target))
    return bare.withColumn("_links", F.transform(links, plain)).drop("_markup", "_base")


def page_links(pages: DataFrame) -> DataFrame:
    """All links of listing pages (page_id, base_url, html), unfiltered, in order."""
    rows = _with_links(pages)
    return rows.select(
        *[c for c in rows.columns if c != "_links"],
        F.posexplode_outer("_links").alias("ordinal", "url"),
    ).filter(F.col("url").isNotNull())


def listing_entries(pages: DataFrame, rules: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Links of listing pages on the page's own domain, first seen, at most ``limit`` per page if given.

    ``pages``: page_id, source_name, base_url, domain, html. A page is one row:
    its links are filtered, made distinct and cut inside it, without a shuffle.
    """
    _checked(limit)
    rows = _with_links(pages).join(_patterns(rules), "source_name", "left")

    def wanted(url: Column) -> Column:
        def own(parts: Column) -> Column:
            host = F.rtrim(parts["host"], F.lit("."))
            below = F.endswith(host, F.concat(F.lit("."), F.col("domain")))
            return parts["scheme"].isNotNull() & ((host == F.col("domain")) | below)

        return let(urls.url_parts(url), own) & _fits(url)

    own_links = F.filter(F.array_distinct("_links"), wanted)
    kept = own_links if limit is None else F.slice(own_links, 1, limit)
    entries = rows.withColumn("_kept", kept).select(
        "page_id",
        "source_name",
        "_links",
        F.explode_outer("_kept").alias("url"),
    ).filter(F.col("url").isNotNull())
    return entries.select(
        "page_id",
        "source_name",
        (F.array_position("_links", F.col("url")) - 1).alias("ordinal"),
        "url",
        text.title_from_url(F.col("url")).alias("title"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("image_url"),
    )


def _patterns(rules: DataFrame) -> DataFrame:
    """Rules per source. A source may hold most rows: Spark broadcasts rules of known small size, AQE splits the rest."""
    return rules.select("source_name", "include", "exclude")


def _fits(url: Column) -> Column:
    """The path fits the article pattern in ``include`` and ``exclude``."""
    return let(
        urls.url_path(url),
        lambda path: (F.isnull("include") | F.regexp(path, F.col("include")))
        & ~F.coalesce(F.regexp(path, F.col("exclude")), F.lit(False)),
    )


def matches_source(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates whose path fits their source's article pattern.

    ``rules``: source_name, include, exclude (regular expressions over the
    lower-case path; either may be null). A source without a rule keeps all.
    """
    joined = candidates.join(_patterns(rules), "source_name", "left")
    return joined.filter(_fits(F.col("url"))).drop("include", "exclude")


def fresh_feed_candidates(
    feeds: DataFrame, rules: DataFrame, *, now: datetime, limit: int | None = None,
    max_days: int = settings.MAX_AGE_DAYS,
) -> DataFrame:
    """Feed entries as candidates: article pattern and age applied after the limit, if there is one."""
    entries = feed_entries(feeds, max_entries=limit)
    return matches_source(entries, rules).filter(
        urls.within_age(F.col("published_at"), F.lit(now), max_days)
    )


#: What a text must hold to have records of a map: such a tag, or one that a comment or a CDATA mark cuts.
_MAP_TAG = r"(?i)<(?:url|sitemap)[\s/>]|<[a-z]*<!"


def source_candidates(sources: DataFrame, documents: DataFrame, rules: DataFrame, *, now: datetime,
                      max_days: int = settings.MAX_AGE_DAYS, limit: int | None = None) -> DataFrame:
    """Candidates of every source by its ``source_type``: feeds, sitemaps with their children, or listings.

    ``sources``: source_name, source_type (RSS, SITEMAP; any other is a listing), url,
    allowed_domains. ``documents``: url, payload. A source whose document was not
    fetched has no candidates.

    Maps are read level by level, and each level moves the documents it is given, so
    only those that can have records of a map take part; no other has a candidate.
    """
    kind = F.upper(text.strip(F.coalesce("source_type", F.lit(""))))
    sources = sources.withColumn("source_type", kind)
    pages = documents.select("url", "payload").dropDuplicates(["url"])
    roots = sources.filter(F.col("source_type") == "SITEMAP").select("source_name", "url")
    feed = sources.filter(F.col("source_type") == "RSS").join(pages, "url").withColumnRenamed("url", "feed_id")
    listing = sources.filter(~F.col("source_type").isin("RSS", "SITEMAP")).join(pages, "url").select(
        F.col("url").alias("page_id"), "source_name", F.col("url").alias("base_url"),
        urls.url_host(F.col("url")).alias("domain"), F.col("payload").alias("html"),
    )
    maps = documents.filter(F.col("payload").rlike(_MAP_TAG)).select("url", "payload")
    mapped, _ = sitemap_flow(roots, cut_lineage(maps), rules, now=now, max_days=max_days, limit=limit)
    return union_candidates(
        fresh_feed_candidates(feed, rules, now=now, max_days=max_days, limit=limit),
        mapped.withColumn("ordinal", F.try_element_at("path", F.lit(-1)).cast("bigint")),
        listing_entries(listing, rules, limit=limit),
    )


def union_candidates(*frames: DataFrame) -> DataFrame:
    """Candidates of all source types in one shape."""
    columns = ["source_name", "ordinal", "url", "title", "published_at", "description", "image_url"]
    result = frames[0].select(*columns)
    for frame in frames[1:]:
        result = result.unionByName(frame.select(*columns))
    return result
