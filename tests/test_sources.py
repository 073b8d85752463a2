import hashlib
import json
import tempfile
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.dates import feed_time
from newsloom.operators import articles, quality
from newsloom.plans import catalog_import, ingest, serving
from newsloom.sources import artifacts, catalog, events, feeds, tables
from newsloom.streaming import pointers

NOW = datetime(2026, 8, 20, 12, tzinfo=UTC)


def moment():
    return F.lit(NOW).cast("timestamp")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel>
<title>Feed</title>
<item><guid isPermaLink="false">g1</guid><title><![CDATA[ Big <win> ]]></title><link>https://news.example.com/a#x</link>
<pubDate>Thu, 20 Aug 2026 07:00:00 GMT</pubDate><description><![CDATA[<p>Hello <b>you</b></p>]]></description>
<media:thumbnail url="https://i.example.com/1.jpg"/><media:content url="https://i.example.com/2.jpg"/></item>
<item><title>Other site</title><link>https://evil.test/b</link></item>
<item><title>Second</title><link>https://example.com/c</link><enclosure url="https://i.example.com/3.jpg"/></item>
<item><title> </title><link>https://example.com/d</link></item>
<item><title>Third</title><link>https://example.com/e</link></item></channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>T</title>
<link rel="enclosure" href="https://i.example.com/p.png"/><link href="https://example.com/x"/>
<id>urn:1</id><updated>2026-08-20T09:00:00Z</updated><summary>S &amp;amp; s</summary></entry></feed>"""


def feed_frame(spark, *payloads):
    rows = [(i, "S", ["example.com"], p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "feed_id int, source_name string, allowed_domains array<string>, payload string")


def test_rss(spark):
    feed = feed_frame(spark, RSS, "<rss><channel><title>broken")
    rows = feeds.feed_entries(feed, max_entries=2).orderBy("ordinal").collect()
    assert [(r["guid"], r["title"], r["url"]) for r in rows] == [
        ("g1", "Big <win>", "https://news.example.com/a"), ("https://example.com/c", "Second", "https://example.com/c")]
    assert rows[0]["published_at"] == datetime(2026, 8, 20, 7) and rows[0]["description"] == "Hello you"
    assert [r["image_url"] for r in rows] == ["https://i.example.com/1.jpg", "https://i.example.com/3.jpg"]
    report = {r["feed_id"]: r for r in feeds.feed_report(feed, max_entries=2).collect()}
    assert (report[0]["entries"], report[0]["skipped"], report[0]["truncated"], report[0]["unusable"]) == (2, 2, True, False)
    assert report[1]["unusable"]


def test_atom(spark):
    row = feeds.feed_entries(feed_frame(spark, ATOM), max_entries=5).first()
    assert (row["guid"], row["url"], row["description"]) == ("urn:1", "https://example.com/x", "S & s")
    assert row["published_at"] == datetime(2026, 8, 20, 9) and row["image_url"] == "https://i.example.com/p.png"


def test_damaged_feeds_keep_their_entries(spark):
    link = "<link>https://example.com/{}</link>"
    payloads = [
        "<rss><channel><item><title>One</title>" + link.format(1),
        "<rss><channel><title>R&D &copy; news</title><item><title>A & B&nbsp;&eacute;</title>" + link.format("a?x=1&y=2")
        + "</item><item><title>bad <b>mark-up</title>" + link.format(2) + "<guid foo=bar>g</guid></item>"
        + "<item><title>No end</title>" + link.format(3) + "<item><title>1 < 2 &#0;&unknown;</title>" + link.format(4) + "</item></channel></rss>",
        "<rdf:RDF><channel><title>Old</title></channel><item rdf:about='id-1'><title>R</title>" + link.format(5)
        + "<dc:date>2026-08-20T09:00+02:00</dc:date></item></rdf:RDF>",
        "<rss><channel><item><title><![CDATA[<item> & more]]></title><guid>https://example.com/6</guid>"
        "<description><![CDATA[<style>p {}</style><p>Text</p><script>x()</script>]]></description></item></channel></rss>",
        "not a feed", "", None,
    ]
    feed = feed_frame(spark, *payloads)
    rows = [(r.feed_id, r.title, r.url) for r in feeds.feed_entries(feed).orderBy("feed_id", "ordinal").collect()]
    at = "https://example.com/"
    assert rows == [
        (0, "One", at + "1"), (1, "A & B\u00a0é", at + "a?x=1&y=2"), (1, "bad <b>mark-up", at + "2"), (1, "No end", at + "3"),
        (1, "1 < 2 &unknown;", at + "4"), (2, "R", at + "5"), (3, "<item> & more", at + "6"),
    ]
    found = {r.feed_id: r for r in feeds.feed_entries(feed).filter("ordinal = 0").collect()}
    assert (found[2].guid, found[2].published_at, found[3].description) == ("id-1", datetime(2026, 8, 20, 7), "Text")
    report = {r.feed_id: r for r in feeds.feed_report(feed, max_entries=3).collect()}
    assert [report[i].parse_warning for i in range(7)] == [
        "unclosed entries, open document", "references, unclosed entries, damaged entries", None, None,
        *["open document, no entries"] * 3,
    ]
    assert [report[i].feed_title for i in (0, 1, 2)] == [None, "R&D © news", "Old"]
    assert (report[1].entries, report[1].cut, report[1].truncated, report[5].unusable) == (3, 1, True, True)
    with pytest.raises(ValueError):
        feeds.feed_entries(feed, max_entries=0)


@pytest.mark.parametrize(
    "written, instant",
    [
        ("Thu, 20 Aug 2026 07:00:00 GMT", (2026, 8, 20, 7)), ("Thursday, 20 August 2026 07:00:00 EST", (2026, 8, 20, 12)),
        ("20 Aug 26 07:00 EDT", (2026, 8, 20, 11)), ("20 Aug 95 07:00 BST", (1995, 8, 20, 6)), ("2026-08", (2026, 8, 1)),
        ("2026-08-20T07:00Z", (2026, 8, 20, 7)), ("2026-08-20T07:00:01.5+02:00", (2026, 8, 20, 5, 0, 1, 500_000)),
        ("Sat Jan 20 02:30:00 EST 2024", (2024, 1, 20, 7, 30)), ("Thu, 20 Aug 2026 07:00:00 +0530 (IST)", (2026, 8, 20, 1, 30)),
        ("20-Aug-2026 07:00:00 GMT-2", (2026, 8, 20, 9)), ("31 Feb 2024 00:00:00 GMT", None), ("1 Xyz 2026", None), ("", None), (None, None),
    ],
)
def test_feed_dates(spark, written, instant):
    row = spark.createDataFrame([(written,)], "v string").select(feed_time(F.col("v")).alias("t")).first()
    assert row.t == (datetime(*instant) if instant else None)


def test_sitemap_flow(spark):
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    pages = [("r", index("a", "b", "r", "gone", "bad")), ("a", "<urlset><url><loc>https://x.org/1</loc></url>"),
             ("b", index("a", "c")), ("c", "<urlset><url><loc>https://x.org/2</loc><lastmod>2020-01-01</lastmod></url>"
                                          "<url><loc>https://x.org/3</loc><lastmod>never</lastmod></url></urlset>"), ("bad", "oops")]
    documents = spark.createDataFrame(pages, "url string, payload string")
    roots = spark.createDataFrame([("S", "r"), ("S", "r"), ("E", "none")], "source_name string, url string")
    rules = spark.createDataFrame([], "source_name string, include string, exclude string")
    entries, report = feeds.sitemap_flow(roots, documents, rules, now=NOW)
    assert [(r.source_name, r.url) for r in entries.orderBy("path").collect()] == [("S", "https://x.org/1"), ("S", "https://x.org/3")]
    counts = {r.source_name: tuple(r)[1:] for r in report.collect()}
    assert counts == {"S": (6, 1, 1, 0, 3, 2, 0), "E": (1, 1, 0, 0, 0, 0, 0)}
    entries, report = feeds.sitemap_flow(roots, documents, rules, now=NOW, children=1, limit=1)
    assert [r.url for r in entries.collect()] == ["https://x.org/1"]
    assert {r.source_name: (r.maps, r.cut_children, r.cut) for r in report.collect()}["S"] == (2, 4, 0)
    empty, report = feeds.sitemap_flow(roots.limit(0), documents, rules, now=NOW)
    assert (empty.count(), report.count()) == (0, 0)


def test_sources_are_read_by_their_type(spark):
    sources = spark.createDataFrame(
        [("F", " rss", "f", ["example.com"]), ("M", "SITEMAP", "m", None), ("H", "HTML", "https://x.org/", None), ("N", None, "gone", None)],
        "source_name string, source_type string, url string, allowed_domains array<string>")
    documents = spark.createDataFrame(
        [("f", RSS), ("m", "<urlset><url><loc>https://x.org/1</loc></url></urlset>"), ("https://x.org/", "<a href='/q'>q</a>")],
        "url string, payload string")
    rules = spark.createDataFrame([], "source_name string, include string, exclude string")
    rows = feeds.source_candidates(sources, documents, rules, now=NOW).orderBy("source_name", "ordinal").collect()
    assert [(r.source_name, r.url) for r in rows] == [
        ("F", "https://news.example.com/a"), ("F", "https://example.com/c"), ("F", "https://example.com/e"),
        ("H", "https://x.org/q"), ("M", "https://x.org/1")]


def test_sitemap_and_patterns(spark):
    payload = ("<urlset><url><loc>https://x.org/news/one-two</loc><lastmod>2026-08-19T00:00:00+00:00</lastmod></url>"
               "<url><loc>https://x.org/news/old</loc><lastmod>2020-01-01</lastmod></url>"
               "<url><loc>https://x.org/video/v</loc></url></urlset>")
    maps = spark.createDataFrame([("S", 0, payload)], "source_name string, map_ordinal int, payload string")
    rules = spark.createDataFrame([("S", "^/news/", None)], "source_name string, include string, exclude string")
    rows = feeds.sitemap_entries(maps, rules, now=NOW, limit=10).collect()
    assert [(r["url"], r["title"]) for r in rows] == [("https://x.org/news/one-two", "one two")]


def test_listing(spark):
    page = ("<html><loc>https://x.org/z</loc><!-- <a href='/no'>n</a> --><a class=q href='/a-b#f'>1</a>"
            '<a href="https://x.org/a-b">2</a><a href="https://other.org/c">3</a><a href=https://m.x.org/d?e=1&amp;f=2>4</a></html>')
    pages = spark.createDataFrame(
        [(1, "S", "https://x.org/list", "x.org", page)],
        "page_id int, source_name string, base_url string, domain string, html string")
    rules = spark.createDataFrame([], "source_name string, include string, exclude string")
    rows = feeds.listing_entries(pages, rules, limit=10).orderBy("ordinal").collect()
    assert [r["url"] for r in rows] == ["https://x.org/z", "https://x.org/a-b", "https://m.x.org/d?e=1&f=2"]


def test_source_selection_and_rules(spark):
    sources = spark.createDataFrame(
        [("BBC Sport - X", "u", "RSS", ["b"], True, True), ("Reuters Soccer", "u", "HTML", ["r"], False, False)],
        catalog.SOURCE_COLUMNS)
    assert [r["source_name"] for r in catalog.select_sources(sources).collect()] == ["BBC Sport - X"]
    assert catalog.select_sources(sources, ["Reuters Soccer"]).count() == 1
    known = catalog.default_sources(spark)
    assert (known.count(), catalog.select_sources(known).count()) == (21, 12)
    urls = spark.createDataFrame(
        [("BBC Sport - X", "https://b/sport/articles/1"), ("BBC Sport - X", "https://b/sport/live"),
         ("Reuters Soccer", "https://r/sports/soccer/"), ("Reuters Soccer", "https://r/sports/soccer/x")],
        "source_name string, url string")
    kept = feeds.matches_source(urls, catalog.article_rules(sources)).collect()
    assert {r["url"] for r in kept} == {"https://b/sport/articles/1", "https://r/sports/soccer/x"}


PAGE = """<!doctype html><html><head><title>Page title</title><script>var x = "<p>no</p>";</script></head><body>
<nav><a href=/>Home</a></nav><div>Outside</div><main><h1>Big <em>win</em></h1><p>Arsenal &amp; Spurs played a long game here.</p>
<aside>Related <p>stuff</p></aside><p>Arsenal &amp; Spurs played a long game here.</p><br><ul><li>End</ul></main><footer>f</footer></body></html>"""


def test_page_extraction(spark):
    pages = spark.createDataFrame(
        [("a", "u", PAGE), ("b", "u", "<p>short</p>"), ("c", "u", "<body><p>" + "long enough text " * 4 + "</body>")],
        "id string, url string, html string")
    rows = {r["id"]: r for r in ingest.process_pages(pages).collect()}
    assert rows["a"]["title"] == "Big win" and rows["a"]["extraction_status"] == "PARTIAL"
    assert rows["a"]["text"] == ("Big win Arsenal & Spurs played a long game here."
                                 " Arsenal & Spurs played a long game here. End")
    assert rows["a"]["diagnostics"] == ["primary_extractor_returned_no_content"]
    assert rows["b"]["extraction_status"] == "FAILED" and rows["b"]["text"] is None
    assert rows["b"]["diagnostics"][1] == "fallback_extractor_returned_no_content"
    assert rows["c"]["title"] is None

    def primary(page, url):
        if "short" in page:
            raise KeyError
        return "T", "x" * 40

    rows = {r["id"]: r for r in ingest.process_pages(pages, primary=primary).collect()}
    assert (rows["a"]["extraction_status"], rows["a"]["extractor"], rows["a"]["diagnostics"]) == ("SUCCESS", "TRAFILATURA", [])
    assert rows["b"]["diagnostics"][0] == "primary_extractor_error:KeyError"


def candidate_rows(spark, *urls):
    rows = [("S", i, u, f"T{i}", None, None, None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, schemas.CANDIDATES)


def test_seeding_is_insert_only(spark):
    found = candidate_rows(spark, "https://x.org/a?utm_source=q", "https://x.org/a", "bad", "https://x.org/b")
    nothing = spark.createDataFrame([], "id string")
    rows, tallies = ingest.discover(found, nothing, moment())
    seeded = {r["canonical_url"]: r for r in rows.collect()}
    assert set(seeded) == {"https://x.org/a", "https://x.org/b"}
    assert seeded["https://x.org/a"]["title"] == "T0" and seeded["https://x.org/a"]["domain_name"] == "x.org"
    total = [r for r in tallies.collect() if r["source_name"] is None][0]
    assert (total["discovered"], total["seeded"], total["existing"], total["rejected"]) == (3, 2, 1, 1)
    again, tallies = ingest.discover(found, rows.select("id"), moment())
    assert again.count() == 0 and [r["seeded"] for r in tallies.collect()] == [0, 0]


def test_candidate_limits_follow_input_order(spark):
    found = articles.identify(candidate_rows(spark, *[f"https://x.org/{i // 2}" for i in range(20)]))
    stored = found.filter("url = 'https://x.org/0'").select("id").distinct()
    rows = articles.select_new_candidates(found, stored, candidate_limit=5, fetch_limit=3).collect()
    assert sorted(r["url"] for r in rows) == [f"https://x.org/{i}" for i in (1, 2, 3)]
    assert articles.select_new_candidates(found, stored).count() == 9
    cut = articles.candidate_cuts(found, stored, candidate_limit=5, fetch_limit=3).first()
    assert (cut["fresh"], cut["kept"], cut["cut"]) == (9, 3, 6)
    with pytest.raises(ValueError):
        articles.select_new_candidates(found, stored, fetch_limit=0)


@pytest.mark.parametrize("values", [[5], [3, 3, 3], [-7, 0, 2, 9_000_000_000, -7], [*range(-300, 900, 7)], [0, 1 << 61, 255, 256]])
def test_distribution_equals_the_sorted_column(spark, values):
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x bigint")
    row = articles.distribution(frame, "x").first()
    ordered, n = sorted(values), len(values)
    middle = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert tuple(row) == (n, sum(values) / n, middle, *(ordered[min(int(q * n), n - 1)] for q in (0.9, 0.95, 0.99)))
    near = articles.approximate_distribution(frame, "x").first()
    assert near["n"] == n and ordered[0] <= near["p90"] <= ordered[-1]


def test_distribution_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x bigint")
    assert tuple(articles.distribution(empty, "x").first()) == (0, None, None, None, None, None)


def test_replay_leaves_out_what_is_still_wrong(spark):
    rejected = spark.createDataFrame([("p1",), ("p1",), ("p2",)], "payload_id string")
    mended = spark.createDataFrame([("p1", "still {"), ("p2", None), ("p9", "x")], "payload_id string, value string")
    replayed, gained = pointers.replay(rejected, mended, spark.createDataFrame([], "payload_id string"))
    assert replayed.count() == 0 and gained.count() == 0  # what is still wrong may be mended again


def test_catalog_import(spark, folder):
    path = Path(folder) / "aliases.json"
    clubs = {"season": "2026", "leagues": {"L1": [{"club": "Arsenal FC", "alias": ["Gunners", "gunners ", "AFC"]}],
                                           "L2": [{"club": "Bayern München", "alias": []}]}}
    path.write_text(json.dumps(clubs), encoding="utf-8")
    nothing = spark.createDataFrame([], schemas.CANONICAL_ENTITIES)
    first = catalog_import.import_catalog(spark, str(path), nothing, moment())
    rows = {r["canonical_key"]: r for r in first.collect()}
    assert set(rows) == {"club:arsenal-fc", "club:bayern-munchen"}
    assert [a["value"] for a in rows["club:arsenal-fc"]["aliases"]] == ["Arsenal FC", "Gunners", "AFC"]
    stored = spark.createDataFrame([tuple(r) for r in rows.values()], schemas.CANONICAL_ENTITIES)
    later = catalog_import.import_catalog(spark, str(path), stored, F.lit("2027-01-01").cast("timestamp"))
    assert {r["created_at"] for r in later.collect()} == {NOW.replace(tzinfo=None)}
    assert {r["updated_at"].year for r in later.collect()} == {2027}
    clubs["leagues"]["L2"].append({"club": "Other", "alias": ["AFC"]})
    path.write_text(json.dumps(clubs), encoding="utf-8")
    with pytest.raises(ValueError, match="afc"):
        catalog_import.import_catalog(spark, str(path), nothing, moment())


def test_rows_are_replaced_inside_their_day(spark, folder):
    schema = "id string, v int, at timestamp"
    path = f"{folder}/table"
    first = spark.createDataFrame([("a", 1, NOW), ("b", 1, NOW), ("c", 1, datetime(2026, 8, 1))], schema)
    tables.replace_rows(spark, path, first, schema, key="id", day_of="at")
    change = spark.createDataFrame([("b", 2, NOW), ("d", 2, NOW)], schema)
    for _ in range(2):
        tables.replace_rows(spark, path, change, schema, key="id", day_of="at")
    rows = tables.read(spark, path, schema).collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]


def test_versions_of_a_table(spark, folder):
    root = f"{folder}/small"
    assert tables.read_version(spark, root, "id int").count() == 0
    tables.write_version(spark.range(2).selectExpr("cast(id as int) id"), root)
    newer = tables.read_version(spark, root, "id int").selectExpr("id + 10 AS id")
    tables.write_version(newer, root)
    assert sorted(r["id"] for r in tables.read_version(spark, root, "id int").collect()) == [10, 11]


def test_artifacts(spark, folder):
    def store(name, content, **changes):
        place = Path(folder) / name
        place.mkdir()
        (place / "content.html").write_bytes(content)
        metadata = {"content_type": "text/html", "etag": None, "last_modified": None,
                    "content_length": len(content), "content_sha256": hashlib.sha256(content).hexdigest()}
        projection = {"title": "T", "cleaned_text": "x", "status": "SUCCESS", "extractor": "TRAFILATURA", "diagnostics": []}
        metadata.update({k: v for k, v in changes.items() if k in metadata})
        projection.update({k: v for k, v in changes.items() if k in projection})
        (place / "metadata.json").write_text(json.dumps(metadata))
        (place / "projection.json").write_text(json.dumps(projection))

    store("good", b"<p>x</p>")
    store("tampered", b"<p>y</p>", content_sha256="0" * 64)
    store("failed", b"<p>z</p>", status="FAILED")
    rows = quality.artifact_problems(artifacts.read_artifacts(spark, folder)).collect()
    assert {r["id"]: r["problems"] for r in rows} == {
        "good": [], "tampered": ["hash_mismatch"], "failed": ["failed_with_content", "failed_without_diagnostics"]}


ARTICLE = "5db0e01d-f89b-5d9e-9f51-e6accbbfddb2"


def test_event_contract(spark):
    rows = spark.createDataFrame([(ARTICLE, "https://x.org/a", "X")], "id string, canonical_url string, source_name string")
    good = json.loads(events.crawled_events(rows, moment()).first()["value"])
    assert list(good) == list(schemas.CRAWLED_EVENT_FIELDS)
    broken = {
        "aggregate_mismatch": {**good, "aggregate_id": "11111111-1111-4111-8111-111111111111"},
        "occurred_at": {**good, "occurred_at": "2026-08-20T10:00:00"},
        "unknown_field": {**good, "extra": 1},
        "source_name": {**good, "payload": {**good["payload"], "source_name": ""}},
        "missing_field": {k: v for k, v in good.items() if k != "causation_id"},
    }
    for problem, event in {None: good, **broken}.items():
        frame = spark.createDataFrame([(json.dumps(event),)], "value string")
        assert quality.check_events(frame).first()["problems"] == ([problem] if problem else [])


def test_pointer_stream_equals_batch(spark, folder):
    catalog_rows = spark.createDataFrame(
        [("e1", "CLUB", "Arsenal FC", [("Gunners", "gunners", False)], "ACTIVE", "club:arsenal-fc")],
        "id string, entity_type string, canonical_name string,"
        " aliases array<struct<value: string, normalized_value: string, case_sensitive: boolean>>,"
        " status string, canonical_key string")
    contents = spark.createDataFrame([(ARTICLE, "The Gunners won", None, None, None, None, None)], schemas.NEWS_CONTENT)
    contents.write.parquet(f"{folder}/content")
    missing = "11111111-1111-4111-8111-111111111111"
    rows = spark.createDataFrame(
        [(ARTICLE, "https://x.org/a", "X"), (missing, "https://x.org/b", "X")],
        "id string, canonical_url string, source_name string")
    process = pointers.article_processor(
        spark, content_path=f"{folder}/content", entities_path=f"{folder}/entities",
        filtered_path=f"{folder}/filtered", catalog=catalog_rows)
    # The same articles on two days: one row each, and none while the content is missing.
    for day in (0, 1):
        published = events.crawled_events(rows, moment() + F.make_dt_interval(F.lit(day)))
        events.publish(published, path=f"{folder}/topic")
        stream = pointers.accepted(pointers.decode(pointers.read_files(spark, f"{folder}/topic")))
        pointers.drain(stream, process, f"{folder}/checkpoint").awaitTermination()
    done = tables.read(spark, f"{folder}/entities", schemas.NEWS_ENTITIES)
    found = done.collect()
    assert [r["id"] for r in found] == [ARTICLE] and found[0]["error"] is None
    assert [e["canonical_entity_id"] for e in found[0]["entities"]] == ["e1"]
    assert [r["id"] for r in articles.backlog(rows, done).collect()] == [missing]
    filtered = tables.read(spark, f"{folder}/filtered", pointers.FILTERED)
    assert [tuple(r) for r in articles.with_filtered(contents, filtered).select("content", "filtered_content").collect()] == [
        ("The Gunners won", "The Arsenal FC won")]


def test_rejected_pointers_are_kept(spark, folder):
    topic = f"{folder}/topic"
    spark.createDataFrame([("no json",), ("{}",)], "value string").write.text(topic)
    decoded = pointers.decode(pointers.read_files(spark, topic))
    pointers.store_quarantined(decoded, f"{folder}/kept", f"{folder}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{folder}/kept").collect()
    assert sorted(r["value"] for r in kept) == ["no json", "{}"] and all(r["problems"] for r in kept)


def test_client_lookup_has_no_page_limit(spark):
    names = [(f"e{i}", "CLUB", f"United {i}", f"united-{i}", 1000 - i) for i in range(150)]
    names.append(("last", "CLUB", "United", "united", 0))
    rows = spark.createDataFrame(names, "id string, entity_type string, canonical_name string, slug string, mention_count_24h int")
    empty = spark.createDataFrame([], schemas.ENTITIES)
    table = empty.unionByName(rows.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in rows.columns
         else F.array().cast(f.dataType) if f.name == "aliases" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in empty.schema]))
    assert [r["id"] for r in serving.find_entity(table, "club", "united").collect()] == ["last"]


def test_only_documents_that_can_be_maps_are_read_level_by_level(spark, monkeypatch):
    sources = spark.createDataFrame(
        [("F", "RSS", "f", ["example.com"]), ("M", "SITEMAP", "m", None)],
        "source_name string, source_type string, url string, allowed_domains array<string>")
    documents = spark.createDataFrame(
        [("f", RSS), ("m", "<sitemapindex><SITEMAP><loc>n</loc></SITEMAP></sitemapindex>"),
         ("n", "<urlset><u<!-- c -->rl><loc>https://x.org/1</loc></url></urlset>"), ("p", "<p>text</p>"), ("q", None)],
        "url string, payload string")
    rules = spark.createDataFrame([], "source_name string, include string, exclude string")
    read, flow = [], feeds.sitemap_flow
    monkeypatch.setattr(feeds, "sitemap_flow", lambda roots, maps, *a, **k: (read.append(maps), flow(roots, maps, *a, **k))[1])
    rows = feeds.source_candidates(sources, documents, rules, now=NOW).collect()
    assert sorted(r.url for r in rows if r.source_name == "M") == ["https://x.org/1"]
    assert len([r for r in rows if r.source_name == "F"]) == 3
    assert sorted(r.url for r in read[0].collect()) == ["m", "n"]
