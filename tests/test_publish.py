import random
import tempfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import popularity as counts
from newsloom.operators import popularity_log, quality, upsert
from newsloom.plans import publish, serving
from newsloom.plans.publish import ReadModel
from newsloom.sources import tables

START = datetime(2026, 8, 20, 6, tzinfo=UTC)
NOW = START + timedelta(hours=6)


def empty_model(spark):
    return ReadModel(
        *[
            spark.createDataFrame([], s)
            for s in (
                schemas.ENTITIES, schemas.SOURCE_ARTICLES, schemas.TIMELINE_ITEMS,
                schemas.TIMELINE_ITEM_ARTICLES,
            )
        ]
    )


def summaries(spark, rows):
    """rows: (id, entity, name, type, hour, articles)."""
    full = [
        (i, e, n, k, START + timedelta(hours=h), START + timedelta(hours=h + 3), a, len(a), [], [],
         f"news {i}", f"title {i}", "COMPLETED", None, None, NOW, NOW)
        for i, e, n, k, h, a in rows
    ]
    return spark.createDataFrame(full, schemas.SUMMARIES)


@pytest.fixture
def collections(spark):
    catalog = spark.createDataFrame(
        [("e1", "CLUB", "Arsenal FC", [("Gunners", "gunners", False), ("Gunners", "gunners", False), ("AFC", "afc", False)])],
        "id string, entity_type string, canonical_name string,"
        " aliases array<struct<value: string, normalized_value: string, case_sensitive: boolean>>",
    )
    metadata = spark.createDataFrame(
        [
            (a, f"https://x.org/{a}?r", f"https://x.org/{a}", "x.org", "X", f"Title {a}", d, None, START, None,
             [], [], "h", "en")
            for a, d in (("a", "About a"), ("b", None), ("c", ""))
        ],
        schemas.NEWS_METADATA,
    )
    contents = spark.createDataFrame(
        [("a", "body a", "filtered a", None, None, None, None), ("b", "b" * 300, None, None, None, None, None)],
        schemas.NEWS_CONTENT,
    )
    return catalog, metadata, contents


def publish_all(model, rows, collections):
    catalog, metadata, contents = collections
    return publish.publish(model, rows, catalog, metadata, contents, F.lit(NOW).cast("timestamp"))


def snapshot(model):
    return [sorted(map(tuple, frame.collect()), key=repr) for frame in (
        model.entities, model.articles, model.items, model.item_articles)]


def stored(spark, model):
    """The model as read back from a table."""
    return ReadModel(*[
        spark.createDataFrame(f.collect(), f.schema)
        for f in (model.entities, model.articles, model.items, model.item_articles)
    ])


def test_publish_twice_changes_nothing(spark, collections):
    rows = summaries(spark, [
        ("s1", "e1", "Arsenal", "TEAM", 0, ["a", "b", "missing"]), ("s2", "e2", "Saka", "PLAYER", 3, ["c", "a"]),
    ])
    once = stored(spark, publish_all(empty_model(spark), rows, collections))
    assert snapshot(stored(spark, publish_all(once, rows, collections))) == snapshot(once)
    entity = {r["id"]: r for r in once.entities.collect()}
    assert entity["e1"]["entity_type"] == "CLUB" and entity["e1"]["aliases"] == ["Gunners", "AFC"]
    assert entity["e1"]["slug"] == "arsenal" and entity["e1"]["mention_count_24h"] == 0
    article = {r["id"]: r for r in once.articles.collect()}
    assert set(article) == {"a", "b", "c"}
    assert (article["a"]["body"], article["a"]["excerpt"]) == ("filtered a", "About a")
    assert (article["b"]["body"], len(article["b"]["excerpt"])) == ("b" * 300, 240)
    assert article["c"]["body"] == "Title c" and article["c"]["slug"] == "title-c-c"
    positions = {(r["timeline_item_id"], r["article_id"]): r["position"] for r in once.item_articles.collect()}
    assert positions == {("s1", "a"): 0, ("s1", "b"): 1, ("s2", "c"): 0, ("s2", "a"): 1}


def test_slug_conflict_keeps_the_stored_id(spark, collections):
    first = stored(spark, publish_all(
        empty_model(spark), summaries(spark, [("s1", "e1", "Arsenal", "CLUB", 0, ["a"])]), collections))
    both = stored(spark, publish_all(
        first, summaries(spark, [("s2", "other", "ARSENAL", "CLUB", 3, ["b"]), ("s3", "third", "arsenal", "CLUB", 0, ["c"])]),
        collections))
    assert [(r["id"], r["canonical_name"]) for r in both.entities.collect()] == [("e1", "ARSENAL")]
    assert both.entities.first()["aliases"] == ["Gunners", "AFC"]
    items = {r["window_start"].hour: r["id"] for r in both.items.collect()}
    assert items == {6: "s1", 9: "s2"}
    assert {r["entity_id"] for r in both.items.collect()} == {"e1"}
    links = {(r["timeline_item_id"], r["article_id"]) for r in both.item_articles.collect()}
    assert links == {("s1", "a"), ("s1", "c"), ("s2", "b")}
    assert quality.constraint_violations(both.entities, both.articles, both.items, both.item_articles).count() == 0


def test_same_url_keeps_the_stored_article(spark, collections):
    catalog, metadata, contents = collections
    old = metadata.filter("id = 'a'").withColumn("id", F.lit("first"))
    rows = summaries(spark, [("s1", "e1", "Arsenal", "CLUB", 0, ["first"])])
    model = stored(spark, publish.publish(
        empty_model(spark), rows, catalog, old, contents, F.lit(NOW).cast("timestamp")))
    again = publish_all(model, summaries(spark, [("s2", "e1", "Arsenal", "CLUB", 3, ["a"])]), collections)
    assert [r["id"] for r in again.articles.collect()] == ["first"]
    assert {(r["timeline_item_id"], r["article_id"]) for r in again.item_articles.collect()} == {
        ("s1", "first"), ("s2", "first")}


def mentions(spark, rows):
    return spark.createDataFrame(
        rows, "article_id string, label string, canonical_entity_id string, canonical_name string")


def test_popularity_counts_articles_and_resets(spark, collections):
    catalog, metadata, _ = collections
    model = empty_model(spark)
    old = spark.createDataFrame(
        [("gone", "CLUB", "Gone", "Gone", "gone", [], 7, START, NOW), ("e1", "CLUB", "Arsenal", "Arsenal", "arsenal", [], 1, NOW, NOW)],
        schemas.ENTITIES)
    rows = mentions(spark, [
        ("a", "club", "e1", "arsenal"), ("a", "player", "e1", "Arsenal"), ("b", "CLUB", "e1", "Arsenal"),
        ("a", "manager", "e9", "Arteta"), ("b", "CLUB", "clash", "Gone"), ("c", "CLUB", None, "x"), ("c", "CLUB", "e8", ""),
    ])
    model = ReadModel(old, model.articles, model.items, model.item_articles)
    refreshed = publish.refresh_popularity(model, metadata, rows, catalog, NOW).entities.collect()
    found = {r["id"]: r for r in refreshed}
    assert {k: r["mention_count_24h"] for k, r in found.items()} == {"gone": 0, "e1": 2, "e9": 1}
    assert found["e9"]["entity_type"] == "COACH"
    assert found["e1"]["last_seen_at"] == NOW.replace(tzinfo=None) and found["e1"]["canonical_name"] == "Arsenal"
    _, refused = upsert.popularity(old, publish.active_entities(metadata, rows, catalog, NOW))
    assert [r["id"] for r in refused.collect()] == ["clash"]


def test_pending_marks_and_backfill(spark, collections):
    catalog, metadata, contents = collections
    rows = summaries(spark, [(f"s{i}", "e1", "Arsenal", "CLUB", 3 * i, ["a"]) for i in range(4)])
    model, marked = publish.publish_pending(
        empty_model(spark), rows, catalog, metadata, contents,
        mentions(spark, [("a", "CLUB", "e1", "Arsenal")]), NOW, limit=3)
    assert {r["id"] for r in marked.filter("published_at IS NOT NULL").collect()} == {"s0", "s1", "s2"}
    assert model.items.count() == 3 and model.entities.first()["mention_count_24h"] == 1
    bare = model.articles.withColumn("slug", F.lit(None).cast("string")).withColumn("body", F.lit("kept"))
    filled = upsert.backfill_articles(bare, metadata, contents).first()
    assert (filled["slug"], filled["body"]) == ("title-a-a", "kept")


def test_versions_and_batches(spark):
    stored_rows = spark.createDataFrame([("x", "old", 3), ("y", "old", 1)], "id string, name string, version int")
    changes = spark.createDataFrame(
        [("x", "new", 3, 1), ("x", "late", 3, 2), ("y", "stale", 7, 3), ("z", "none", 1, 4)],
        "id string, name string, expected_version int, seq int")
    table, refused = upsert.save_versions(stored_rows, changes)
    assert {tuple(r) for r in table.collect()} == {("x", "new", 4), ("y", "old", 1)}
    assert {r["name"] for r in refused.collect()} == {"late", "stale", "none"}
    due = spark.createDataFrame(
        [(1, True, None, 10), (2, True, NOW - timedelta(minutes=10), 10), (3, True, NOW, 10), (4, False, None, 10)],
        "id int, enabled boolean, last_discovered_at timestamp, crawl_interval_minutes int")
    assert [r["id"] for r in serving.due_sources(due, NOW).collect()] == [1, 2]
    with pytest.raises(ValueError):
        serving.due_sources(due, NOW, limit=500)


def test_stored_popularity_equals_a_full_run(spark, collections):
    catalog, _, _ = collections
    catalog = catalog.unionByName(catalog.limit(1).withColumn("id", F.lit("e2")).withColumn("entity_type", F.lit(None).cast("string")))
    rng = random.Random(11)
    dates = {f"a{i}": NOW - timedelta(minutes=rng.randrange(-200, 3500)) for i in range(80)} | {"edge": NOW - timedelta(hours=24), "end": NOW}
    articles = spark.createDataFrame([*dates.items(), ("undated", None)], "id string, crawl_date timestamp")
    rows = mentions(spark, [
        (a, rng.choice(["club", "PLAYER", "league", None]), f"e{rng.randrange(5)}", rng.choice(["Arsenal", "Other", "x"]))
        for a in [*dates, "undated"] for _ in range(3)
    ] + [("a1", "CLUB", None, "x"), ("a1", "CLUB", "e8", "")])
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    number = F.pmod(F.xxhash64("id"), F.lit(3))

    def told(frame):
        return sorted(map(repr, (tuple(r) for r in frame.collect())))

    def full(articles):
        return told(counts.popularity(articles, rows, catalog, NOW))

    for run in (0, 1, 1):
        popularity_log.update(spark, root, articles.filter(number == run), rows)
    assert told(popularity_log.popularity(spark, root, catalog, NOW)) == full(articles.filter(number < 2))
    files = {r.f for r in tables.read(spark, f"{root}/counts", popularity_log.COUNTS).select(F.input_file_name().alias("f")).distinct().collect()}
    today = articles.filter((number == 2) & (F.to_date("crawl_date") == F.lit(NOW.date())))
    popularity_log.update(spark, root, today, rows)
    again = {r.f for r in tables.read(spark, f"{root}/counts", popularity_log.COUNTS).select(F.input_file_name().alias("f")).distinct().collect()}
    assert files & again and all(f"day={NOW.date()}" in f for f in files ^ again)  # other days keep their files
    popularity_log.update(spark, root, articles.filter(number == 2), rows)
    found = popularity_log.popularity(spark, root, catalog, NOW)
    assert told(found) == full(articles)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("PartitionFilters: [isnotnull(day") > 0
    # An article whose mentions are gone loses its counts, also where its day is left empty.
    popularity_log.update(spark, root, articles, rows.limit(0))
    assert popularity_log.popularity(spark, root, catalog, NOW).count() == 0
    popularity_log.update(spark, root, articles.limit(0), rows)
    assert popularity_log.popularity(spark, f"{root}/none", catalog, NOW).count() == 0


def test_repeated_aliases_stay_only_where_asked(spark):
    from newsloom.functions import text

    alias = F.array(*[F.struct(F.lit(v).alias("value")) for v in ("AFC", "AFC", "", "Gunners")])
    row = spark.range(1).select(text.alias_values(alias).alias("once"), text.alias_values(alias, repeats=True).alias("all")).first()
    assert row["once"] == ["AFC", "Gunners"] and row["all"] == ["AFC", "AFC", "Gunners"]


def test_entities_are_served_without_building_articles(spark):
    from newsloom.queries import bindings

    bindings._written.clear()
    room = bindings.Newsroom(spark, "/root/testdata/sf0.001")
    assert room.model.entities.count() > 0
    assert {name for _, _, name in bindings._written}.isdisjoint({"published_articles", "published_items", "published_item_articles"})
    plan = room._contents()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
