from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import ranking
from newsloom.plans import timeline

START = datetime(2026, 8, 20, 6, tzinfo=UTC)
END = START + timedelta(hours=3)
ARSENAL = ("e1", "Arsenal", "CLUB")
SAKA = ("e2", "Saka", "PLAYER")


def collections(spark, articles, mentions):
    """articles: id -> (crawl_date, text); mentions: article id -> entity keys."""
    metadata = spark.createDataFrame(
        [(i, f"Title {i}", at) for i, (at, _) in articles.items()],
        "id string, title string, crawl_date timestamp",
    )
    contents = spark.createDataFrame(
        [(i, body, None) for i, (_, body) in articles.items()],
        "id string, content string, filtered_content string",
    )
    rows = [(a, kind, i, n) for a, keys in mentions.items() for i, n, kind in keys]
    named = spark.createDataFrame(
        rows, "article_id string, label string, canonical_entity_id string, canonical_name string"
    )
    return metadata, contents, named


@pytest.fixture
def news(spark):
    return collections(
        spark,
        {
            "a": (START + timedelta(minutes=10), "Arsenal and Saka. Arsenal!"),
            "b": (START + timedelta(minutes=90), "Arsenal"),
        },
        {"a": [ARSENAL, ARSENAL, SAKA], "b": [ARSENAL]},
    )


def run(news, **options):
    return timeline.summarize(*news, start=START, end=END, now=END, **options)


def test_summaries_and_rerun(spark, news):
    rows = {r["entity_id"]: r for r in run(news).collect()}
    assert {k: r["article_count"] for k, r in rows.items()} == {"e1": 2, "e2": 1}
    assert rows["e1"]["article_ids"] == ["b", "a"]
    assert rows["e1"]["status"] == "COMPLETED" and rows["e1"]["published_at"] is None
    done = spark.createDataFrame([tuple(r) for r in rows.values()], run(news).schema)
    assert run(news, existing=done).count() == 0
    assert run(news, existing=done, force=True).count() == 2
    again = timeline.summarize_recent(*news, now=END, days=1, existing=done)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in rows.values()}


def test_generator_failures_leave_the_pair_open(news):
    def generator(prompt):
        assert "of 2026-08-20T06:10:00+00:00: Title a\nArsenal and" in prompt
        if "Subject: Saka (player)" in prompt:
            raise TimeoutError
        return '```json\n{"title": "T", "content": "C"}\n```'

    rows = run(news, generator=generator).collect()
    assert [(r["entity_id"], r["short_description"], r["aggregated_news"]) for r in rows] == [("e1", "T", "C")]


def test_prompt_separates_articles(spark, news):
    seen = run(news, generator=lambda p: p.replace("{", "").replace("}", "")).collect()
    body = {r["entity_id"]: r["aggregated_news"] for r in seen}["e1"]
    assert body.index("Report 1 of 2") < body.index("Title b") < body.index("Report 2 of 2") < body.index("Title a")


def test_lookback_counts_but_does_not_list(spark):
    """An entity seen only earlier takes a rank yet gives no summary."""
    metadata, contents, named = collections(
        spark,
        {"old": (START - timedelta(hours=20), "x"), "new": (START, "x"), "gone": (START - timedelta(hours=22), "x")},
        {"old": [SAKA], "new": [ARSENAL, ("e3", "Old Trafford", "COMPETITION")], "gone": [ARSENAL]},
    )
    dated = timeline.window_keys(metadata, named, START, END)
    tops = timeline.top_entities(dated).filter(F.col("window_end") == F.lit(END)).collect()
    assert {(r["entity_id"], r["mention_count"]) for r in tops} == {("e1", 1), ("e2", 1)}
    rows = timeline.summarize(metadata, contents, named, start=START, end=END, now=END).collect()
    assert [r["entity_id"] for r in rows] == ["e1"]


def test_labels_of_one_entity_give_one_summary(spark):
    news = collections(
        spark,
        {"a": (START, "x"), "b": (START, "x")},
        {"a": [("e1", "Arsenal", "CLUB"), ("e1", "Arsenal", "PLAYER")], "b": [("e1", "Arsenal", "PLAYER")]},
    )
    rows = run(news).collect()
    assert [(r["entity_type"], r["article_count"]) for r in rows] == [("PLAYER", 2)]


def test_top_five_by_mentions_then_date(spark):
    articles = {str(i): (START + timedelta(minutes=i), "Arsenal " * (3 if i == 0 else 1)) for i in range(8)}
    news = collections(spark, articles, {a: [ARSENAL] for a in articles})
    row = run(news).first()
    assert row["article_ids"] == ["7", "6", "5", "4", "0"]


def test_type_limits(spark):
    rows = [("w", f"e{i:03d}", f"n{i:03d}", kind, 200 - i) for i in range(60) for kind in ("PLAYER", "CLUB", "COMPETITION")]
    counts = spark.createDataFrame(
        rows, "window_end string, entity_id string, canonical_name string, entity_type string, mention_count long"
    )
    kept = ranking.top_per_type(counts, by=["window_end"]).groupBy("entity_type").count().collect()
    assert {r["entity_type"]: r["count"] for r in kept} == {"PLAYER": 50, "CLUB": 30}


def test_recent_range_rejects_no_days():
    with pytest.raises(ValueError):
        timeline.recent_range(END, 0)
