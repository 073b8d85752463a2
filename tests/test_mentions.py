import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.operators import aliases, catalog, matching, mentions, phrases
from newsloom.plans import entities as plan

CITY = "11111111-1111-4111-8111-111111111111"
UNITED = "22222222-2222-4222-8222-222222222222"
GUNNERS = "33333333-3333-4333-8333-333333333333"


@pytest.fixture
def clubs(spark):
    rows = [
        (UNITED, "CLUB", "Manchester United FC", ["MU", "Man United", "Manchester United"], "ACTIVE"),
        (CITY, "CLUB", "Manchester City FC", ["Man City"], "ACTIVE"),
        (GUNNERS, "CLUB", "Arsenal FC", ["Gunners"], "ACTIVE"),
        ("44444444-4444-4444-8444-444444444444", "CLUB", "Old FC", ["Relic"], "INACTIVE"),
    ]
    frame = spark.createDataFrame(
        rows, "id string, entity_type string, canonical_name string, names array<string>, status string"
    )
    alias = F.transform(
        "names", lambda v: F.struct(v.alias("value"), F.lower(v).alias("normalized_value"),
                                    F.lit(False).alias("case_sensitive"))
    )
    return frame.withColumn("aliases", alias).withColumn("canonical_key", F.lower("canonical_name")).drop("names")


def test_rewrite_is_longest_first_in_one_pass(spark, clubs):
    rules = catalog.rewrite_rules(catalog.active(clubs))
    body = "MU defeated Man City in front of the MUSEUM. manchester united celebrated; Relic did not."
    articles = spark.createDataFrame([("a", body), ("b", None), ("c", "")], "id string, content string")
    expected = {
        "a": "Manchester United FC defeated Manchester City FC in front of the MUSEUM."
        " Manchester United FC celebrated; Relic did not.",
        "b": None, "c": "",
    }
    done = aliases.rewrite_aliases(articles, rules)
    assert {r["id"]: r["filtered_content"] for r in done.collect()} == expected


def plain_rewrite(value, rules):
    ordered = sorted(rules, key=len, reverse=True)
    pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, ordered)) + r")(?!\w)", re.IGNORECASE)
    folded = {k.casefold(): v for k, v in rules.items()}
    return pattern.sub(lambda m: folded.get(m.group(0).casefold(), m.group(0)), value)


def test_matching_equals_the_regular_expressions():
    generator = random.Random(7)
    words = ["ab", "b", "a", "é", "a-b", "'x", "b.", "ab c"]
    for _ in range(400):
        known = list({" ".join(generator.choices(words, k=generator.randint(1, 3))) for _ in range(6)})
        known = list({matching.fold(p): p for p in known}.values())
        value = generator.choice(["", " "]).join(
            generator.choice([w, w.upper(), w + " ", "_", ", "]) for w in generator.choices(words, k=25)
        )
        rules = {p: f"<{i}>" for i, p in enumerate(known)}
        index = matching.PhraseIndex(known)
        assert matching.rewrite(value, index, list(rules.values())) == plain_rewrite(value, rules)
        expected = sorted(
            (m.start(), m.end(), i)
            for i, p in enumerate(known)
            for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", value, re.IGNORECASE)
        )
        assert sorted(matching.spans(value, index)) == expected


def test_phrase_dictionary_equals_the_regular_expressions(spark, monkeypatch):
    generator = random.Random(8)
    words = ["ab", "b", "a", "é", "a-b", "'x", "b.", "ab c", "İ"]
    known = list({matching.fold(" ".join(generator.choices(words, k=generator.randint(1, 3)))) for _ in range(12)})
    values = [
        generator.choice(["", " "]).join(
            generator.choice([w, w.upper(), w + " ", "_", ", "]) for w in generator.choices(words, k=25)
        )
        for _ in range(60)
    ]
    articles = spark.createDataFrame([*enumerate(values), (100, None), (101, "")], "id int, content string")
    rules = spark.createDataFrame([(p, f"<{i}>") for i, p in enumerate(known)] + [(" ", "none"), (None, "none")], "alias string, canonical_name string")
    index = matching.PhraseIndex(known)
    spans = [(i, p, *s[:2]) for i, v in enumerate(values) for s in matching.spans(v, index) for p in [known[s[2]]]]
    for bits in (1 << 24, 1):  # a filter that lets all runs pass changes nothing
        monkeypatch.setattr(phrases, "FILTER_BITS", bits)
        done = {r.id: r.filtered_content for r in aliases.rewrite_aliases(articles, rules).collect()}
        names = [f"<{i}>" for i in range(len(known))]
        assert done == {i: matching.rewrite(v, index, names) for i, v in enumerate(values)} | {100: None, 101: ""}
        found = mentions.catalog_spans(articles, rules.select("alias", F.lit("CLUB").alias("label")), text_column="content")
        assert sorted((r.id, matching.fold(r.text), r.start, r.end) for r in found.collect()) == sorted(spans)
    none = rules.limit(0)
    assert {r.id: r.filtered_content for r in aliases.rewrite_aliases(articles, none).collect()} == dict(enumerate(values)) | {100: None, 101: ""}
    assert aliases.rewrite_aliases(articles.limit(0), rules).count() == 0


def test_resolution(spark, clubs):
    spans = spark.createDataFrame(
        [("gunners", "club"), ("Gunners", "player"), (" Bukayo Saka ", "player"), ("relic", "club")],
        "text string, label string",
    )
    rows = {
        (r["text"], r["label"]): (r["canonical_entity_id"], r["canonical_name"])
        for r in mentions.resolve(spans, catalog.active(clubs)).collect()
    }
    fallback = lambda key: str(uuid.uuid5(uuid.UUID(settings.ENTITY_NAMESPACE), key))
    assert rows[("gunners", "CLUB")] == (GUNNERS, "Arsenal FC")
    assert rows[("Gunners", "PLAYER")] == (GUNNERS, "Arsenal FC")
    assert rows[(" Bukayo Saka ", "PLAYER")] == (fallback("PLAYER:bukayo-saka"), "Bukayo Saka")
    assert rows[("relic", "CLUB")] == (fallback("CLUB:relic"), "relic")


def test_chunks():
    value = " one two  three four five "
    bounds = list(mentions.chunk_bounds(value, 3, 1))
    assert [value[a:b] for a, b in bounds] == ["one two  three", "three four five"]
    assert list(mentions.chunk_bounds("  ", 3, 1)) == []
    with pytest.raises(ValueError):
        mentions._check_chunking(3, 3)


def test_best_span_of_overlapping_chunks(spark):
    articles = spark.createDataFrame([("a", "x y z")], "id string, filtered_content string")

    def extractor(chunk):
        at = chunk.find("y")
        return [] if at < 0 else [("y", "PLAYER", 0.6 if chunk.startswith("x") else 0.9, at, at + 1)]

    rows = mentions.extract_spans(articles, extractor, max_words=2, overlap=1).collect()
    assert [(r["label"], r["start"], r["end"], r["score"]) for r in rows] == [("PLAYER", 2, 3, 0.9)]


def test_thresholds_and_error_marker(spark, clubs):
    scores = {"low": 0.94, "edge": 0.95, "hidden": 0.4}

    def extractor(chunk):
        return [(w, "PLAYER", s, chunk.find(w), chunk.find(w) + len(w)) for w, s in scores.items() if w in chunk]

    metadata = spark.createDataFrame([("a",), ("b",)], "id string")
    contents = spark.createDataFrame([("a", "low edge hidden MU")], "id string, content string")
    now = F.lit("2026-08-20").cast("timestamp")
    rows, filtered = plan.process(metadata, contents, clubs, now, extractor=extractor)
    found = {r["id"]: r for r in rows.collect()}
    assert [e["text"] for e in found["a"]["entities"]] == ["edge"]
    assert found["a"]["error"] is None
    assert found["b"]["entities"] == [] and found["b"]["error"] == "article_content_not_found"
    assert filtered.first()["filtered_content"] == "low edge hidden Manchester United FC"


def test_literal_and_catalog_extractors():
    literal = mentions.literal_extractor([("ab", "CLUB", 0.7)])
    assert literal("ababAB") == [("ab", "CLUB", 0.7, 0, 2), ("ab", "CLUB", 0.7, 2, 4)]
    known = mentions.catalog_extractor([("Real Madrid", "CLUB"), ("Madrid", "CLUB"), ("MADRID", "CLUB")])
    assert sorted(s[3:] for s in known("real madrid, Madrids")) == [(0, 11), (5, 11)]


def test_span_rules(spark):
    rows = [
        ("club", "Arsenal", 0, 7, 0.9, None), ("referee", "Arsenal", 0, 7, 0.9, "unknown_label"),
        ("club", "Arsenal", -1, 7, 0.9, "offsets_outside"), ("club", "Arsenal", 0, 99, 0.9, "offsets_outside"),
        ("club", "arsenal", 0, 7, 0.9, "text_mismatch"), ("club", " ", 7, 8, 0.9, "blank_text"),
        ("club", "Arsenal", 0, 7, 1.5, "score_outside"), ("club", None, 0, 7, 0.9, "missing_field"),
    ]
    frame = spark.createDataFrame(
        rows, "label string, text string, start int, end int, score double, expected string"
    )
    checked = frame.withColumn("got", mentions.span_problem(F.lit("Arsenal won"))).collect()
    assert [r["got"] for r in checked] == [r["expected"] for r in checked]


def test_alias_conflicts_and_last_owner(spark, clubs):
    twin = clubs.filter(F.col("id") == CITY).withColumn("id", F.lit("z")).withColumn(
        "canonical_key", F.lit("zz")
    ).withColumn("canonical_name", F.lit("Manchester Twin"))
    both = clubs.unionByName(twin)
    conflict = catalog.alias_conflicts(both).collect()
    assert [(r["alias_key"], r["owners"]) for r in conflict] == [("man city", 2)]
    rules = {r["alias"]: r["canonical_name"] for r in catalog.rewrite_rules(both).collect()}
    assert rules["Man City"] == "Manchester Twin"


def test_overlapping_places_of_one_phrase(spark):
    articles = spark.createDataFrame([("a", "the the The x")], "id string, content string")
    rules = spark.createDataFrame([("the the", "CLUB")], "alias string, label string")
    for overlapping, expected in ((False, [(0, 7, "the the")]), (True, [(0, 7, "the the"), (4, 11, "the The")])):
        found = mentions.catalog_spans(articles, rules, text_column="content", overlapping=overlapping).collect()
        assert sorted((r["start"], r["end"], r["text"]) for r in found) == expected


def test_spans_need_no_shuffle_of_texts_and_small_batches(spark, monkeypatch):
    articles = spark.createDataFrame([(i, "Ab cd ab") for i in range(50)], "id int, content string")
    rules = spark.createDataFrame([("ab", "CLUB"), ("AB", "CLUB"), ("ab", "COACH"), ("cd", "CLUB")], "alias string, label string")
    monkeypatch.setattr(phrases, "ROWS", 3)
    monkeypatch.setattr(aliases, "ARTICLES", 3)
    for size in (32 << 20, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(phrases, "BROADCAST_BYTES", size)
        found = mentions.catalog_spans(articles, rules, text_column="content")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "collect_list" not in plan
        assert ("strategy=broadcast" in plan) == bool(size)
        rows = sorted((r["id"], r["label"], r["start"], r["end"], r["text"]) for r in found.collect())
        one = [("CLUB", 0, 2, "Ab"), ("CLUB", 3, 5, "cd"), ("CLUB", 6, 8, "ab"), ("COACH", 0, 2, "Ab"), ("COACH", 6, 8, "ab")]
        assert rows == [(i, *s) for i in range(50) for s in one]
        done = aliases.rewrite_aliases(articles, rules.select("alias", F.lit("Z").alias("canonical_name")))
        assert {(r.id, r.filtered_content) for r in done.collect()} == {(i, "Z Z Z") for i in range(50)}
