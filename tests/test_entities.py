import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import aliases, catalog, mentions, phrases
from newsloom.plans import entities as plan

ENTITIES = [
    ("e1", "CLUB", "Manchester United FC", ["MU", "Man United"], "ACTIVE"),
    ("e2", "COACH", "Gunners", ["Straße", "of"], "ACTIVE"),
    ("e3", "CLUB", "Arsenal FC", ["Gunners", "STRASSE", "Å"], "ACTIVE"),
    ("e4", "CLUB", "Old FC", ["Relic"], "INACTIVE"),
]
TEXTS = [
    ("a", "MU met the Gunners, gunners and GUNNERS of Arsenal FC. Relic; man united!"),
    ("b", "straße Straße strasse ẞ Å Å"), ("b", "straße Straße strasse ẞ Å Å"),
    ("c", None), ("d", ""), ("e", "nothing here"), ("x", "MU is not asked for"), (None, "MU has no id"),
]


@pytest.fixture
def known(spark):
    rows = spark.createDataFrame(ENTITIES, "id string, entity_type string, canonical_name string, names array<string>, status string")
    alias = F.transform("names", lambda v: F.struct(v.alias("value"), F.lower(v).alias("normalized_value")))
    return rows.withColumn("aliases", alias).withColumn("canonical_key", F.lower("canonical_name")).drop("names")


def values(frame):
    return sorted(((r.id, r.error, [tuple(e) for e in r.entities]) for r in frame.collect()), key=str)


def test_processing_moves_texts_only_and_equals_its_steps(spark, known, monkeypatch):
    now = F.lit("2026-08-20").cast("timestamp")
    metadata = spark.createDataFrame([(i,) for i in ("a", "b", "b", "c", "d", "e", "missing", None)], "id string")
    contents = spark.createDataFrame(TEXTS, "id string, content string")
    mine = contents.join(metadata.select("id"), "id", "left_semi")
    found = plan.extract_mentions(plan.filtered_contents(mine, known), known)
    expected = values(plan.news_entities(metadata, found, mine, now))
    assert sum(e[0] == "b" for e in expected) == 4
    monkeypatch.setattr(phrases, "ROWS", 3)
    for size in (64 << 20, 0):  # catalog broadcast, and joined by shuffles
        monkeypatch.setattr(phrases, "BROADCAST_BYTES", size)
        for batch in ("10000", "2"):  # articles in one batch, and over several
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            try:
                rows, filtered = plan.process(metadata, contents, known, now)
                assert values(rows) == expected
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(r.id for r in filtered.collect()) == ["a", "b", "b", "d", "e"]
        shape = rows._jdf.queryExecution().optimizedPlan().toString()
        moved = [line for line in shape.splitlines() if "Join " in line and "strategy=broadcast" not in line]
        if size:  # ids meet texts; no mention and no rewritten text moves
            assert "collect_list" not in shape and len(moved) == 2


def test_rewriting_texts_without_an_id_or_with_one_of_another(spark, known):
    rules = catalog.rewrite_rules(catalog.active(known))
    articles = spark.createDataFrame([("a", "MU won"), ("a", "so MU won"), (None, "MU won")], "id string, content string")
    done = aliases.rewrite_aliases(articles, rules).collect()
    united = "Manchester United FC won"
    assert sorted((r.id or "", r.filtered_content) for r in done) == [("", "MU won"), ("a", united), ("a", f"so {united}")]


def test_a_form_is_resolved_once_for_its_places(spark, known):
    active = catalog.active(known)
    articles = spark.createDataFrame([("a", "Gunners gunners Gunners")], "id string, filtered_content string")
    rows = mentions.catalog_mentions(articles, plan.catalog_rules(active), active)
    row = rows.first()
    assert sorted((f.label, f.text, f.starts, f.canonical_entity_id) for f in row.found) == [
        ("CLUB", "Gunners", [0, 16], "e3"), ("CLUB", "gunners", [8], "e3"),
        ("COACH", "Gunners", [0, 16], "e2"), ("COACH", "gunners", [8], "e2"),
    ]
    spans = rows.select(F.inline(mentions.placed(F.col("found")))).collect()
    assert [(s.start, s.end, s.label) for s in spans] == [(n, n + 7, x) for n in (0, 8, 16) for x in ("CLUB", "COACH")]


def test_rows_in_another_order_are_refused():
    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
            names=["id", "_article", "starts"],
        )

    rows = [("a", 1, None), ("a", 1, [0]), ("b", 2, None), ("b", 3, None), ("b", 3, [1])]
    for size in (1, 2, 5):
        parts = [batch(rows[i : i + size]) for i in range(0, 5, size)]
        assert sum(len(begins) for _, _, begins in phrases.whole(parts, by_id=True)) == 2
        assert sum(len(begins) for _, _, begins in phrases.whole(parts)) == 3
    for wrong in ([rows[1], rows[0]], [rows[0], rows[2], rows[1]]):
        with pytest.raises(ValueError, match="order"):
            list(phrases.whole([batch(wrong)]))
