"""Decontamination against its SQL, with items that have no id."""

import random

import duckdb

from newsloom.llm import decontamination


def test_items_without_id_equal_the_sql(spark, monkeypatch):
    rng = random.Random(12)
    words = ["a", "B", "c", "d.", "é"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(None, text(20)), (None, "Only here once"), (3, text(15)), (10, text(4)), (3, text(16)), (5, None), (None, None)]
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    docs += [(50, "x " + items[0][1] + " y"), (51, "only HERE once"), (52, items[2][1] + items[0][1]), (53, None)]
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, overlap int")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "table", lambda spark, folder, name: left if name == "documents" else right)
    database = duckdb.connect()
    for name, frame in (("documents", left), ("benchmark", right)):
        database.register(name, frame.toArrow())
    cursor = database.execute(decontamination.OP2_SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in decontamination.op2_decontamination(spark, "").collect()) == want
    assert any(r[names.index("n_items")] for r in want)
    monkeypatch.setattr(decontamination, "BLOCKS_HELD", 2)  # several blocks, written in between
    many, name = decontamination.find_overlaps(left, right, block_bytes=8)
    one, _ = decontamination.find_overlaps(left, right)
    found = lambda frame: sorted((r.doc_id, tuple(r[name].hits), tuple(r[name]["items"])) for r in frame.collect())
    assert [f[:2] for f in found(many)] == [f[:2] for f in found(one)]
    assert [sorted(map(str, f[2])) for f in found(many)] == [sorted(map(str, f[2])) for f in found(one)]
