"""Ranked lexical search against a brute-force version."""

import math
import random
import re
from collections import Counter

from newsloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute_force(docs, items, best):
    """Rows (item_id, rank, doc_id, score) as the contract states them."""
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def ranked(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 50)  # many small matrices
    monkeypatch.setattr(lexical_search, "TEXT_BYTES", 200)
    rng = random.Random(5)
    words = ["Ä", "alpha", "Beta", "beta", "x1", "Žo", "gamma", "İ", "delta"]
    text = lambda n: " -".join(rng.choices(words, k=n))
    docs = [(i, text(rng.choice([0, 1, 3, 9]))) for i in range(60)]
    docs += [(70, docs[5][1]), (71, docs[5][1]), (70, docs[5][1]), (None, docs[6][1]), (72, None), (73, " ,.;"), (74, "beta " * 30_000)]
    items = [(i, text(k)) for i, k in enumerate([0, 1, 2, 5, 12, 40])]
    items += [(1, items[1][1]), (None, "alpha beta"), (9, None), (10, "..."), (11, "absent"), (4, "x1 x1 gamma")]
    left = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, score int, item int").repartition(3)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    want = brute_force(docs, items, 7)
    assert ranked(lexical_search.search(left, right, best=7)) == want
    assert ranked(lexical_search.search(left, right, best=7, block_bytes=40)) == want  # several blocks
    assert ranked(lexical_search.search(left, right, best=1000)) == brute_force(docs, items, 1000)


def test_search_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [("q", 1, 1, 287 * (10**9 // 2200))]
