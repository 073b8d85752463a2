"""The licence scan against brute force, and on small tables."""

import random
import re

from newsloom.llm import license_scan
from newsloom.llm.license_scan import LicenseIndex, SuffixAutomaton, best_chain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def holds(sequence, part):
    return [i for i in range(len(sequence) - len(part) + 1) if sequence[i : i + len(part)] == part]


def chain_by_trying(matches):
    """Covered words of the best chain, over all pairs of matches."""
    ordered, best = sorted(matches), {}
    for s, t, n in ordered:
        best[s, t, n] = n + max([best[p] for p in best if p[0] + p[2] <= s and p[1] + p[2] <= t], default=0)
    return max(best.values())


def test_automaton_and_matches_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        templates = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        templates.append(templates[0])
        automaton = SuffixAutomaton([[ord(c) for c in t] for t in templates])
        for number, t in enumerate(templates):
            i, j = sorted(rng.sample(range(len(t) + 1), 2))
            places = automaton.places_of(automaton.find([ord(c) for c in t[i:j]]))
            assert sorted(places) == sorted((k, at + j - i) for k, other in enumerate(templates) for at in holds(other, t[i:j]))
            assert (number, j) in places
        phrases = [("p", "a b"), ("q", "b"), ("p", "a b")]
        index = LicenseIndex([("x", " ".join(t)) for t in templates], phrases, long=2)
        text = [rng.choice("abc") for _ in range(40)]
        known = [c if c in index.vocabulary else "" for c in text]
        every = [*templates, ["a", "b"], ["b"]]
        run = [max([n for n in range(at + 1) if any(holds(t, known[at - n : at]) for t in every)]) for at in range(len(text) + 1)]
        maximal = [(at - run[at], run[at]) for at in range(1, len(text) + 1) if run[at] >= 2 and (at == len(text) or run[at + 1] != run[at] + 1)]
        found = index.scan([" ".join(text).encode(), b"b"])
        assert sorted((p["label"], p["start"]) for p in found[0]["places"]) == sorted(
            (label, at) for label, phrase in phrases for at in holds(text, phrase.split())
        )
        assert found[1]["places"] == [{"label": "q", "start": 0}]
        if all(known):
            places, matches = index.statistics([index.vocabulary[c] for c in text])
            assert [(s, n) for s, n, _ in matches] == maximal


def test_chains_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        matches = {(rng.randrange(30), rng.randrange(12), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))}
        covered, start, end = best_chain(list(matches), 20)
        assert covered == chain_by_trying(matches)
        assert end - start >= covered and any(m[0] == start for m in matches)


def test_edited_templates_are_found():
    index = LicenseIndex()
    for number, (label, text) in enumerate(license_scan.TEMPLATES):
        parts = text.split()
        found = index.scan([("Some words before. " + text + " And after, the end.").encode()])[0]["spans"]
        assert any(s["template"] == number and s["share"] == 1 and s["start"] == 3 for s in found)
        if len(parts) > 30:
            parts[len(parts) // 2] = "edited"
            found = index.scan([" ".join(parts).encode()])[0]["spans"]
            assert any(s["label"] == label and s["share"] > 0.8 for s in found)
    assert index.scan([b"the software is free and the license of this work is not stated"])[0]["spans"] == []


def test_license_table(spark, monkeypatch):
    mit = license_scan.TEMPLATES[2][1]
    rows = [
        (1, "See the MIT-License, or the Apache license."),
        (2, None),
        (3, "  ... "),
        (4, "filler and " * 60_000 + mit + " the mit license" * 20_000),
        (5, "GNU General  Public\nLICENSE; general public licenses"),
        (5, "GNU General  Public\nLICENSE; general public licenses"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, licenses int, n_words int")
    found, name = license_scan.scan_licenses(docs)
    assert found.columns == ["doc_id", "text", "licenses", "n_words", "_licenses"]
    assert docs.limit(0).transform(lambda d: license_scan.scan_licenses(d)[0]).count() == 0
    monkeypatch.setattr(license_scan, "table", lambda *_: docs)
    got = sorted((tuple(r) for r in license_scan.op12_license_scan(spark, "").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:8] for r in got[:3]] == [
        (1, 8, 2, 2, 6, "apache,mit", "apache,mit", 0.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 0, 0, None, None, "", "", 0.0),
    ]
    n, long = len(words(mit)), got[3]
    assert long[:8] == (4, 120_000 + n + 60_000, 20_000, 120_000 + n + 1, 120_000 + n + 59_998, "mit", "mit", 1.0)
    assert f"mit:120000:{120_000 + n}:{n}" in long[8]
    assert got[4] == got[5] and got[4][:7] == (5, 7, 1, 1, 1, "gpl", "gpl")
    assert got[6] == (None, 7, 0, None, None, "", "cc-by-nc", 1.0, ["cc-by-nc:0:7:7"])
