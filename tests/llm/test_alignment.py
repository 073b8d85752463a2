"""Token alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import pytest

from newsloom.llm import token_alignment
from newsloom.llm.bpe import byte_letters, vocabulary_path
from newsloom.llm.token_alignment import FIRST, SECOND, diagonal_groups

TEXTS = [
    "The quick brown fox, it's jumping over 12345 lazy dogs.\n\nNew  line\tand   blanks ",
    "Ünïcödé ßtraße – 漢字かな交じり文 🙂👍🏽 é",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST]",
    " leading space",
    "\ttab first\x00nul\x1c\x85  x",
    "\n",
    "a",
    "",
    None,
    "mis▁match",
    "x" * 3000 + " " * 50 + "\n" * 20 + "end",
    "word " * 20_000,
    "word " * 20_000,
]


def brute_force(rows):
    """Rows as the contract states them, with the libraries' encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary_path(FIRST))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(SECOND))
    letters = byte_letters()
    out, counts = [], Counter()
    for doc, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        whole = (" " + (text or "")).encode()
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((doc, [], [], [], []))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at = 0
            ends.append([at := at + len(p) for p in parts])
        links, j = [], 0
        for i, end in enumerate(ends[0]):
            start = end - len(bytes_a[i])
            while ends[1][j] <= start:
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(bytes_b[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        common = sorted({*ends[0]} & {*ends[1]})
        groups, p, q = [], 0, 0
        for end in common:
            i, j2 = ends[0].index(end, p) + 1, ends[1].index(end, q) + 1
            groups.append((a[p:i], b[q:j2]))
            p, q = i, j2
        counts.update(links)
        out.append((doc, a, b, groups, links))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    result = []
    for doc, a, b, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(counts[link] == top[link[1]] for link in links)
        result.append((doc, len(a), len(b), len(groups), len(links), digest, best, sum(counts[link] for link in links)))
    return sorted(result, key=repr)


@pytest.fixture(scope="module")
def paths():
    return vocabulary_path(FIRST), vocabulary_path(SECOND)


def test_walk_against_all_pairs():
    rng = random.Random(6)
    for _ in range(300):
        size = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randrange(size)), size}) for _ in range(2))
        if rng.random() < 0.3:
            b = list(a)
        runs, left, right, lasts = diagonal_groups(a, b)
        links = [(i, i + shift) for begin, shift, n in runs for i in range(begin, begin + n)] + [*zip(left, right)]
        spans = [[(s, e) for s, e in zip([0, *x], x)] for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert sorted(links) == want
        ends = sorted(a[begin + k] for begin, _, n in runs for k in range(n)) + [a[i] for i, _ in lasts]
        assert sorted(ends) == sorted({*a} & {*b})


def test_alignment_against_libraries(spark, paths, monkeypatch):
    rng = random.Random(7)
    alphabet = "ab The,.'s \n\t0é漢🙂 "
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "".join(rng.choices(alphabet, k=rng.randrange(1, 60)))) for i in range(150)]
    rows += [(5, "again"), (5, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, n_a int, chunk int").repartition(3)
    got = sorted((tuple(r) for r in token_alignment.align(docs, *paths).collect()), key=repr)
    assert got == brute_force(rows)
    assert token_alignment.align(docs.limit(0), *paths).count() == 0
    assert token_alignment.align(docs.where("text IS NULL"), *paths).count() == 2


def test_long_texts_are_cut_without_a_trace(paths, monkeypatch):
    monkeypatch.setattr(token_alignment, "LONG_TEXT", 40)
    texts = [t for t in TEXTS if t] + ["several words  with blanks\n and lines " * 9]
    side = token_alignment.load_pair(*paths)[1]
    assert side.parts
    for text, ids in zip(texts, side.encode(texts)):
        assert ids.tolist() == side.model.encode(text)


def test_long_white_space(paths, monkeypatch):
    side = token_alignment.load_pair(*paths)[0]
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", ".", "'s", " ", "\n", "\x1c", " " * 7, "\u3000\n "]) for _ in range(25))
        monkeypatch.setattr(token_alignment, "LONG_BLANK", 10_000)
        whole = side.encode([text])[0].tolist()
        monkeypatch.setattr(token_alignment, "LONG_BLANK", 2)
        assert side.encode([text])[0].tolist() == whole
    monkeypatch.setattr(token_alignment, "LONG_BLANK", 10_000)
    assert len(side.encode([" " * 3_000_000 + "a"])[0]) == 3_000_001


def test_groups_column(spark, paths):
    docs = spark.createDataFrame([("hello world", 1), (None, 2)], "text string, groups int")
    rows = token_alignment.align_groups(docs, *paths).collect()
    one, two = token_alignment.load_pair(*paths)
    assert [x for g in rows[0]["_groups"] for x in g.a] == one.encode(["hello world"])[0].tolist()
    assert [x for g in rows[0]["_groups"] for x in g.b] == two.encode(["hello world"])[0].tolist()
    assert rows[1]["_groups"] == []
