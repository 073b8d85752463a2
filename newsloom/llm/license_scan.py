"""License scan with a generalised suffix automaton of licence tokens.

The words of all licence templates and phrases make one automaton. A text runs
through it word by word; at each word the automaton gives the longest run of
words that ends there and stands in some template (the matching statistics), and
with it every phrase that ends there. Runs that the next word breaks off are the
maximal matches. Long ones are laid out by their places in a template and chained
where both the text and the template go forward; a chain that covers enough of
a template is a span with that template's label.

Words that no template has reset the automaton, so only stretches of known words
are walked. Equal words of several templates share states, and a state's places
are one range of an array, so the automaton is linear in the templates.

Cases: a null or wordless text has no words, places or spans, and score 0; texts of
any length are read whole; repeated rows are judged each for itself; an empty
table gives an empty result; other columns stay as they are (or are not read
by the query). Of two chains that cover as much, the one that begins first counts.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, fresh, table, utf8
from newsloom.llm.decontamination import words_of

#: Words of the shortest match that takes part in a chain.
LONG = 4
#: Words of the text that may lie between two matches of a chain.
GAP = 40
#: Share of a template's words that a span covers at least.
COVER = 0.6

#: The phrases of the base rule, by label.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

#: Notices and short licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License"
        " for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"
        " (at your option) any later version.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means.",
    ),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "places",
            T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])),
        ),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("template", T.IntegerType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("covered", T.LongType()),
                        T.StructField("share", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


class SuffixAutomaton:
    """All substrings of several sequences of numbers, with the places of each."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for number, sequence in enumerate(sequences):
            state = 0
            for end, symbol in enumerate(sequence, 1):
                state = self._extend(state, symbol)
                ends.setdefault(state, []).append((number, end))
        self._lay_out(ends)

    def _state(self, length: int, onward: dict[int, int], link: int) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _copy(self, state: int, symbol: int, target: int) -> int:
        """The part of ``target`` that ``state`` reaches, as a state of its own."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, symbol: int) -> int:
        """The state of the sequence in ``state`` with ``symbol`` behind it."""
        target = self.next[state].get(symbol)
        if target is not None:  # an earlier sequence has been here
            return target if self.length[target] == self.length[state] + 1 else self._copy(state, symbol, target)
        new = self._state(self.length[state] + 1, {}, 0)
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            fits = self.length[target] == self.length[state] + 1
            self.link[new] = target if fits else self._copy(state, symbol, target)
        return new

    def _lay_out(self, ends: dict[int, list[tuple[int, int]]]) -> None:
        """Places in the order of a walk over the link tree: each state's lie in one range."""
        below: list[list[int]] = [[] for _ in self.next]
        for state, up in enumerate(self.link[1:], 1):
            below[up].append(state)
        self.places: list[tuple[int, int]] = []
        self.low, self.high = [0] * len(self.next), [0] * len(self.next)
        open_ = [0]
        while open_:
            state = open_.pop()
            if state < 0:
                self.high[~state] = len(self.places)
                continue
            self.low[state] = len(self.places)
            self.places += ends.get(state, [])
            open_.append(~state)
            open_ += below[state]

    def find(self, sequence: list[int]) -> int:
        """The state of a sequence that it holds."""
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state

    def places_of(self, state: int) -> list[tuple[int, int]]:
        """Where the sequences of a state end: number of the sequence, and end."""
        return self.places[self.low[state] : self.high[state]]


def best_chain(matches: list[tuple[int, int, int]], size: int) -> tuple[int, int, int]:
    """Covered words, start and end in the text of the best chain of (text start, template start, length).

    A chain goes forward in the text and in the template without overlap. The
    best chain up to each end in the template stands in a tree of prefix maxima
    over the template's words; matches enter it once the text has passed them.
    """
    tree: list[tuple[int, int, int]] = [(0, 0, 0)] * (size + 1)  # covered, -start, end
    top = (0, 0, 0)
    events = sorted([(s, 1, t, n) for s, t, n in matches] + [(s + n, 0, t, n) for s, t, n in matches])
    value: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for at, begins, t, n in events:
        if begins:
            found, i = (0, 0, 0), t
            while i > 0:
                found = max(found, tree[i])
                i -= i & -i
            start = found[1] if found[0] else -at
            chain = (found[0] + n, start, at + n)
            value[at, t, n] = chain
            top = max(top, chain, key=lambda c: c[:2])
        else:
            chain, i = value[at - n, t, n], t + n
            while i <= size:
                tree[i] = max(tree[i], chain)
                i += i & -i
    return top[0], -top[1], top[2]


class LicenseIndex:
    """Templates and phrases, ready to scan texts."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, long: int = LONG, gap: int = GAP, cover: float = COVER):
        self.long, self.gap, self.cover = long, gap, cover
        texts = [words_of(text.encode()) for _, text in (*templates, *phrases)]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for words in texts for w in words}), 1)}
        coded = [[self.vocabulary[w] for w in words] for words in texts]
        self.automaton = SuffixAutomaton(coded)
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words) for words in coded[: len(templates)]]
        self.shortest = min([long, *(len(words) for words in coded[len(templates) :] if words)])
        self.phrases: list[tuple[tuple[str, int], ...]] = [()] * len(self.automaton.next)
        for (label, _), words in zip(phrases, coded[len(templates) :], strict=True):
            if words:
                self.phrases[self.automaton.find(words)] += ((label, len(words)),)
        for state in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[state] += self.phrases[self.automaton.link[state]]

    def statistics(self, words: list[int], first: int = 0) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]]]:
        """Phrase places, and maximal matches (start, length, state), of known words; places count from ``first``."""
        onward, link, size, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        places, matches = [], []
        state = held = 0
        for at, word in enumerate(words, first):
            target = onward[state].get(word)
            if target is None:
                if held >= self.long:
                    matches.append((at - held, held, state))
                while target is None and state:
                    state = link[state]
                    held = size[state]
                    target = onward[state].get(word)
                if target is None:
                    continue
            state = target
            held += 1
            for label, n in phrases[state]:
                if n <= held:
                    places.append((label, at + 1 - n))
        if held >= self.long:
            end = first + len(words)
            matches.append((end - held, held, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Covered template spans of one text's maximal matches."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, state in matches:
            for template, end in self.automaton.places_of(state):
                if template < len(self.sizes):
                    by.setdefault(template, []).append((start, end - n, n))
        out = []
        for template, found in by.items():
            size, group, reach = self.sizes[template], [], 0
            for match in [*sorted(found), None]:
                if group and (match is None or match[0] - reach > self.gap):
                    covered, start, end = best_chain(group, size)
                    if covered >= self.cover * size:
                        out.append({"label": self.labels[template], "template": template, "start": start, "end": end, "covered": covered, "share": covered / size})
                    group = []
                if match is not None:
                    reach = max(reach, match[0] + match[2]) if group else match[0] + match[2]
                    group.append(match)
        return sorted(out, key=lambda s: (s["start"], s["template"]))

    def scan(self, texts: list[bytes]) -> list[dict]:
        """For each text its words, phrase places and spans."""
        get, coded, ends, total = self.vocabulary.get, [], [], 0
        for text in texts:
            words = words_of(text)
            coded.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)))
            coded.append(np.zeros(1, dtype=np.int32))  # no stretch goes on into the next text
            total += len(words) + 1
            ends.append(total)
        firsts = [0, *ends[:-1]]
        out = [{"n_words": end - first - 1, "places": [], "spans": []} for first, end in zip(firsts, ends, strict=True)]
        if not texts:
            return out
        words = np.concatenate(coded)
        edges = np.flatnonzero(np.diff(words != 0, prepend=False))  # begin, end, begin, ...
        begins, stops = edges[::2], edges[1::2]
        wide = stops - begins >= self.shortest
        found: dict[int, list] = {}
        for begin, stop in zip(begins[wide].tolist(), stops[wide].tolist(), strict=True):
            row = bisect_right(ends, begin)
            places, matches = self.statistics(words[begin:stop].tolist(), begin - firsts[row])
            out[row]["places"] += [{"label": label, "start": start} for label, start in places]
            if matches:
                found.setdefault(row, []).extend(matches)
        for row, matches in found.items():
            out[row]["spans"] = self.spans(matches)
        return out


@functools.lru_cache(maxsize=2)
def default_index() -> LicenseIndex:
    """The index of the fixed templates, once per worker."""
    return LicenseIndex()


def scan_licenses(docs: DataFrame, text: str = "text", templates=None, phrases=PHRASES, **options) -> tuple[DataFrame, str]:
    """``docs`` with a column of licence findings, and that column's name.

    The column holds ``n_words``, ``places`` (label and first word of each phrase
    found) and ``spans`` (label, template number, first word, end, covered words of
    the template and their share). ``templates`` and ``phrases`` are pairs of a label and a text.
    """
    name = fresh(docs, "licenses")
    own = None if templates is None and not options and phrases is PHRASES else LicenseIndex(TEMPLATES if templates is None else templates, phrases, **options)

    def make(batch: pa.RecordBatch) -> list:
        return [(own or default_index()).scan(utf8(batch, text))]

    return add_columns(docs, text, [T.StructField(name, SCAN)], make), name


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and the best-covered template of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = scan_licenses(docs)
    starts, base, spans = F.col(f"{name}.places.start"), F.col(f"{name}.places.label"), F.col(f"{name}.spans")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, spans["label"])).alias("labels"),
        F.coalesce(F.array_max(spans["share"]), F.lit(0.0)).alias("score"),
        F.transform(spans, lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["covered"])).alias("spans"),
    )
