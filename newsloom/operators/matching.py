"""Whole-word, case-insensitive phrase matching inside one text.

The per-row helper behind alias rewriting and catalog extraction. A phrase is
looked up by its first token, so the cost follows the text, not the catalog.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

TOKEN = re.compile(r"\w+|[^\w\s]")


def fold(text: str) -> str:
    """Lower case with the length kept, so that offsets stay valid."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return lowered
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def first_token(phrase: str) -> str:
    match = TOKEN.search(fold(phrase))
    return match.group() if match else ""


class PhraseIndex:
    """Phrases keyed by first token; yields every whole-word occurrence."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.by_token: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for number, phrase in enumerate(phrases):
            folded = fold(phrase)
            self.by_token[first_token(phrase)].append((folded, number))
        for candidates in self.by_token.values():
            candidates.sort(key=lambda c: (-len(c[0]), c[1]))

    def occurrences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, phrase number), by start, longest first."""
        folded = fold(text)
        length = len(folded)
        for token in TOKEN.finditer(folded):
            candidates = self.by_token.get(token.group())
            if candidates is None:
                continue
            start = token.start()
            if start and is_word(folded[start - 1]):
                continue
            for phrase, number in candidates:
                end = start + len(phrase)
                if folded.startswith(phrase, start) and not (
                    end < length and is_word(folded[end])
                ):
                    yield start, end, number


def is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def replaced(text: str, places: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end) replaced by its word; places are in order and apart."""
    pieces: list[str] = []
    done = 0
    for start, end, word in places:
        pieces += (text[done:start], word)
        done = end
    return "".join([*pieces, text[done:]])


def rewrite(text: str, index: PhraseIndex, replacements: list[str]) -> str:
    """Replace leftmost-longest occurrences in one pass; no cascading."""
    pieces: list[str] = []
    done = 0
    for start, end, number in index.occurrences(text):
        if start < done:
            continue
        pieces.append(text[done:start])
        pieces.append(replacements[number])
        done = end
    if not pieces:
        return text
    pieces.append(text[done:])
    return "".join(pieces)


def spans(text: str, index: PhraseIndex) -> list[tuple[int, int, int]]:
    """All occurrences; only those of the same phrase may not overlap."""
    last_end: dict[int, int] = {}
    found = []
    for start, end, number in index.occurrences(text):
        if start < last_end.get(number, 0):
            continue
        last_end[number] = end
        found.append((start, end, number))
    return found
