"""Main content of HTML pages.

Tree rules (nested boilerplate, first matching region) are beyond regular
expressions, so this is the one place where a page is parsed in Python: a small
helper run over Arrow batches, one page at a time, no state between pages.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Regions that never hold article text, and tags without an end.
DROPPED = frozenset("script style noscript nav footer aside form svg".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

# (html, url) -> (title, text), or None when there is nothing useful.
ContentExtractor = Callable[[str, str], "tuple[str | None, str] | None"]


class _PageText(HTMLParser):
    """Collects the text pieces of the page by region."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dropped_at: int | None = None
        self.main_at: int | None = None
        self.main: list[str] | None = None
        self.main_heading: list[str] | None = None
        self.body: list[str] = []
        self.body_heading: list[str] | None = None
        self.title: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        self.open.append(tag)
        depth = len(self.open)
        if self.dropped_at is not None:
            return
        if tag in DROPPED:
            self.dropped_at = depth
            return
        is_main = tag in ("article", "main") or ("role", "main") in attrs
        if is_main and self.main is None:
            self.main, self.main_at = [], depth
        elif tag == "h1":
            if self.main_at is not None and self.main_heading is None:
                self.main_heading = []
            if self.body_heading is None:
                self.body_heading = []
        elif tag == "title" and self.title is None:
            self.title = []

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            depth = len(self.open)
            closed = self.open.pop()
            if self.dropped_at == depth:
                self.dropped_at = None
            if self.main_at == depth:
                self.main_at = None
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if self.dropped_at is not None or not piece:
            return
        if "title" in self.open:
            if self.title is not None:
                self.title.append(piece)
            return
        if self.main_at is not None:
            self.main.append(piece)
        if "head" not in self.open:
            self.body.append(piece)
        if "h1" in self.open:
            if self.main_at is not None and self.main_heading is not None:
                self.main_heading.append(piece)
            if self.body_heading is not None:
                self.body_heading.append(piece)


def main_content(page: str, url: str) -> tuple[str | None, str] | None:
    """Title and text of the first article/main region, else of the body."""
    parser = _PageText()
    parser.feed(page)
    parser.close()
    pieces = parser.body if parser.main is None else parser.main
    heading = parser.body_heading if parser.main is None else parser.main_heading
    title = " ".join(heading or ()) or " ".join(parser.title or ())
    return (title.strip() or None), " ".join(pieces).strip()


def html_text(markup: Column) -> Column:
    """Text of an HTML snippet, pieces joined by one blank (Arrow UDF)."""
    return _snippet_text(markup)


class _Pieces(HTMLParser):
    """Text pieces of a snippet; code of scripts and styles is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.code = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.code = tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.code = False

    def handle_data(self, data: str) -> None:
        if not self.code and data.strip():
            self.pieces.append(data.strip())


@F.pandas_udf(T.StringType())
def _snippet_text(values: pd.Series) -> pd.Series:
    def text(value: str | None) -> str | None:
        if value is None:
            return None
        if "<" not in value and "&" not in value:
            return value.strip()
        parser = _Pieces()
        parser.feed(value)
        parser.close()
        return " ".join(parser.pieces)

    return values.map(text)
