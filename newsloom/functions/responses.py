"""Parsing of generated timeline items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import LINE_BREAK, present, strip


def _field(parsed: Column, name: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(parsed, f"$.{name}", "string"), F.lit("")))


def _unfenced(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def _item(title: Column, content: Column, problem: Column) -> Column:
    blank = (F.coalesce(title, F.lit("")) == "") | (F.coalesce(content, F.lit("")) == "")
    found = F.coalesce(problem, F.when(blank, F.lit("missing_field")))
    return F.struct(
        F.when(found.isNull(), title).alias("title"),
        F.when(found.isNull(), content).alias("content"),
        found.alias("problem"),
    )


def _from_lines(bare: Column) -> Column:
    """Plain text: the first line that is not blank is the title."""
    lines = F.filter(F.split(bare, LINE_BREAK, -1), lambda x: strip(x) != "")
    title = F.left(F.btrim(F.try_element_at(lines, F.lit(1)), F.lit(" #")), F.lit(180))
    empty = F.when(F.coalesce(bare, F.lit("")) == "", F.lit("empty_response"))
    return _item(title, bare, empty)


def _from_json(parsed: Column) -> Column:
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    problem = F.when(parsed.isNull(), F.lit("malformed_json")).when(
        ~is_object, F.lit("not_an_object")
    )
    return _item(_field(parsed, "title"), _field(parsed, "content"), problem)


def parse_timeline_item(response: Column) -> Column:
    """Struct of title, content and problem.

    A code fence is removed; then the text itself or its outermost ``{...}`` is
    read as JSON; text without braces gives its first line as the title. The
    problem is null exactly when both fields could be read and are not empty.
    """

    def read(bare: Column) -> Column:
        def choose(whole: Column) -> Column:
            block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
            inner = let(F.try_parse_json(present(block)), _from_json)
            return (
                F.when(whole.isNotNull(), _from_json(whole))
                .when(F.coalesce(block, F.lit("")) == "", _from_lines(bare))
                .otherwise(inner)
            )

        return let(F.try_parse_json(bare), choose)

    return let(strip(response), lambda text: let(_unfenced(text), read))
