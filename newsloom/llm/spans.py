"""Places of regular-expression matches in texts, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a text without matches has.
NONE = "array<struct<start:bigint,end:bigint,text:string,part:string>>"


def matches(text: Column, pattern: str, part: int = 0) -> Column:
    """All matches from left to right as structs: start, end (code points), text, and a group's text.

    A text is cut at the matches; what lies between them and the matches
    themselves, end to end, give the places.
    """
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.regexp_extract_all(text, regex, F.lit(part)) if part else found
    between = F.split(text, pattern, -1)

    def add(state: Column, row: Column) -> Column:
        begin = state["at"] + F.char_length(row["between"])
        end = begin + F.char_length(row["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), row["found"].alias("text"), row["part"].alias("part"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    rows = F.arrays_zip(
        F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"), parts.alias("part")
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(NONE).alias("out"))
    listed = F.aggregate(rows, empty, add, lambda state: state["out"])
    return F.when(F.coalesce(F.regexp_like(text, regex), F.lit(False)), listed).otherwise(F.array().cast(NONE))


def joined(spans: Column) -> Column:
    """Spans (kind, start, end) as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with the spans, sorted by start, replaced by ``mask``; overlapping ones together."""

    def add(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        kept = F.substring(text, state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], kept, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, add, rest)).otherwise(text)
