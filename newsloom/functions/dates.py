"""Instants written in feeds: RFC 822 and its variants, asctime, and ISO 8601 in parts.

A text is cut into its parts by one pattern per family; the parts, the zone table
and the era rule make the instant. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.binding import let

# Minutes east of UTC by zone name. Names that are not here count as UTC.
ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "WET": 0,
    "BST": 60, "WEST": 60, "CET": 60, "MET": 60, "CEST": 120, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AST": -240, "ADT": -180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
}
# Fixed value: two-digit years below this one belong to the 2000s.
ERA = 90
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?"
# [weekday,] day month year [clock] [zone]
_RFC = rf"(?i)^(?:[a-z]+\.?,?\s+)?(\d{{1,2}})(?:\s+|-)([a-z]{{3}})[a-z]*\.?(?:\s+|-)(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK})?\s*([a-z+-].*)?$"
_RFC_PARTS = "$3|$2|$1|$4|$5|$6|$7"
# weekday month day clock [zone] year
_ASCTIME = rf"(?i)^[a-z]+,?\s+([a-z]{{3}})[a-z]*\.?\s+(\d{{1,2}})\s+{_CLOCK}\s+(?:([a-z]+)\s+)?(\d{{4}})$"
_ASCTIME_PARTS = "$7|$1|$2|$3|$4|$5|$6"
# year-month[-day[Tclock[zone]]]
_ISO = rf"(?i)^(\d{{4}})-(\d{{2}})(?:-(\d{{2}})(?:(?:T|\s+){_CLOCK})?)?\s*(Z|UTC|[+-]\d{{2}}(?::?\d{{2}})?)?$"
_ISO_PARTS = "$1|$2|$3|$4|$5|$6|$7"


def _zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC of ``+0200``, ``+02:00``, ``UTC+2``, ``EST`` or nothing."""
    table = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    numeric = r"(?i)^(?:gmt|utc)?\s*([+-])(\d{1,2}):?(\d{2})?\b.*$"
    number = lambda group: F.coalesce(text.present(F.regexp_extract(zone, numeric, group)).try_cast("int"), F.lit(0))
    minutes = number(2) * 60 + number(3)
    named = F.try_element_at(table, F.upper(F.regexp_extract(zone, r"^[A-Za-z]+", 0)))
    return F.when(zone.rlike(numeric), F.when(F.regexp_extract(zone, numeric, 1) == "-", -minutes).otherwise(minutes)).otherwise(
        F.coalesce(named, F.lit(0))
    )


def _instant(parts: Column) -> Column:
    """The instant of year, month (number or name), day, hour, minute, second and zone."""
    # A failed cast costs an exception each time, so names and empty parts are not cast.
    number = lambda i: F.when(parts[i].rlike("^[0-9]"), parts[i]).try_cast("int")
    year = F.when(F.length(parts[0]) == 2, number(0) + F.when(number(0) < ERA, 2000).otherwise(1900)).otherwise(number(0))
    place = F.instr(F.lit(_MONTHS), F.lower(parts[1]))
    named = F.when((place > 0) & (place % 3 == 1), ((place + 2) / 3).cast("int"))
    month = F.coalesce(number(1), named)
    missing = lambda i, value: F.coalesce(number(i), F.lit(value))
    second = F.coalesce(text.present(parts[5]).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    local = F.try_make_timestamp(year, month, missing(2, 1), missing(3, 0), missing(4, 0), second)
    return F.timestamp_add("MINUTE", -_zone_minutes(parts[6]), local)


def feed_time(value: Column) -> Column:
    """The instant that a feed date names; null when it is none.

    A date without a clock is midnight, one without a zone, or with a zone name
    that is not in ``ZONES``, is UTC; a month without a day is its first.
    """

    def read(s: Column) -> Column:
        families = ((_RFC, _RFC_PARTS), (_ISO, _ISO_PARTS), (_ASCTIME, _ASCTIME_PARTS))
        parts = F.coalesce(
            *[F.when(s.rlike(pattern), F.split(F.regexp_replace(s, pattern, order), r"\|", -1)) for pattern, order in families]
        )
        return let(parts, _instant)

    return let(text.strip(value), read)
