"""Three-hour UTC windows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.settings import WINDOW_HOURS, WINDOW_SECONDS


def floor_window(ts: Column) -> Column:
    """Start of the three-hour window holding ``ts``."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(WINDOW_SECONDS)))


def window_end(start: Column) -> Column:
    return start + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")


def covering_starts(first: Column, last: Column) -> Column:
    """Starts of all windows from the one holding ``first`` up to before ``last``."""
    start = floor_window(first)
    step = F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")
    starts = F.sequence(start, F.greatest(last, start), step)
    return F.filter(starts, lambda s: s < last)


def window_at(now: datetime, *, back: int = 0) -> tuple[datetime, datetime]:
    """Bounds of the window that holds ``now``, or of the one ``back`` windows earlier (1: the last closed one).

    Windows are numbered from the epoch; a naive time is UTC.
    """
    aware = now if now.tzinfo else now.replace(tzinfo=UTC)
    number = int(aware.timestamp() // WINDOW_SECONDS) - back
    start, end = (datetime.fromtimestamp(n * WINDOW_SECONDS, UTC) for n in (number, number + 1))
    return start, end
