"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used.

    Expressions are trees: without this, a value used five times is written into
    the plan five times, and nested uses multiply.
    """
    return F.transform(F.array(value), body)[0]
