"""Column expressions shared by the operators; all of them native."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlens.schema import SIR

PERIODS = ("year", "month", "quarter")


def in_set(column: str | Column, values: Iterable) -> Column:
    """Membership that is never null: a null is a member only if None is listed.

    Made of comparisons a file scan can take over, also when negated.
    """
    col = F.col(column) if isinstance(column, str) else column
    listed = list(values)
    known = [v for v in listed if v is not None]
    hit = (col.isNotNull() & col.isin(known)) if known else F.lit(False)
    return hit | col.isNull() if len(known) < len(listed) else hit


def in_range(column: str | Column, low=None, high=None) -> Column | None:
    """Closed range with optional ends; None when both ends are open."""
    col = F.col(column) if isinstance(column, str) else column
    bounds = ([col >= F.lit(low)] if low is not None else []) + (
        [col <= F.lit(high)] if high is not None else []
    )
    if not bounds:
        return None
    return bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]


def sir_value(column: str) -> Column:
    """S, I or R whatever the case and padding; anything else is null."""
    text = F.upper(F.trim(F.col(column)))
    return F.when(text.isin(*SIR), text)


def period_start(column: str, kind: str) -> Column:
    """First day of the month or quarter, or the year as a number."""
    if kind not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {kind!r}")
    day = F.col(column)
    return F.year(day) if kind == "year" else F.trunc(day, kind)


def period_label(column: str, kind: str) -> Column:
    """``Jan 2018``, ``2018 Q1`` or ``2018`` for a period column."""
    if kind not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {kind!r}")
    col = F.col(column)
    if kind == "month":
        return F.date_format(col, "MMM yyyy")
    if kind == "quarter":
        return F.concat(F.year(col).cast("string"), F.lit(" Q"), F.quarter(col).cast("string"))
    return col.cast("string")


def percent_text(value: Column, digits: int = 1, space: bool = False) -> Column:
    """A percentage as text, ``12.3%`` or ``12.3 %``; whole numbers lose the ``.0``."""
    number = F.regexp_replace(F.round(value, digits).cast("string"), r"\.0$", "")
    return F.concat(number, F.lit(" %" if space else "%"))


def total(value: str | Column) -> Column:
    """Sum that ignores nulls and is 0 when nothing is left."""
    result = F.sum(value)
    return F.coalesce(result, F.lit(0))
