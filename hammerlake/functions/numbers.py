"""Column builders for months, rounding, ladders and lenient numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(date: Column) -> Column:
    """Months as one count: year * 12 + month."""
    return (F.year(date) * 12 + F.month(date)).cast("int")


def month_of(ym: Column) -> Column:
    """The month index of ``YYYYMM...`` text; null if it begins otherwise."""
    return F.when(ym.rlike(r"^\d{6}"), F.substring(ym, 1, 4).try_cast("int") * 12 + F.substring(ym, 5, 2).try_cast("int"))


def month_text(index: Column) -> Column:
    """``YYYYMM`` of a month index."""
    return F.format_string("%04d%02d", ((index - 1) / 12).cast("int"), F.pmod(index - 1, F.lit(12)).cast("int") + 1)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def known(value: Column, missing: object = 0) -> Column:
    """Null where a value that stands for missing is given: what is unknown is never a number."""
    return F.when(value != F.lit(missing), value)


def ladder(value: Column, steps: Sequence[tuple[float, object]], otherwise: object = None) -> Column:
    """What belongs to the first step (in the given order) that ``value`` reaches."""
    out = None
    for least, label in steps:
        out = F.when(value >= least, F.lit(label)) if out is None else out.when(value >= least, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def interpolate(value: Column, knots: Sequence[tuple[float, float]], digits: int = 1) -> Column:
    """Piecewise linear between ``knots`` (ascending), held at both ends, rounded half to even."""
    out = F.when(value <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(value <= x1, F.bround(F.lit(float(y0)) + (value - x0) / (x1 - x0) * (y1 - y0), digits))
    return out.when(value.isNotNull(), F.lit(float(knots[-1][1])))


def lenient_number(text: Column) -> Column:
    """A whole number from text with commas or decimals, truncated; null if there is none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double").try_cast("bigint")


def iso_date(text: Column) -> Column:
    """``20260701`` as ``2026-07-01``; other text as it is."""
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)
