"""Robust price bands: trimmed, recent, laddered and rolling.

Counts and medians are partial aggregates, and the two smallest values come from a limited window, which leaves two
rows of each group and task before the shuffle. Where windows overlap, no row is multiplied: each month's values are
gathered once, as an exact median's state is, and the windows are put together from months.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIM_FROM, MIN_BASIS = 4, 3
#: Limits of a ratio of two sides, and how many values each needs.
LEAST_RATIO, MOST_RATIO, MIN_SIDE = 0.65, 1.0, 3
#: Months that a window looks back, and what its confidence is multiplied by.
LADDER = ((12, 1.0), (24, 0.9), (60, 0.75))


def trimmed_band(rows: DataFrame, keys: Sequence[str], value: str, min_basis: int = MIN_BASIS) -> DataFrame:
    """``(keys, basis, lo, mid)``: from ``TRIM_FROM`` values on, one smallest and one largest are left out.

    The median is the same with and without them, so only the low end needs the second smallest value. Groups
    with fewer than ``min_basis`` values left have no band. Null values are ignored.
    """
    rows = rows.where(F.col(value).isNotNull())
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.median(value).alias("mid"))
    low = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where("_i <= 2")
    low = low.groupBy(*keys).agg(F.min(value).alias("_first"), F.max(value).alias("_second"))
    trimmed = F.col("_n") >= TRIM_FROM
    out = whole.join(low, list(keys)).select(*keys, (F.col("_n") - F.when(trimmed, 2).otherwise(0)).alias("basis"), F.when(trimmed, F.col("_second")).otherwise(F.col("_first")).alias("lo"), "mid")
    return out.where(F.col("basis") >= min_basis)


def recent(rows: DataFrame, keys: Sequence[str], month: str, months: int = 12, inclusive: bool = True) -> DataFrame:
    """Rows of the last ``months`` before each group's newest month; with ``inclusive`` the month at the edge too.

    Rows without a month stay, as all rows of groups that know none.
    """
    newest = rows.groupBy(*keys).agg(F.max(month).alias("_newest"))
    edge = F.col("_newest") - months + (0 if inclusive else 1)
    return rows.join(newest, list(keys)).where(F.col(month).isNull() | F.col("_newest").isNull() | (F.col(month) >= edge)).drop("_newest")


def recent_band(rows: DataFrame, keys: Sequence[str], month: str, value: str, low: Column, sided: Column, *more: Column, months: int = 12) -> DataFrame:
    """``(keys, more, basis, lo, mid, ratio)``: ``trimmed_band`` of the ``recent`` values, with at least one left, and ``clamped_ratio`` of
    those that are ``sided``; where there is none, basis, lo and mid are null. ``more`` are aggregates of all rows. One shuffle serves them all."""
    of = Window.partitionBy(*keys)
    newest = F.max(month).over(of)
    new = F.when(F.col(month).isNull() | newest.isNull() | (F.col(month) >= newest - months), F.col(value))
    rows = rows.withColumn("_v", new).withColumn("_i", F.row_number().over(of.orderBy(F.asc_nulls_last("_v"))))
    side = lambda c: F.when(sided & c, F.col("_v"))
    sums = rows.groupBy(*keys).agg(*more, F.count("_v").alias("_n"), F.median("_v").alias("mid"), F.min(F.when(F.col("_i") == 1, F.col("_v"))).alias("_first"), F.min(F.when(F.col("_i") == 2, F.col("_v"))).alias("_second"), *_sides(side, low))
    trimmed = F.col("_n") >= TRIM_FROM
    known = lambda x: F.when(F.col("_n") > 0, x)
    kept = [c for c in sums.columns if not c.startswith("_") and c != "mid"]
    return sums.select(*kept, known(F.col("_n") - F.when(trimmed, 2).otherwise(0)).alias("basis"), known(F.when(trimmed, F.col("_second")).otherwise(F.col("_first"))).alias("lo"), known(F.col("mid")).alias("mid"), _clamped(LEAST_RATIO, MOST_RATIO, MIN_SIDE).alias("ratio"))


def _by_month(rows: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """``(keys, month, values)``: one row for each month of a group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, month).agg(F.collect_list(value).alias("values"))


def _band(months: Column, min_basis: int) -> Column:
    """``(basis, lo, mid)`` of the values of several months; null if too few are left."""

    def of(v: Column) -> Column:
        n = F.size(v)
        trimmed = n >= TRIM_FROM
        below, above = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
        basis = (n - F.when(trimmed, 2).otherwise(0)).cast("long")
        return F.when(basis >= min_basis, F.struct(basis.alias("basis"), F.get(v, F.when(trimmed, 1).otherwise(0)).alias("lo"), (below + (above - below) * 0.5).alias("mid")))

    return F.get(F.transform(F.array(F.array_sort(F.flatten(months))), of), 0)  # by way of an array, so that values are sorted once


def window_ladder(rows: DataFrame, keys: Sequence[str], month: str, value: str, steps: Sequence[tuple[int, float]] = LADDER) -> DataFrame:
    """``(keys, months, confidence, basis, lo, mid)`` of the shortest window that has a band."""
    groups = _by_month(rows.where(F.col(month).isNotNull()), keys, month, value).groupBy(*keys).agg(F.max(month).alias("_newest"), F.collect_list(F.struct(F.col(month).alias("m"), "values")).alias("_all"))
    within = lambda m: F.transform(F.filter("_all", lambda x: x["m"] >= F.col("_newest") - m), lambda x: x["values"])
    best = groups.select(*keys, F.coalesce(*[F.when(b.isNotNull(), F.struct(F.lit(m).alias("months"), F.lit(c).alias("confidence"), b.alias("b"))) for m, c in steps for b in (_band(within(m), MIN_BASIS),)]).alias("w")).where("w is not null")
    return best.select(*keys, "w.months", "w.confidence", "w.b.basis", "w.b.lo", "w.b.mid")


def _sides(side: Callable[[Column], Column], low: Column) -> list[Column]:
    return [F.count(side(low)).alias("_a"), F.count(side(~low)).alias("_b"), F.median(side(low)).alias("_x"), F.median(side(~low)).alias("_y")]


def _clamped(least: float, most: float, min_side: int) -> Column:
    enough = (F.col("_a") >= min_side) & (F.col("_b") >= min_side) & (F.col("_y") != 0)
    return F.when(enough, F.greatest(F.lit(least), F.least(F.lit(most), F.col("_x") / F.col("_y"))))


def clamped_ratio(rows: DataFrame, keys: Sequence[str], low: Column, value: str, least: float = LEAST_RATIO, most: float = MOST_RATIO, min_side: int = MIN_SIDE) -> DataFrame:
    """``(keys, ratio)``: median of the low side over that of the other, clamped; null if a side has too few."""
    sides = rows.groupBy(*keys).agg(*_sides(lambda c: F.when(c, F.col(value)), low))
    return sides.select(*keys, _clamped(least, most, min_side).alias("ratio"))


def rolling_band(rows: DataFrame, keys: Sequence[str], month: str, value: str, months: int = 12) -> DataFrame:
    """``(keys, month, basis, lo, mid)`` for each month that occurs: the band of the ``months`` that end with it."""
    frame = Window.partitionBy(*keys).orderBy(month).rangeBetween(1 - months, 0)
    framed = _by_month(rows, keys, month, value).select(*keys, month, F.collect_list("values").over(frame).alias("_months"))
    return framed.select(*keys, month, _band(F.col("_months"), MIN_BASIS).alias("b")).where("b is not null").select(*keys, month, "b.basis", "b.lo", "b.mid")
