"""Months, tasks and freshness: what an incremental load has and still needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerlake.functions import numbers


def months_back(newest: Column, count: int) -> Column:
    """``count`` months as ``YYYYMM``, the newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: numbers.month_text(newest - k))


def tasks(districts: DataFrame, kinds: DataFrame, newest: Column, count: int, done: DataFrame, open_months: int = 1) -> DataFrame:
    """``(lawd_cd, kind, ym)`` of the partitions that are still to be read: each district's kinds in each of the last ``count``
    months, without the closed ones that ``done`` has. The newest ``open_months`` are read again each time."""
    every = districts.select("lawd_cd", "kind").distinct().join(kinds.select("kind").distinct(), "kind", "left_semi")
    every = every.select("lawd_cd", "kind", F.posexplode(months_back(newest, count)).alias("back", "ym"))
    closed = done.select("lawd_cd", "kind", "ym").distinct().withColumn("_d", F.lit(True))
    return every.join(closed, ["lawd_cd", "kind", "ym"], "left").where((F.col("back") < open_months) | F.col("_d").isNull()).select("lawd_cd", "kind", "ym")


def store_counts(partitions: DataFrame) -> DataFrame:
    """``(partitions, rows, months, districts)`` of a store of partitions (lawd_cd, ym, n); an empty one has 0 rows."""
    return partitions.agg(F.count(F.lit(1)).alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.countDistinct("ym").alias("months"), F.countDistinct("lawd_cd").alias("districts"))


def freshness(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """``(present, newest, fresh)``: fresh is null where there is no row or no time: what isn't known is neither fresh nor stale."""
    newest = rows.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("newest"))
    return newest.select((F.col("n") > 0).alias("present"), "newest", (F.unix_seconds(now) - F.unix_seconds(F.col("newest").cast("timestamp")) <= hours * 3600).alias("fresh"))


def divergence(rows: DataFrame, keys: Sequence[str], month: str, value: str, newest: Column, short: int = 12, long: int = 60, least: int = 3) -> DataFrame:
    """``(keys, n_short, n_long, ratio)``: the median of the last months over that of the longer window, where both have enough."""
    within = lambda m: F.when(F.col(month) > newest - m, F.col(value))
    both = rows.groupBy(*keys).agg(F.count(within(short)).alias("n_short"), F.count(within(long)).alias("n_long"), F.median(within(short)).alias("_s"), F.median(within(long)).alias("_l"))
    return both.select(*keys, "n_short", "n_long", F.when((F.col("n_short") >= least) & (F.col("n_long") >= least) & (F.col("_l") != 0), F.col("_s") / F.col("_l")).alias("ratio"))
