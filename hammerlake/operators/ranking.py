"""Orders, picks and samples; each order is total, so results are the same every time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, order: Sequence[Column], n: int, minus: DataFrame | None = None, key: str = "") -> DataFrame:
    """The first ``n`` rows in ``order`` without those whose key ``minus`` has."""
    if minus is not None:
        rows = rows.join(minus.select(key).distinct(), key, "left_anti")
    return rows.orderBy(*order).limit(n)


def ranked_within(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``nth``; tasks cut their groups before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)


def steps(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows at which a key's value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int = 60) -> DataFrame:
    """Page ``number`` from 1 of ``size`` rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def over_rate(rows: DataFrame, key: str, ts: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Rows that are more than the ``limit``-th of their key within the ``seconds`` that end with them.

    Only the row ``limit`` places before counts, so a window holds no range of rows.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn("_back", F.lag(at, limit).over(w)).where(at - F.col("_back") < seconds * 1_000_000).drop("_back")


def dealt(rows: DataFrame, key: str, tasks_a_core: int = 4) -> DataFrame:
    """``rows`` in several tasks for each core, whatever the number of files: for what computes long on few bytes."""
    return rows.repartition(tasks_a_core * rows.sparkSession.sparkContext.defaultParallelism, key)
