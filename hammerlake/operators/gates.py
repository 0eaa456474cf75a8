"""Checks of data: each a count of violations, all reported in one table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def violations(name: str, rows: DataFrame) -> DataFrame:
    """``(gate, violations, ok)`` for a table whose rows are the violations."""
    return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") == 0).alias("ok"))


def share(name: str, rows: DataFrame, good, least: float, min_rows: int = 50) -> DataFrame:
    """Fails if fewer than ``least`` of the rows are good; under ``min_rows`` nothing can be told, and it passes."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("g"))
    bad = (F.col("n") >= min_rows) & (F.col("g") < least * F.col("n"))
    return counted.select(F.lit(name).alias("gate"), F.when(bad, F.col("n") - F.col("g")).otherwise(0).cast("long").alias("violations"), (~bad).alias("ok"))


def least_share(name: str, rows: DataFrame, goods: list[Column], least: float, min_rows: int = 50) -> DataFrame:
    """``share`` for the worst of several conditions."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.least(*[F.count_if(g) for g in (*goods, goods[0])]).alias("g"))
    bad = (F.col("n") >= min_rows) & (F.col("g") < least * F.col("n"))
    return counted.select(F.lit(name).alias("gate"), F.when(bad, F.col("n") - F.col("g")).otherwise(0).cast("long").alias("violations"), (~bad).alias("ok"))


def samples(gates: dict[str, DataFrame], most: int = 5) -> DataFrame:
    """``(gate, sample)``: the first ``most`` violations of each gate, by the ``sample`` that names them."""
    first = [rows.select(F.lit(name).alias("gate"), F.col("sample").cast("string").alias("sample")).orderBy("sample").limit(most) for name, rows in gates.items()]
    return reduce(DataFrame.unionByName, first)


def run(spark: SparkSession, gates: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The results of all gates, from one job that brings a row of each: what several of them read or join is read once.

    One that can't be run has failed (its violations are null), and the others still tell: those that can't be planned are left out of
    the job, and if the job itself fails, each gate is run alone.
    """
    planned: dict[str, DataFrame] = {}
    rows: list[tuple] = []
    for name, gate in gates.items():
        try:
            planned[name] = gate().select("gate", "violations", "ok")
        except (PySparkException, Py4JError):
            rows.append((name, None, False))
    try:
        rows += [tuple(r) for r in reduce(DataFrame.unionByName, planned.values()).collect()] if planned else []
    except (PySparkException, Py4JError):
        for name, gate in planned.items():
            try:
                rows.append(tuple(gate.first()))
            except (PySparkException, Py4JError):
                rows.append((name, None, False))
    return spark.createDataFrame(rows, "gate string, violations long, ok boolean")
