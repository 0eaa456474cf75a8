"""JSON of unknown shape, classes of texts, and rows that came before the schema grew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_walk(rows: DataFrame, keys: Sequence[str], body: str, depth: int = 6) -> DataFrame:
    """``(keys, path, value)`` of all scalars in JSON texts: ``a.b[0].c``. What lies deeper than ``depth`` is given as its JSON text;
    nulls have a path and no value. A document is opened level by level in one pass, as an array of its own entries: no document meets another."""
    entry = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    kind = lambda e: F.substring(F.trim(e["value"]), 1, 1)

    def opened(e: Column) -> Column:
        of_map = F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: entry(F.when(e["path"] == "", x["key"]).otherwise(F.concat(e["path"], F.lit("."), x["key"])), x["value"]))
        of_list = F.transform(F.from_json(e["value"], "array<string>"), lambda x, i: entry(F.concat(e["path"], F.lit("["), i.cast("string"), F.lit("]")), x))
        return F.coalesce(F.when(kind(e) == "{", of_map).when(kind(e) == "[", of_list), F.array(e))

    nested = lambda e: F.coalesce(kind(e).isin("{", "["), F.lit(False))
    level = lambda entries, _: F.when(F.exists(entries, nested), F.flatten(F.transform(entries, opened))).otherwise(entries)
    every = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(entry(F.lit("").cast("string"), F.col(body))), level)
    return rows.select(*keys, F.explode(every).alias("_e")).select(*keys, "_e.path", "_e.value")


def classify(rows: DataFrame, keys: Sequence[str], text: str, patterns: dict[str, str], other: str = "other") -> DataFrame:
    """``(keys, label)``: each class whose pattern a text matches, in the order of ``patterns``; ``other`` where none does. Null texts have none."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns.items()]))
    labels = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))
    return rows.where(F.col(text).isNotNull()).select(*keys, F.explode(labels).alias("label"))


def class_rounds(labelled: DataFrame, round_: str) -> DataFrame:
    """``(label, first_round, rounds, n)``: when each class was first seen, in how many rounds, and how often."""
    return labelled.groupBy("label").agg(F.min(round_).alias("first_round"), F.countDistinct(round_).alias("rounds"), F.count(F.lit(1)).alias("n"))


def grown(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns that a later schema has: missing ones get their default, and a null in one that isn't missing stays."""
    new = {c: v for c, v in defaults.items() if c not in rows.columns}
    return rows.withColumns(new) if new else rows


def refreshed(stored: DataFrame, keys: Sequence[str], column: str, source: DataFrame) -> DataFrame:
    """``(keys, column)`` of the rows whose derived column differs from what ``source`` now gives: all that a mirror has to be sent."""
    now = source.select(*keys, F.col(column).alias("_now"))
    changed = ~F.col(column).eqNullSafe(F.col("_now")) & F.col("_now").isNotNull()
    return stored.select(*keys, column).join(now, list(keys)).where(changed).select(*keys, F.col("_now").alias(column))


def precision(rows: DataFrame, outcomes: DataFrame, keys: Sequence[str], score: str, hit: Column, least: float) -> DataFrame:
    """``(n, picked, hits, precision)``: of the rows with a score and an outcome, those at ``least`` or above, and how many of them were right."""
    both = rows.where(F.col(score).isNotNull()).join(outcomes, list(keys))
    counted = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= least).alias("picked"), F.count_if((F.col(score) >= least) & hit).alias("hits"))
    return counted.select("n", "picked", "hits", F.try_divide("hits", "picked").alias("precision"))
