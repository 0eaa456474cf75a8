"""Joins that fall back, keep order, or patch what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fallback_join(rows: DataFrame, table: DataFrame, steps: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """``rows`` with ``values`` from the first of ``steps`` (key columns of both sides) by which ``table`` has any, and ``found_by`` its
    number from 1. Of several rows of a key the smallest counts; a null in a key joins nothing."""
    out = rows
    for k, keys in enumerate(steps):
        one = table.where(" and ".join(f"`{c}` is not null" for c in keys)).groupBy(*keys).agg(F.min(F.struct(*values)).alias(f"_v{k}"))
        out = out.join(one, list(keys), "left")
    hits = [F.col(f"_v{k}") for k in range(len(steps))]
    by = F.coalesce(*[F.when(h.isNotNull(), F.lit(k + 1)) for k, h in enumerate(hits)])
    return out.withColumns({"_v": F.coalesce(*hits), "found_by": by}).select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values], "found_by")


def pick_in_order(rows: DataFrame, wanted: DataFrame, key: str, short_key: str, most: int) -> DataFrame:
    """The rows that a list of identifiers names, in its order and each once, ``most`` at most.

    ``wanted`` has pos and id: an id with ``|`` is a whole key, another one a short key, of which the smallest whole key counts.
    Unknown ones are passed over.
    """
    whole = wanted.where("id like '%|%'").join(rows.withColumn("id", F.col(key)), "id").select("pos", key)
    short = wanted.where("id not like '%|%'").join(rows.groupBy(F.col(short_key).alias("id")).agg(F.min(key).alias(key)), "id").select("pos", key)
    chosen = whole.unionByName(short).groupBy(key).agg(F.min("pos").alias("pos")).orderBy("pos").limit(most)
    return rows.join(chosen, key)


def lacking(rows: DataFrame, keys: Sequence[str], present: DataFrame, absent: DataFrame) -> DataFrame:
    """``rows`` whose key ``present`` has and ``absent`` doesn't: what is still to be done."""
    return rows.join(present.select(*keys), list(keys), "left_semi").join(absent.select(*keys), list(keys), "left_anti")


def carry_forward(rows: DataFrame, keys: Sequence[str], by: str, columns: Sequence[str]) -> DataFrame:
    """The newest row of each key, with each of ``columns`` from the newest row that has it: null and empty ones are passed over."""
    known = {c: F.max_by(F.when(F.col(c).cast("string") != "", F.col(c)), F.when(F.col(c).cast("string") != "", F.col(by))).alias(c) for c in columns}
    return rows.groupBy(*keys).agg(F.max(by).alias(by), *known.values())


def patch_last(rows: DataFrame, keys: Sequence[str], items: str, amounts: DataFrame, amount: str, is_wanted) -> DataFrame:
    """``rows`` whose array of structs gets ``amount`` in its last element that ``is_wanted`` holds for; keys without an amount stay.

    An element that already has one keeps it; the array stays in its order.
    """
    kinds = [f.name for f in rows.schema[items].dataType.elementType.fields]
    joined = rows.join(amounts.groupBy(*keys).agg(F.max(amount).alias("_a")), list(keys), "left")
    places = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i >= 0) & is_wanted(F.get(items, i)))
    last = F.array_max(places)
    new = F.transform(items, lambda x, i: F.struct(*[(F.when((i == last) & F.col("_a").isNotNull(), F.coalesce(x[k], F.col("_a"))).otherwise(x[k]) if k == amount else x[k]).alias(k) for k in kinds]))
    return joined.select(*[F.when(F.size(items) > 0, new).otherwise(F.col(items)).alias(c) if c == items else F.col(c) for c in rows.columns])


def events(old: DataFrame, new: DataFrame, keys: Sequence[str], price: str, profit: str, date: str, least: int, today: Column) -> DataFrame:
    """``(keys, event)`` between two snapshots: 'new', 'price_cut', 'profit_up' where the profit crosses ``least`` upwards,
    'sold' for what has gone behind its date, 'withdrawn' for what has gone before it. Several may hold for one key."""
    a, b = (x.select(*keys, F.struct(price, profit, date).alias(n)) for x, n in ((old, "_a"), (new, "_b")))
    both = a.join(b, list(keys), "full_outer")
    gone, came = F.col("_b").isNull(), F.col("_a").isNull()
    past = F.col(f"_a.{date}") < today
    kinds = F.array_compact(F.array(
        F.when(came, "new"),
        F.when(~came & (F.col(f"_b.{price}") < F.col(f"_a.{price}")), "price_cut"),
        F.when(~came & (F.col(f"_b.{profit}") >= least) & ~F.coalesce(F.col(f"_a.{profit}") >= least, F.lit(False)), "profit_up"),
        F.when(gone & past, "sold"),
        F.when(gone & ~F.coalesce(past, F.lit(False)), "withdrawn"),
    ))
    return both.select(*keys, F.explode(kinds).alias("event"))


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows when groups take turns in order of their name: all first rows, then all second ones. Each task keeps
    ``n`` rows of a group at most."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", group).limit(n)


def absent_keys(watched: DataFrame, present: DataFrame, key: str, forms: Sequence[Column]) -> DataFrame:
    """The distinct keys of ``watched`` that no row of ``present`` has in any of its ``forms`` (whole keys, older short ones)."""
    there = present.select(F.explode(F.array(*forms)).alias(key))
    return watched.select(key).distinct().join(there, key, "left_anti")


def only_match(rows: DataFrame, table: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the rows of ``table`` with the same ``on``: null if none has one, or if they differ."""
    known = table.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    one = known.groupBy(*on).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return rows.join(one, list(on), "left").withColumn(value, F.when(F.col("_a") == F.col("_b"), F.col("_a"))).drop("_a", "_b")


def fill_from_latest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], *sources: tuple[DataFrame, str]) -> DataFrame:
    """``rows`` with the cells of ``columns`` that are all empty filled together: from the latest row of each key that has them all, in the first
    of ``sources`` (table, date column) that has one. Values that are known are never mixed with others."""
    lacks = F.lit(True)
    for c in columns:
        lacks = lacks & F.col(c).isNull()
    for k, (source, date) in enumerate(sources):
        whole = source.dropna(subset=[*columns]).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(date)).alias(f"_s{k}"))
        rows = rows.join(whole, list(keys), "left")
    found = F.coalesce(*[F.col(f"_s{k}") for k in range(len(sources))])
    filled = rows.withColumn("_f", F.when(lacks, found))
    return filled.withColumns({c: F.coalesce(c, f"_f.{c}") for c in columns}).drop("_f", *[f"_s{k}" for k in range(len(sources))])
