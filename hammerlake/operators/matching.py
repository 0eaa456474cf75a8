"""Joins that choose: by tiers, by fingerprints, by nearness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_tier(pairs: DataFrame, keys: Sequence[str], tiers: Sequence[Column]) -> DataFrame:
    """Pairs of the first tier that each key has any of, with ``tier`` from 1; pairs of no tier go."""
    tier = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tiers, 1)])
    tagged = pairs.withColumn("tier", tier).where("tier is not null")
    best = tagged.groupBy(*keys).agg(F.min("tier").alias("_best"))
    return tagged.join(best, list(keys)).where(F.col("tier") == F.col("_best")).drop("_best")


def tier_of_nearness(rows: DataFrame, outer: str, inner: str, size: str, bands: Sequence[float]) -> DataFrame:
    """``(outer, inner, size, many, tier, n)`` for each combination: how many other rows are in its first tier that has any.

    The tiers are rows of the same ``outer`` and ``inner`` whose size is within each of ``bands`` (ascending, as a share
    of the own size), and then all of the same ``outer``. Rows that are alike are counted first; inner tiers meet by
    equality of both keys, and the last one is a count.
    """
    kinds = rows.groupBy(outer, inner, size).agg(F.count(F.lit(1)).alias("many"))
    others = kinds.select(outer, inner, F.col(size).alias("_size"), F.col("many").alias("_many"))
    gap = F.abs(F.col("_size") - F.col(size))
    near = kinds.join(others, [outer, inner]).groupBy(outer, inner, size, "many").agg(*[(F.sum(F.when(gap <= F.col(size) * b, F.col("_many")).otherwise(0)) - 1).alias(f"_n{k}") for k, b in enumerate(bands)])
    of_outer = kinds.groupBy(outer).agg((F.sum("many") - 1).alias(f"_n{len(bands)}"))
    found = near.join(of_outer, outer)
    first = F.coalesce(*[F.when(F.col(f"_n{k}") > 0, F.struct(F.lit(k + 1).alias("tier"), F.col(f"_n{k}").alias("n"))) for k in range(len(bands) + 1)])
    return found.select(outer, inner, size, "many", first.alias("f")).where("f is not null").select(outer, inner, size, "many", "f.tier", "f.n")


def by_size(left: DataFrame, right: DataFrame, on: Sequence[str], left_size: str, right_size: str, band: float) -> DataFrame:
    """Pairs that agree in ``on`` and whose right size is within ``band`` of the left one.

    Sizes are dealt into steps of that ratio, so a row meets those of three steps only and not all of its group.
    """
    step = lambda c: F.floor(F.log(F.col(c)) / F.log(F.lit(1 + band))).cast("long")
    a = left.where(F.col(left_size) > 0).withColumn("_step", F.explode(F.array(*[step(left_size) + k for k in (-2, -1, 0, 1)])))
    b = right.where(F.col(right_size) > 0).withColumn("_step", step(right_size))
    return a.join(b, [*on, "_step"]).where(F.abs(F.col(right_size) - F.col(left_size)) / F.col(left_size) <= band).drop("_step")


def contained(left: DataFrame, right: DataFrame, on: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """``(on, left_name, right_name)``: distinct names of which one is part of the other, where ``on`` agrees.

    Of each name only the parts as long as some name of the other side are made, and these meet by equality: no two names are compared
    that don't agree. There are no more lengths than the longest name has characters.
    """
    a, b = left.select(*on, left_name).distinct(), right.select(*on, right_name).distinct()
    sizes = lambda rows, name: F.broadcast(rows.agg(F.collect_set(F.length(name)).alias("_sizes")))

    def parts(rows: DataFrame, name: str, part: str, others: DataFrame, fits: Callable[[Column], Column]) -> DataFrame:
        of = lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(F.col(name), i, n))
        lengths = F.filter("_sizes", fits)
        made = rows.crossJoin(sizes(others, part)).where(F.size(lengths) > 0)
        return made.select(*on, name, F.explode(F.array_distinct(F.flatten(F.transform(lengths, of)))).alias(part))

    right_has = parts(b, right_name, left_name, a, lambda n: (n > 0) & (n <= F.length(right_name))).join(a, [*on, left_name])
    left_has = parts(a, left_name, right_name, b, lambda n: (n > 0) & (n < F.length(left_name))).join(b, [*on, right_name])
    out = [*on, left_name, right_name]
    return right_has.select(*out).unionByName(left_has.select(*out))


def fingerprint_link(left: DataFrame, right: DataFrame, left_key: str, right_key: str, marks: Sequence[str], least: int = 3, coverage: float = 0.6, margin: float = 2.0) -> DataFrame:
    """``(left_key, right_key, shared, of)``: groups that are one because they share rare facts.

    A left group is linked to the right one with most shared distinct ``marks`` if these are ``least`` or more,
    ``coverage`` of its own, and ``margin`` times those of the runner-up: two equal candidates give no link.
    """
    a, b = left.select(left_key, *marks).distinct(), right.select(right_key, *marks).distinct()
    sizes = a.groupBy(left_key).agg(F.count(F.lit(1)).alias("of"))
    shared = a.join(b, list(marks)).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy(left_key).orderBy(F.desc("shared"), right_key)
    two = shared.withColumn("_i", F.row_number().over(order)).where("_i <= 2")
    top = two.groupBy(left_key).agg(F.max(F.when(F.col("_i") == 1, F.struct("shared", right_key))).alias("t"), F.max(F.when(F.col("_i") == 2, F.col("shared"))).alias("second"))
    top = top.join(sizes, left_key).select(left_key, f"t.{right_key}", "t.shared", "of", F.coalesce("second", F.lit(0)).alias("second"))
    return top.where((F.col("shared") >= least) & (F.col("shared") >= coverage * F.col("of")) & (F.col("shared") >= margin * F.col("second"))).drop("second")


def top_up(links: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, month: str, price: str, floor: str, open_months: int = 2, most: int = 20) -> DataFrame:
    """``(left_key, month, price, floor)``: what linked right groups have and left ones haven't got yet, the newest ``most`` of each.

    A multiset difference: equal trades are numbered, so that of three of which one is known two are new. Only months count that the left
    group has reached and that are among the last ``open_months`` of the right side, as trades may be cancelled later and closed months aren't read again. A floor
    of 0 is an unknown one: it agrees with any of the same month and price, on either side.
    """
    marks = [month, price, floor]
    mine = links.select(left_key, right_key).join(right.select(right_key, *marks), right_key)
    own = left.select(left_key, *marks)
    reached = own.groupBy(left_key).agg(F.max(month).alias("_own"))
    newest = right.agg((F.max(month) - (open_months - 1)).alias("_open"))
    mine = mine.join(reached, left_key).crossJoin(F.broadcast(newest)).where(F.col(month) >= F.greatest("_own", "_open"))
    numbered = lambda rows: rows.withColumn("_nth", F.row_number().over(Window.partitionBy(left_key, *marks).orderBy(F.lit(0))))
    new = numbered(mine.select(left_key, *marks)).join(numbered(own), [left_key, *marks, "_nth"], "left_anti")
    pairs = own.groupBy(left_key, month, price).agg(F.bool_or(F.col(floor) == 0).alias("_unknown"))
    new = new.join(pairs, [left_key, month, price], "left").where(F.col("_unknown").isNull() | (~F.col("_unknown") & (F.col(floor) != 0)))
    order = Window.partitionBy(left_key).orderBy(F.desc(month), F.desc(price), F.desc(floor))
    return new.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= most).select(left_key, *marks)


def nearest(rows: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """``(key, near_key, distance)``: the row of the same group with the nearest size; of equals, the smallest key.

    The nearest in size stands among the neighbours in the order of distinct sizes, so one sort replaces a join of
    each row with its whole group.
    """
    sizes = rows.groupBy(group, size).agg(F.min(key).alias("_one"), F.min(F.struct(F.lit(0), key)).alias("_"), F.count(F.lit(1)).alias("_n")).drop("_")
    second = rows.join(sizes.select(group, size, "_one").where("_n > 1"), [group, size]).where(F.col(key) != F.col("_one")).groupBy(group, size).agg(F.min(key).alias("_two"))
    w = Window.partitionBy(group).orderBy(size)
    around = lambda f: F.struct(*[f(c, 1).over(w).alias(n) for c, n in ((size, "s"), ("_one", "k"))])
    near = sizes.join(second, [group, size], "left").select(group, size, "_one", "_two", around(F.lag).alias("_below"), around(F.lead).alias("_above"))
    out = rows.select(group, size, key).join(near, [group, size])
    same = F.when(F.col(key) == F.col("_one"), F.col("_two")).otherwise(F.col("_one"))
    cands = F.array(F.struct(F.when(same.isNotNull(), F.lit(0)).alias("d"), same.alias("k")), F.struct((F.col(size) - F.col("_below.s")).alias("d"), F.col("_below.k").alias("k")), F.struct((F.col("_above.s") - F.col(size)).alias("d"), F.col("_above.k").alias("k")))
    best = F.array_min(F.filter(cands, lambda c: c["d"].isNotNull()))
    return out.select(key, best["k"].alias("near_key"), best["d"].cast("int").alias("distance")).where("near_key is not null")
