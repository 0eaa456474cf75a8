"""The daily refresh: what a crawl found becomes the next version of all tables, or the old one stays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerlake.operators import merging
from hammerlake.sources import versions

#: A crawl that finds less than this share of what is served isn't taken for the whole.
COVERAGE_FLOOR = 0.8
TABLES = ("active", "sold", "rights")


def mode(found: int, served: int, partial: bool, floor: float = COVERAGE_FLOOR) -> str:
    """'replace' what is served, 'merge' into it, or 'keep' it.

    Nothing found is a failed crawl, not an empty market. A crawl that was cut short, or found too few, only adds.
    """
    if found == 0:
        return "keep"
    return "merge" if partial or found < served * floor else "replace"


def next_tables(served: dict[str, DataFrame], found: DataFrame, keys: Sequence[str], date: str, price: str, today: Column, how: str) -> dict[str, DataFrame]:
    """``active``, ``sold`` and ``rights`` after a crawl.

    Replacing, listings that are gone and whose date has passed are sold, at the price known for them, if any; those gone
    before it were withdrawn. Sold ones that are offered again are active only, and rights of what is neither are dropped.
    Merging, found listings are new or replace their own row, and everything else stays.
    """
    active, sold, rights = (served[t] for t in TABLES)
    keys = list(keys)
    if how == "keep":
        return dict(served)
    one = merging.latest(found, keys, [date])
    still = sold.join(one, keys, "left_anti")
    if how == "merge":
        return {"active": merging.replace_children(active, one.select(*active.columns), keys), "sold": still, "rights": rights}
    ended = active.join(one, keys, "left_anti").where(F.col(date) < today).select(*keys, F.col(date).alias("sold_date"), F.when(F.col(price) > 0, F.col(price)).alias("sold_price"))
    known = ended.join(still.select(*keys, F.col("sold_price").alias("_p")), keys, "left").select(*keys, "sold_date", F.coalesce("sold_price", "_p").alias("sold_price"))
    sold = merging.replace_children(still, known, keys)
    kept = rights.join(one.select(*keys).unionByName(sold.select(*keys)).distinct(), keys, "left_semi")
    return {"active": one.select(*active.columns), "sold": sold, "rights": kept}


@dataclass(frozen=True)
class Outcome:
    """What came of a refresh: how, the version that is served after it, and the gates that failed."""

    how: str
    version: int
    failed: tuple[str, ...] = ()


def refresh(spark: SparkSession, root: str, found: DataFrame, keys: Sequence[str], date: str, price: str, today: Column, partial: bool = False, gates: Callable[[dict[str, DataFrame]], DataFrame] | None = None, floor: float = COVERAGE_FLOOR) -> Outcome:
    """Write, audit, publish: all tables are staged, ``gates`` (name, passed) look at what was staged, and one rename serves them together.

    A failed gate, an empty crawl or a job that dies leaves the version that was served. ``active`` of the first version
    must be there (``versions.publish``).
    """
    base = versions.load(spark, root)
    served = {t: versions.table(spark, root, t, base) for t in TABLES}
    found = found.persist()
    try:
        how = mode(found.select(*keys).distinct().count(), served["active"].count(), partial, floor)
        if how == "keep":
            return Outcome(how, base.number)
        new = next_tables(served, found, keys, date, price, today, how)
        staged = {t: [versions.stage(new[t], root, t)] for t in TABLES}
    finally:
        found.unpersist()
    if gates is not None:
        tables = {t: spark.read.parquet(f"{root}/{staged[t][0]}") for t in TABLES}
        failed = tuple(sorted(r.name for r in gates(tables).where("not coalesce(passed, false)").collect()))
        if failed:
            return Outcome("keep", base.number, failed)
    return Outcome(how, versions.publish(spark, root, base, staged, {"how": how}).number)
