"""Snapshots and merges that never lose what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row of each key: the last by ``by``. A partial maximum, so no key is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*rows.columns)


def first(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row of each key: the first by ``by``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*rows.columns)


def merge_known(base: DataFrame, delta: DataFrame, keys: Sequence[str], static: Sequence[str] = (), dynamic: Sequence[str] = ()) -> DataFrame:
    """``base`` with the rows of ``delta``: static columns keep the old value if the new one is null, 0 or empty,
    dynamic ones only if it is null. Keys of one side only stay as they are."""
    n = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*static, *dynamic)])

    def new(c: str) -> Column:
        kind = delta.schema[c].dataType.typeName()
        if c in dynamic:
            return F.col(f"_{c}")
        return F.when(F.col(f"_{c}") != ("" if kind == "string" else F.lit(0)), F.col(f"_{c}"))

    return base.join(n, list(keys), "full_outer").select(*keys, *[F.coalesce(new(c), F.col(c), F.col(f"_{c}")).alias(c) for c in (*static, *dynamic)])


def fill_empty(base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``base`` with the empty cells of ``columns`` filled from the first row of ``other`` with the same key."""
    one = other.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_o"))
    filled = {c: F.coalesce(F.col(c), F.col(f"_o.{c}")).alias(c) for c in columns}
    return base.join(one, list(keys), "left").select(*[filled.get(c, F.col(c)) for c in base.columns])


def prune_orphans(rows: DataFrame, key: str, *keepers: DataFrame) -> DataFrame:
    """Rows whose key none of ``keepers`` has: what a prune deletes."""
    for k in keepers:
        rows = rows.join(k.select(key).distinct(), key, "left_anti")
    return rows


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """``(keys, change)``: new, removed, changed or unchanged in the ``watched`` columns."""
    a = old.select(*keys, F.struct(*watched).alias("_a"))
    b = new.select(*keys, F.struct(*watched).alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def swap_in(new: DataFrame, path: str) -> None:
    """Writes a table beside ``path`` and then puts it there by renaming: a job that fails midway leaves the old one, and
    ``new`` may read it. Between the two renames, ``path`` is briefly absent; the old table lies at ``path.old`` until the end."""
    spark = new.sparkSession
    new.write.mode("overwrite").parquet(f"{path}.new")
    of = spark._jvm.org.apache.hadoop.fs.Path
    here, fresh, old = of(path), of(f"{path}.new"), of(f"{path}.old")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} can't be renamed")
    if not fs.rename(fresh, here):
        fs.rename(old, here)
        raise OSError(f"{path}.new can't be renamed")
    fs.delete(old, True)


def replace_snapshot(new: DataFrame, path: str) -> bool:
    """Writes a snapshot in place of the old one; an empty one never replaces anything. Tells whether it was written."""
    if new.isEmpty():
        return False
    swap_in(new, path)
    return True


def replace_children(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` with the children of the keys that ``new`` has replaced by those of ``new``."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def children(rows: DataFrame, keys: Sequence[str], items: str) -> DataFrame:
    """Children of an array column, numbered from 0 in ``seq``; written again for a key, they replace the old ones."""
    return rows.select(*keys, F.posexplode(items).alias("seq", "_i")).select(*keys, "seq", "_i.*")
