"""A table by key in buckets: a batch writes again only the buckets that hold its keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerlake.operators import merging
from hammerlake.sources import versions

#: What a batch makes of the rows that its buckets hold: (stored rows, batch) -> rows.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def latest_wins(keys: Sequence[str], by: Sequence[str]) -> Merge:
    """The newest row of each key; new columns are added."""
    return lambda old, new: merging.latest(old.unionByName(new, allowMissingColumns=True), keys, by)


def known_stays(keys: Sequence[str], static: Sequence[str] = (), dynamic: Sequence[str] = ()) -> Merge:
    """Known values stay where the batch has none; see ``merging.merge_known``."""
    return lambda old, new: merging.merge_known(old, new, keys, static, dynamic)


def counted_once(keys: Sequence[str], cancelled: str, rest: Sequence[str] = ()) -> Merge:
    """One row of each key with ``cancelled`` if any of the batch's is; the batch's row replaces the stored one.

    Several rows of a key are one trade that was reported, cancelled, and reported again.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        one = new.groupBy(*keys).agg(F.bool_or(cancelled).alias(cancelled), *[F.max(c).alias(c) for c in rest])
        return merging.replace_children(old.select(*one.columns), one, keys)

    return merge


def tags_joined(keys: Sequence[str], tags: str, by: str, mark: str = "/") -> Merge:
    """The newest row of each key, with all tags that its rows ever had, each once, in order."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new, allowMissingColumns=True)
        said = rows.select(*keys, F.explode(F.split(F.coalesce(tags, F.lit("")), mark)).alias("_t")).where("_t <> ''")
        every = said.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_t")), mark).alias("_t"))
        return merging.latest(rows, keys, [by]).join(every, list(keys), "left").withColumn(tags, F.coalesce("_t", F.lit(""))).select(*rows.columns)

    return merge


class Keyed:
    """A keyed table under ``root``. ``buckets`` is fixed when it is made: as many as make a bucket some hundred MB."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys = spark, root, list(keys)
        self.buckets = int(versions.load(spark, root).properties.get("buckets", buckets))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, version: versions.Version | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first batch."""
        version = version or versions.load(self.spark, self.root)
        names = [str(b) for b in only] if only is not None else list(version.tables)
        folders = [f"{self.root}/{x}" for b in names for x in version.tables.get(b, [])]
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def point(self, **key: object) -> DataFrame | None:
        """The rows of one key, from its bucket alone."""
        one = self.spark.range(1).select(*[F.lit(key[c]).alias(c) for c in self.keys]).select(self._bucket()).first()[0]
        rows = self.read(only=[one])
        return rows if rows is None else rows.where(_all(F.col(c).eqNullSafe(F.lit(v)) for c, v in key.items()))

    def _write(self, base: versions.Version, rows: DataFrame, touched: Sequence[int], properties: dict | None = None) -> versions.Version:
        folder = versions.stage(rows.withColumn("_bucket", self._bucket()).repartition("_bucket"), self.root, "buckets", ["_bucket"])
        of, fs = versions._fs(self.spark, self.root)
        there = {str(b): [f"{folder}/_bucket={b}"] for b in touched if fs.exists(of(f"{self.root}/{folder}/_bucket={b}"))}
        return versions.publish(self.spark, self.root, base, {str(b): there.get(str(b), []) for b in touched}, {"buckets": self.buckets, **(properties or {})})

    def merge(self, batch: DataFrame, how: Merge) -> list[int]:
        """Merges a batch, and gives the buckets that were written again. An empty one changes nothing."""
        base = versions.load(self.spark, self.root)
        touched = sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())  # buckets at most
        if touched:
            stored = self.read(base, touched)
            self._write(base, how(batch.where("false") if stored is None else stored, batch), touched)
        return touched

    def delete(self, gone: DataFrame) -> tuple[int, int]:
        """Deletes keys; gives how many were there and how many were asked for."""
        gone = gone.select(*self.keys).distinct()
        base, asked = versions.load(self.spark, self.root), gone.count()
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())
        stored = self.read(base, touched)
        if stored is None:
            return 0, asked
        hit = stored.join(gone, self.keys, "left_semi").select(*self.keys).distinct().count()
        if hit:
            self._write(base, stored.join(gone, self.keys, "left_anti"), touched)
        return hit, asked


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def replay(raw: DataFrame, parse: Callable[[DataFrame], DataFrame], parser: str, spark: SparkSession, root: str, name: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, change)`` of the rows that a parser now reads otherwise from the raw archive than what is served; then serves them.

    The table is rebuilt beside the old one and published with the parser's name. If nothing differs, the version stays as it
    is, whatever the parser is called; ``raw`` is only read.
    """
    base = versions.load(spark, root)
    old, folder = versions.table(spark, root, name, base), versions.stage(parse(raw), root, name)
    new = spark.read.parquet(f"{root}/{folder}")
    watched = [c for c in new.columns if c not in keys]
    if old is None:
        changes = new.select(*keys, F.lit("new").alias("change"))
    else:
        before = old.select(*keys, *[F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in watched])
        changes = merging.diff(before, new, keys, watched).where("change <> 'unchanged'")
    if not changes.isEmpty():
        versions.publish(spark, root, base, {name: [folder]}, {f"{name}.parser": parser})
    return changes
