"""Tables that are published together: each version is one small file that names their folders, and the highest counts.

A version is written beside the others and put in place by one rename, which fails if another writer was first. A job
that dies before it leaves the old version, and folders that nothing names; one that dies after it leaves the new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_LOG = "_versions"


class Conflict(RuntimeError):
    """Another writer published meanwhile."""


@dataclass(frozen=True)
class Version:
    """``tables`` has the folders of each table, relative to the root; ``properties`` is for the writer."""

    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, in order."""
    of, fs = _fs(spark, root)
    if not fs.exists(of(f"{root}/{_LOG}")):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(of(f"{root}/{_LOG}"))]
    return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))


def load(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, the newest if no number is given; number 0 without tables if there is none."""
    if number is None:
        number = max(numbers(spark, root), default=0)
    if number == 0:
        return Version()
    text = spark.read.option("wholetext", True).text(f"{root}/{_LOG}/{number:09d}.json").first().value
    return Version(number, **json.loads(text))


def table(spark: SparkSession, root: str, name: str, version: Version | None = None) -> DataFrame | None:
    """A table of a version, or None if it has none of that name."""
    folders = (version or load(spark, root)).tables.get(name)
    return spark.read.option("mergeSchema", True).parquet(*[f"{root}/{x}" for x in folders]) if folders else None


def stage(rows: DataFrame, root: str, name: str, partition: Iterable[str] = ()) -> str:
    """Writes rows to a folder of their own, which no version names yet."""
    folder = f"data/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition).parquet(f"{root}/{folder}")
    return folder


def publish(spark: SparkSession, root: str, base: Version, tables: dict[str, list[str]], properties: dict | None = None) -> Version:
    """Makes ``tables`` the version after ``base``; those that it doesn't name stay as they are in ``base``."""
    new = Version(base.number + 1, {**base.tables, **tables}, {**base.properties, **(properties or {})})
    of, fs = _fs(spark, root)
    draft, place = of(f"{root}/{_LOG}/.{uuid.uuid4().hex}"), of(f"{root}/{_LOG}/{new.number:09d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"tables": new.tables, "properties": new.properties}, ensure_ascii=False).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise Conflict(f"version {new.number} of {root} is there already")
    return new


def clean(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest ``keep`` versions and the folders that these don't name; gives the folders' names.

    Not to be run beside a writer, whose staged folders aren't named yet.
    """
    every, (of, fs) = numbers(spark, root), _fs(spark, root)
    named = {x.split("/")[1] for n in every[-keep:] for folders in load(spark, root, n).tables.values() for x in folders}
    for n in every[:-keep]:
        fs.delete(of(f"{root}/{_LOG}/{n:09d}.json"), False)
    there = [x.getPath().getName() for x in fs.listStatus(of(f"{root}/data"))] if fs.exists(of(f"{root}/data")) else []
    gone = sorted(set(there) - named)
    for x in gone:
        fs.delete(of(f"{root}/data/{x}"), True)
    return gone
