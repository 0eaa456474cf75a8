"""Rows of older schemas, brought to the newest in one read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerlake.operators import merging


@dataclass(frozen=True)
class Step:
    """What makes a version of the one before it: columns with their types and defaults (SQL), others renamed or dropped, and
    the key if it is a new one, whose rows are told apart by ``by``."""

    version: int
    add: dict[str, tuple[str, str]] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    by: tuple[str, ...] = ()


def chain(steps: Sequence[Step]) -> list[Step]:
    """The steps in order; they must follow one another without a gap."""
    out = sorted(steps, key=lambda s: s.version)
    if [s.version for s in out] != list(range(out[0].version, out[0].version + len(out))):
        raise ValueError("versions must follow one another, each once")
    return out


def migrate(rows: DataFrame, version: int, steps: Sequence[Step]) -> DataFrame:
    """Rows of ``version`` at the last step's version.

    All but a new key is a projection, so Catalyst folds the chain into one. A column that is there already is left as it is (an
    interrupted migration may be run again). Under a new key, the last row by ``by`` stays of each that collide:
    ``collisions`` has the others.
    """
    for step in chain(steps):
        if step.version > version:
            rows = _shaped(rows, step)
            if step.key:
                rows = merging.latest(rows, step.key, step.by)
    return rows


def _shaped(rows: DataFrame, step: Step) -> DataFrame:
    rows = rows.withColumnsRenamed({a: b for a, b in step.rename.items() if b not in rows.columns}).drop(*step.drop)
    new = {c: F.expr(default).cast(kind) for c, (kind, default) in step.add.items() if c not in rows.columns}
    return rows.withColumns(new) if new else rows


def collisions(rows: DataFrame, version: int, steps: Sequence[Step]) -> DataFrame:
    """``(version, key, n)``: keys that several rows have under the new key of a step, with the key as JSON."""
    out = rows.sparkSession.createDataFrame([], "version int, key string, n long")
    for step in chain(steps):
        if step.version > version:
            rows = _shaped(rows, step)
            if step.key:
                met = rows.groupBy(*step.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                out = out.unionByName(met.select(F.lit(step.version).alias("version"), F.to_json(F.struct(*step.key)).alias("key"), "n"))
                rows = merging.latest(rows, step.key, step.by)
    return out
