"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if (named := sc.getCheckpointDir()) is None:
        if (named := sc.getConf().get("spark.checkpoint.dir", "")) == "":
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a compressed table in the shared folder: ``cut`` for results with very many rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under its own names: other columns can't clash with anything."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``max_bytes`` of text each (a longer text is alone), which bounds a task's memory."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables that hold whole groups only, with the bounds of the groups."""
    kept: list[pa.RecordBatch] = []

    def ready(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new)
        end = table.num_rows if last else int(at[-1])
        return table.slice(0, end), np.append(at[at < end], end), table.slice(end)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        first = [kept[0].column(k)[0] for k in keys] if kept else None
        if first == [batch.column(k)[batch.num_rows - 1] for k in keys]:
            kept.append(batch)  # one group only so far
            continue
        table, bounds, rest = ready(pa.Table.from_batches([*kept, batch]), False)
        kept = rest.combine_chunks().to_batches()
        if table.num_rows:
            yield table, bounds
    if kept:
        table, bounds, _ = ready(pa.Table.from_batches(kept), True)
        yield table, bounds


class WordHashes(dict):
    """The hash of each word that was met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` word hashes (of all of them if there are fewer)."""
    n = max(min(1, len(h)), len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
