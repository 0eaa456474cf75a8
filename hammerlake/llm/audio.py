"""Audio fingerprints from pitch classes, and recordings aligned by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut

RATE, FRAME, HOP = 2048, 512, 128
#: Frames that a fingerprint looks at, and successive fingerprints that make a key of the index.
WIDTH, RUN = 12, 1
#: Keys that must agree on an offset, and the share of different bits that is still the same recording.
MIN_VOTES, MAX_BIT_ERROR = 3, 0.15
#: Samples that a query is also read without: of recordings that are shifted by part of a hop, one of these frames nearly alike.
PHASES = (0, 32, 64, 96)
NOTE_SAMPLES = 256
#: Queries, and recordings, that a task compares.
BLOCK, CHUNK = 1024, 4096


def filters() -> list[tuple[int, int, int, int, int]]:
    """16 filters (kind, first pitch class, classes, first frame, frames): each kind at widths that halve and thirds of the octave."""
    out = []
    for k in range(16):
        high = (2, 4, 6, 12)[k % 4]
        out.append((k % 5, (k * 5) % (13 - high), high, 0, (12, 8, 6, 4)[(k // 4) % 4]))
    return out


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Energy of the 12 pitch classes in each frame, of unit length; silence is all zero."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hz >= 100) & (hz <= 1000))
    to_class = np.zeros((len(used), 12))
    to_class[np.arange(len(used)), np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    energy = power[:, used] @ to_class
    size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.divide(energy, size, out=np.zeros_like(energy), where=size > 1e-6)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place where ``WIDTH`` frames begin: two bits from each filter on the integral image."""
    image = chroma(pcm)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(frame: int, frames: int, low: int, high: int) -> np.ndarray:
        a, b = at + frame, at + frame + frames
        return total[b, low + high] - total[a, low + high] - total[b, low] + total[a, low]

    out = np.zeros(n, np.uint32)
    for k, (kind, low, high, frame, frames) in enumerate(filters()):
        whole, half, mid = box(frame, frames, low, high), high // 2, frames // 2
        if kind == 0:
            part = whole * 0.5 * (high / 12)
            rest = box(frame, frames, 0, 12) * 0.5 * (high / 12) ** 2
        elif kind == 1:
            part = box(frame, frames, low, half)
            rest = whole - part
        elif kind == 2:
            part = box(frame, mid, low, high)
            rest = whole - part
        elif kind == 3:
            part = box(frame, mid, low, half) + box(frame + mid, frames - mid, low + half, high - half)
            rest = whole - part
        else:
            part = box(frame + frames // 3, max(1, frames // 3), low, high) * 2
            rest = whole - part / 2
        level = np.digitize(np.log((1 + part) / (1 + rest)), (-0.15, 0.0, 0.15)).astype(np.uint32)
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * k)  # Gray code: neighbouring levels differ in one bit
    return out


def sonify(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(rec_id, pcm)``: 16-bit samples of a melody in which each component of a vector is a note.

    There is no table of recordings; its query plays the vectors of ``embeddings``. Near vectors sound alike. Null
    components are rests, a null vector has null samples.
    """

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(NOTE_SAMPLES) / RATE
        notes = np.stack([np.zeros(NOTE_SAMPLES), *(np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) for p in range(24))])
        notes = (notes * np.hanning(NOTE_SAMPLES) * 20000).astype("<i2")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for v in part.column("v"):
                    x = np.array([np.nan if c is None else c for c in v.as_py()], float) if v.is_valid else None
                    if x is not None:
                        size = np.sqrt(np.nanmean(x**2)) if np.isfinite(x).any() else 1.0
                        pitch = np.where(np.isfinite(x), np.clip(np.floor(np.nan_to_num(x) / (size or 1.0) * 4) + 13, 1, 24), 0)
                    out.append(None if x is None else notes[pitch.astype(int)].tobytes())
                yield pa.record_batch([part.column("rec_id"), pa.array(out, pa.binary())], ["rec_id", "pcm"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(play, "rec_id long, pcm binary")


def fingerprints(recordings: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", phases: tuple[int, ...] = (0,)) -> DataFrame:
    """``(rec_id, phase, codes)`` for recordings of 16-bit little-endian samples at ``RATE``, without their first ``phase`` samples; too short or null ones have none."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in phases:
                codes = [fingerprint(np.frombuffer(x.as_py()[: len(x.as_py()) // 2 * 2], "<i2")[p:]).view(np.int32) if x.is_valid else None for x in batch.column("pcm")]
                yield pa.record_batch([batch.column("rec_id"), pa.array([p] * len(codes), pa.int32()), pa.array(codes, pa.list_(pa.int32()))], ["rec_id", "phase", "codes"])

    rows = recordings.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{pcm_col}`").alias("pcm"))
    return rows.mapInArrow(take, "rec_id long, phase int, codes array<int>")


def _keys(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place) of the runs of ``RUN`` integers; one that stays the same for several frames stands once, at its first: held notes don't vote again and again."""
    flat = np.concatenate(codes).astype(np.uint64)
    row, size = np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.array([len(c) for c in codes])
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    key = flat.copy()
    for k in range(1, RUN):
        key[:-k] = (key[:-k] * np.uint64(0x9E3779B97F4A7C15)) ^ flat[k:]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    kept = first & ((at + RUN <= size[row]) | (at == 0))
    return key[kept], row[kept], at[kept]


def _align(recordings: pa.Table, queries: pa.Table) -> pa.Table:
    """The best alignment of each query of a block with each recording of a chunk, of those that have votes enough."""
    layout = pa.schema([("q", pa.int64()), ("r", pa.int64()), ("offset", pa.int32()), ("votes", pa.int64()), ("bit_error", pa.float64())])
    if not recordings.num_rows or not queries.num_rows:
        return layout.empty_table()
    r_codes, q_codes = ([c.values.to_numpy().view(np.uint32) for c in t.column("codes")] for t in (recordings, queries))
    key, row, at = _keys(q_codes)
    order = np.argsort(key, kind="stable")
    key, row, at = key[order], row[order], at[order]
    least = np.minimum(np.bincount(row, minlength=len(q_codes)), MIN_VOTES)
    r_key, r_row, r_at = _keys(r_codes)
    low, high = np.searchsorted(key, r_key, "left"), np.searchsorted(key, r_key, "right")
    met = high > low
    low, n, r_row, r_at = low[met], (high - low)[met], r_row[met], r_at[met]
    hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    q_id, r_id, phase = queries.column("q").to_numpy(), recordings.column("r").to_numpy(), queries.column("phase").to_numpy()
    # the histogram of offsets of each pair: its bins that have votes, counted at once
    longest = max(map(len, q_codes))
    span = np.int64(longest + max(map(len, r_codes)))
    pair = row[hit].astype(np.int64) * len(r_codes) + np.repeat(r_row, n)
    bins, votes = np.unique(pair * span + (np.repeat(r_at, n) - at[hit] + longest), return_counts=True)
    a_of, b_of, offset = bins // span // len(r_codes), bins // span % len(r_codes), bins % span - longest
    enough = (votes >= least[a_of]) & (q_id[a_of] != r_id[b_of])
    found: dict[tuple[int, int], tuple] = {}
    for a, b, d, v in zip(*(x[enough].tolist() for x in (a_of, b_of, offset, votes))):
        x, y = q_codes[a], r_codes[b]
        lo, hi = max(0, -d), min(len(x), len(y) - d)
        if hi - lo >= min(len(x), len(y), WIDTH):
            e = float(np.bitwise_count(x[lo:hi] ^ y[lo + d : hi + d]).mean() / 32)
            pair_id = (int(q_id[a]), int(r_id[b]))
            found[pair_id] = min(found.get(pair_id, (2.0,)), (e, d * HOP - int(phase[a]), -v))
    rows = [(q, r, o, -v, e) for (q, r), (e, o, v) in found.items() if e <= MAX_BIT_ERROR]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, layout)], schema=layout)


def match_recordings(recordings: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", every: int = 100) -> DataFrame:
    """``(query_id, match_id, copies, offset, votes, bit_error)``: recordings that align with each query.

    Queries are the recordings whose id is divisible by ``every``, against all. Recordings with equal fingerprints
    are one class with its smallest id as match_id and the number of its recordings, the query not counted, as copies. Keys of
    ``RUN`` successive integers that two classes share vote for an offset, from each of the query's ``PHASES``; every
    offset with ``MIN_VOTES`` at least (or as many as the query has keys) is verified by the share of different bits where both
    overlap, ``MAX_BIT_ERROR`` at most over ``WIDTH`` integers or more; the best is reported, as the number of samples by
    which the query stands behind the match's beginning. A query's own class is not a match unless others are in it.

    The query set meets all classes in blocks: a task has ``BLOCK`` queries and ``CHUNK`` classes, and returns matches only.

    Null, empty and too short recordings have no fingerprint and match nothing, as rows with null ids. A repeated
    row is a copy. Empty tables give no rows.
    """
    known = recordings.where(F.col(f"`{id_col}`").isNotNull())
    prints = cut(fingerprints(known, id_col, pcm_col).where("size(codes) >= 1").select("rec_id", "codes", F.xxhash64("codes").alias("class")))
    classes = prints.groupBy("class").agg(F.min("rec_id").alias("match_id"), F.count(F.lit(1)).alias("copies"), F.any_value("codes").alias("codes"))
    queries = prints.where(F.col("rec_id") % every == 0).select(F.col("rec_id").alias("query_id"), "class").distinct()
    asking = queries.groupBy("class").agg(F.min("query_id").alias("rec_id"))  # one recording speaks for its class
    asked = fingerprints(known.where(F.col(f"`{id_col}`") % every == 0), id_col, pcm_col, PHASES).where("size(codes) >= 1").dropDuplicates(["rec_id", "phase"])
    asked = cut(asked.join(asking, "rec_id").select(F.col("class").alias("q"), "phase", "codes"))

    dealt = lambda rows, c, n, size: rows.withColumn(c, F.pmod(F.xxhash64(n), F.lit(size)).cast("int"))
    blocks, chunks = (max(1, -(-x.count() // k)) for x, k in ((asking, BLOCK), (prints.select("class").distinct(), CHUNK)))
    every_one = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q_side = dealt(asked, "block", "q", blocks).select("block", every_one("chunk", chunks), "q", "phase", "codes")
    r_side = dealt(classes.select(F.col("class").alias("r"), "codes"), "chunk", "r", chunks).select(every_one("block", blocks), "chunk", "r", "codes")
    aligned = r_side.groupBy("block", "chunk").cogroup(q_side.groupBy("block", "chunk")).applyInArrow(_align, "q long, r long, offset int, votes long, bit_error double")
    same = classes.where("copies > 1").join(asking, "class", "left_semi").select(F.col("class").alias("q"), F.col("class").alias("r"), F.lit(0).alias("offset"), F.size("codes").cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    found = aligned.unionByName(same).join(queries.withColumnRenamed("class", "q"), "q").join(classes.select(F.col("class").alias("r"), "match_id", "copies"), "r")
    return found.select("query_id", "match_id", (F.col("copies") - (F.col("q") == F.col("r")).cast("long")).alias("copies"), "offset", "votes", "bit_error")


def matches_by_query(recordings: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", every: int = 100) -> DataFrame:
    """``(query_id, n_classes, n_recordings, best_id, offset, bit_error)``: one row for each query, those without a match included.

    n_classes and n_recordings are its links of ``match_recordings``, as classes and as recordings; best_id is the
    smallest id of the class with the fewest different bits. Odd rows are as there; a query that has no fingerprint has no links.
    """
    asked = recordings.select(F.col(f"`{id_col}`").cast("long").alias("query_id")).where(F.col("query_id") % every == 0).distinct()
    found = match_recordings(recordings, id_col, pcm_col, every).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("copies").alias("n_recordings"), F.min(F.struct("bit_error", "match_id", "offset")).alias("best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return asked.join(found, "query_id", "left").select("query_id", zero("n_classes"), zero("n_recordings"), F.col("best.match_id").alias("best_id"), "best.offset", "best.bit_error")
