"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash picks trigger strings; the triggers cut each text into overlapping phrases, which begin and end
with what their own bytes decide, so equal text is cut alike wherever it stands. The dictionary of distinct
phrases is far smaller than a repetitive corpus, and the parse is each text as its phrases. Where a whole phrase repeats
in the parse, all strings in it do. Of the rest of the dictionary, suffix arrays put the strings that begin in each phrase
into order by their bytes, ``length`` bytes deep, which is as deep as order matters here; neighbours with a common
prefix of that length are equal strings. Equal strings have one trigger, so that an array for each trigger is corpus
order in parts. A phrase reaches ``length - 1`` bytes into the next ones: no string crosses into another phrase, and
the parse needs no order beyond its phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import whole_groups

LENGTH = 200
#: Bytes of a trigger string.
TRIGGER = 48
#: Distinct phrases of one trigger whose strings a task puts in order; the strings of more are dealt out one by one.
HOT_TRIGGER = 2048
#: Strings that a task orders at a time, if their triggers allow.
ORDERED = 50_000
#: Starts that are parsed at a time; their positions fit the low bits of a key.
SPAN = 1 << 18
BASE = 0x9E3779B97F4A7C15
_POSITION_BITS = 20
_powers: dict[str, np.ndarray] = {}


def _power_table() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(SPAN + LENGTH + 8, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _windows_min(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    padded = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(text: bytes, length: int = LENGTH, trigger: int = TRIGGER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of the trigger, its place, first start, number of starts) of the phrases of a text, a span at a time.

    The trigger of the ``length``-byte string at p is the first of the smallest hashes among the strings of
    ``trigger`` bytes within it. Neighbouring starts with one trigger are one phrase: the bytes from the first
    start to the end of the last one's string.
    """
    up, down = _power_table()
    width = length - trigger + 1
    for base in range(0, len(text) - length + 1, SPAN):
        part = np.frombuffer(text, np.uint8)[base : base + SPAN + length - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * down[: len(part)], out=sums[1:])
        h = (sums[trigger:] - sums[:-trigger]) * up[: len(part) - trigger + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        key = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
        least = _windows_min(key, width)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[first] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        yield h[place].view(np.int64), place + base, first + base, np.diff(np.append(first, len(least)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        rows = 0

        def ready() -> pa.RecordBatch:
            out = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], ["uid", "g", "c", "lo", "n"])

        for uid, value in zip(batch.column("uid").to_pylist(), batch.column("text")):
            text = value.as_buffer().to_pybytes() if value.is_valid else b""
            for g, _, lo, n in phrases(text):
                c = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist())), np.uint64, len(lo))
                for column, v in zip(columns, (np.full(len(g), uid), g, c.view(np.int64), lo, n)):
                    column.append(v)
                rows += len(g)
            if rows > 100_000:
                yield ready()
                columns, rows = [[], [], [], [], []], 0
        yield ready()


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases that occur more than once within a batch of phrases become one row with their number."""
    for batch in _parse(batches):
        c, g = batch.column("c").to_numpy(), batch.column("g").to_numpy()
        _, at, n = np.unique(np.stack([g, c], axis=1), axis=0, return_index=True, return_counts=True) if len(c) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = batch.take(pa.array(at))
        yield pa.record_batch([*out.columns, pa.array(n, pa.int64())], [*out.schema.names, "occurs"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of phrases that share their trigger with different ones."""
    schema = pa.schema([("g", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("lone", pa.bool_()), ("bytes", pa.binary())])
    for batch in batches:
        out: list[tuple] = []
        for uid, value, wanted in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
            text = value.as_buffer().to_pybytes()
            out += [(w["g"], uid, w["lo"], w["n"], w["lone"], text[w["lo"] : w["lo"] + w["n"] + LENGTH - 1]) for w in wanted if not w["hot"]]
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of the phrases of hot triggers, by a hash of 128 bits."""
    for batch in batches:
        for uid, value, wanted in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
            text, wanted = value.as_buffer().to_pybytes(), [w for w in wanted if w["hot"]]
            at = np.concatenate([np.arange(w["lo"], w["lo"] + w["n"]) for w in wanted])
            halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[p : p + LENGTH]) for p in at.tolist()]), "<i8").reshape(-1, 2)
            lone = np.repeat([w["lone"] for w in wanted], [w["n"] for w in wanted])
            yield pa.record_batch([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.full(len(at), uid)), pa.array(at), pa.array(lone)], ["h", "h2", "uid", "start", "lone"])


def suffix_order(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order by bytes of all strings of ``length`` that begin in the parts, and which of them equals the one before.

    Strings count through the parts: those of the first, then of the second, and so on.
    """
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts])
    n = sizes - length + 1
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[at]).view(f"S{length}").ravel()
    order = np.argsort(strings, kind="stable")
    strings = strings[order]
    return order, np.concatenate([[False], strings[1:] == strings[:-1]])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts, in phrases that occur once, of strings that another phrase of the same trigger has too."""
    for table, bounds in whole_groups(batches, ["g"]):
        uid, lo, n = (table.column(c).to_numpy() for c in ("uid", "lo", "n"))
        lone, parts = table.column("lone").to_numpy(), table.column("bytes")
        runs: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        ends, a = np.concatenate([[0], np.cumsum(n)]), 0
        while a < len(bounds) - 1:  # as many whole triggers as are ordered at a time
            b = max(a + 1, int(np.searchsorted(ends[bounds], ends[bounds[a]] + ORDERED, side="right")) - 1)
            first, last = int(bounds[a]), int(bounds[b])
            a = b
            order, equal = suffix_order(parts.slice(first, last - first).to_pylist())
            twice = np.zeros(len(order), bool)
            twice[order] = equal | np.append(equal[1:], False)
            own = n[first:last]
            row = np.repeat(np.arange(first, last), own)
            start = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            found = np.flatnonzero(twice & lone[row])
            if len(found):
                new = np.concatenate([[True], (np.diff(found) != 1) | (np.diff(row[found]) != 0)])
                stop = np.append(np.flatnonzero(new)[1:], len(found)) - 1
                runs.append(np.stack([uid[row[found[new]]], start[found[new]], start[found[stop]] + LENGTH], axis=1))
        all_runs = np.concatenate(runs)
        yield pa.record_batch([pa.array(all_runs[:, k]) for k in range(3)], ["uid", "start", "stop"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out, part = [], batch.slice(k, 256)
            for doc_id, value, spans in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("spans")):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                runs = merged([(s["start"], s["stop"]) for s in spans.as_py()]) if spans.is_valid else []
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(text), len(text) - len(kept), [{"start": a, "stop": b} for a, b in runs], kept))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _spans(rows: DataFrame) -> DataFrame:
    """``(uid, start, stop)`` of repeated strings, for ``rows`` of (uid, text)."""
    layout = "uid long, g long, c long, lo long, n long"
    # a phrase's two hashes, and each distinct one with its number and one of its places; the filters, true of all,
    # make both uses of the distinct phrases alike, so that they read one shuffle
    counted = rows.mapInArrow(_first_of_each, layout + ", occurs long").select("g", "c", "occurs", F.struct("uid", "lo", "n").alias("at")).where("g is not null and c is not null")
    distinct = counted.repartition("g").groupBy("g", "c").agg(F.sum("occurs").alias("occurs"), F.min("at").alias("at")).where("at is not null")
    repeated = distinct.where("occurs > 1").select("g", "c")
    whole = rows.mapInArrow(_parse, layout).select("g", "c", "uid", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + LENGTH).alias("stop"))
    whole = whole.join(repeated.hint("merge"), ["g", "c"]).select("uid", "start", "stop")
    several = distinct.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("kinds > 1")
    wanted = several.select(F.col("at.uid").alias("uid"), F.struct("g", "at.lo", "at.n", (F.col("occurs") == 1).alias("lone"), (F.col("kinds") > HOT_TRIGGER).alias("hot")).alias("w"))
    # both uses take the whole join, so that they read the same shuffles
    texts = rows.join(wanted.groupBy("uid").agg(F.collect_list("w").alias("wanted")).hint("merge"), "uid")
    opened = texts.where(F.exists("wanted", lambda w: ~w["hot"])).mapInArrow(_open, "g long, uid long, lo long, n long, lone boolean, bytes binary")
    parts = opened.repartition("g").sortWithinPartitions("g").mapInArrow(_compare, "uid long, start long, stop long")
    # a hot trigger's strings are counted like words, before and behind the shuffle: no trigger has to fit into a task
    hot = texts.where(F.exists("wanted", lambda w: w["hot"])).mapInArrow(_deal, "h long, h2 long, uid long, start long, lone boolean")
    twice = hot.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "h2")
    strings = hot.where("lone").join(twice.hint("merge"), ["h", "h2"]).select("uid", "start", (F.col("start") + LENGTH).alias("stop"))
    return whole.unionByName(parts).unionByName(strings)


def _with_spans(docs: DataFrame, text_col: str, *rest: Column) -> DataFrame:
    """``(uid, text, rest, spans)`` for each row of ``docs``; rest is a struct of the given columns, one at least.

    Texts are numbered and dealt out by their number once: parsing, opening and removal all read that shuffle, so that a
    number means the same row in each of them.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*rest).alias("rest")).repartition("uid")
    spans = _spans(rows).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans.hint("merge"), "uid", "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte that is covered by a string of ``LENGTH`` bytes that also starts somewhere else.

    Returns for each row ``doc_id, n_bytes, n_removed, spans, kept``: spans are the maximal removed runs
    (start, stop), kept the remaining bytes joined. Strings don't cross documents; overlapping occurrences and
    those in the same document count; all are judged on the input. Texts are UTF-8 bytes, so that kept may begin
    or end within a character.

    Null and empty texts and those shorter than ``LENGTH`` have nothing to remove. Repeated rows are occurrences
    of each other and are each returned. doc_id may be null or repeated. An empty table gives no rows.
    """
    found = _with_spans(docs, text_col, F.col(f"`{id_col}`").cast("long").alias("doc_id")).select(F.col("rest.doc_id").alias("doc_id"), "text", "spans")
    return found.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that ``remove_repeats`` leaves; bytes that are no whole character any more go too.

    n_chars follows the text where the table has it. Null texts stay null.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("_")]
    found = _with_spans(docs, "text", *others)

    @F.pandas_udf("string")
    def left(text, spans):
        out = []
        for t, s in zip(text, spans):
            if t is not None and s is not None:
                raw = t.encode()
                edges = [0, *(x for run in merged([(a["start"], a["stop"]) for a in s]) for x in run), len(raw)]
                t = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode(errors="ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    found = found.select("rest", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left("text", "spans")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[new.get(c, F.col(f"rest.`{c}`")) for c in docs.columns])


def digest(result: DataFrame) -> DataFrame:
    """What ``op10`` reports of ``remove_repeats``."""
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
