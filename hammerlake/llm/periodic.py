"""Passages that repeat themselves: all runs of words, from Lyndon arrays over an ordered alphabet."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import pick, slices

MIN_WORDS, MIN_EXPONENT = 24, 3
#: Words that are compared one by one before they are compared as arrays.
_ONE_BY_ONE = 16


class WordNumbers(dict):
    """A number for each word that was met; a number is never given twice."""

    given = 0

    def __missing__(self, word: bytes) -> int:
        self.given += 1
        self[word] = self.given
        return self.given


def _agreeing(w: np.ndarray, at: int, far: int, step: int) -> int:
    """How many words from ``at`` on (in the direction of ``step``) equal those from ``far`` on."""
    n = (len(w) - max(at, far)) if step > 0 else min(at, far) + 1
    done, size = 0, 64
    while done < n:
        size = min(2 * size, n - done)
        a, b = at + step * done, far + step * done
        same = w[a : a + size] == w[b : b + size] if step > 0 else w[a - size + 1 : a + 1][::-1] == w[b - size + 1 : b + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done += size
    return n


def lyndon_runs(numbers: np.ndarray, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of at least that length and exponent (2 or more).

    For an order of the alphabet and its reverse, the next smaller suffix of each position is found from right to
    left along those already known; it ends the longest Lyndon word that begins there. Each run holds such a
    word as its period for one of the orders. Where two suffixes agree, the stretch over which words equal those at
    the same distance is read once, to both ends, and kept by distance: what lies in it is answered from there. That
    stretch is also the run. The end of the sequence is smaller than any word.
    """
    found: set[tuple[int, int, int]] = set()
    n = len(numbers)
    for ordered in (numbers, -numbers):
        w: list[int] = ordered.tolist()
        following = [n] * n
        matched: dict[int, tuple[int, int]] = {}  # distance: where the last stretch with equal words begins and ends
        for i in range(n - 2, -1, -1):
            j, a = i + 1, w[i]
            while j < n:
                b = w[j]
                if a < b:
                    j = following[j]
                elif a > b:
                    break
                else:
                    d = j - i
                    begin, end = matched.get(d, (n, n))
                    if not begin <= i < end:
                        end, begin, most = i + 1, i, i + 1 + _ONE_BY_ONE
                        while end + d < n and w[end] == w[end + d]:
                            end += 1
                            if end == most:
                                end += _agreeing(ordered, end, end + d, 1)
                                break
                        most = i - _ONE_BY_ONE
                        while begin and w[begin - 1] == w[begin - 1 + d]:
                            begin -= 1
                            if begin == most:
                                begin -= _agreeing(ordered, begin - 1, begin - 1 + d, -1) if begin else 0
                                break
                        matched[d] = (begin, end)
                    if end + d < n and w[end] < w[end + d]:
                        j = following[j]
                        continue
                    length = end + d - begin  # d is the length of the longest Lyndon word here
                    if length >= exponent * d and length >= min_words:
                        found.add((begin, length, d))
                    break
            following[i] = j
    return found


def suspects(numbers: np.ndarray, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Stretches (first, last + 1) that hold all runs of that length and exponent, with a word to either side of each.

    In a run of period q each word has an equal one within q places, so places whose nearest equal word is within Q
    make a stretch of at least ``exponent`` * q for all q in (Q/2, Q]. Stretches are looked for at each power of two.
    """
    n = len(numbers)
    if n < min_words:
        return []
    order = np.argsort(numbers, kind="stable")
    same = numbers[order[1:]] == numbers[order[:-1]]
    step = np.where(same, order[1:] - order[:-1], n)
    near = np.full(n, n)
    near[order[1:]] = step
    near[order[:-1]] = np.minimum(near[order[:-1]], step)
    cover = np.zeros(n + 1, np.int64)
    width, least = max(1, min_words // exponent), min_words
    while least <= n:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], near <= width, [False]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        long = last - first >= least
        np.add.at(cover, np.maximum(first[long] - 1, 0), 1)
        np.add.at(cover, np.minimum(last[long] + 1, n), -1)
        width, least = 2 * width, exponent * width + 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _runs(batches: Iterator[pa.RecordBatch], min_words: int, exponent: int) -> Iterator[pa.RecordBatch]:
    known = WordNumbers()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            if len(known) > 500_000:
                known.clear()
            words = [(t.as_py() or b"").split() for t in part.column("text").cast(pa.binary())]
            sizes = np.array([len(x) for x in words], np.int64)
            # one sequence for all texts; each has words of its own and ends with one that is nowhere else
            ends = np.cumsum(sizes + 1)
            text = np.repeat(np.arange(len(words)), sizes + 1)
            numbers = np.zeros(int(ends[-1]), np.int64)
            inside = np.ones(len(numbers), bool)
            inside[ends - 1] = False
            numbers[inside] = np.fromiter((known[w] for x in words for w in x), np.int64, int(sizes.sum()))
            _, numbers = np.unique(numbers + (text << 40), return_inverse=True)
            runs: dict[int, set[tuple[int, int, int]]] = {}
            for a, b in suspects(numbers, min_words, exponent):
                k = int(text[a])
                while a < b:  # a stretch's word to the side may belong to the next text
                    stop, zero = min(b, int(ends[k]) - 1), int(ends[k] - sizes[k] - 1)
                    runs.setdefault(k, set()).update((s + a - zero, n, q) for s, n, q in lyndon_runs(numbers[a:stop], min_words, exponent))
                    a, k = int(ends[k]), k + 1
            left = []
            for k, x in enumerate(words):
                if k in runs:
                    dropped = np.zeros(len(x) + 1, np.int64)
                    for s, n, q in runs[k]:
                        dropped[s + q] += 1
                        dropped[s + n] -= 1
                    x = [w for w, d in zip(x, np.cumsum(dropped).tolist()) if not d]
                left.append(b" ".join(x))
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(runs.get(k, ()), key=lambda r: (r[0], r[2]))] for k in range(len(words))]
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes), pa.array(listed, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row of ``docs``.

    Words are what stands between spaces and the characters 9 to 13. A run is a stretch of words with smallest period q
    (words q apart are the same) and at least ``min_words`` words and ``exponent`` periods, which no neighbouring word
    extends; ``runs`` has them by start, then period. ``collapsed`` are the words, joined by a space, without those
    that a run contains after its first q words.

    Null and empty texts have no words, no runs and an empty ``collapsed``. A null doc_id stays null, and repeated rows
    are returned as often as they come. An empty table gives no rows.
    """
    layout = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return pick(docs, id_col, text_col).mapInArrow(lambda x: _runs(x, min_words, exponent), layout)


def digest(found: DataFrame) -> DataFrame:
    """``find_runs`` as one row of numbers and hashes: the run with most periods (the first, then the shortest of such), and SHA-256 of all."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when((y > x) | (y == x) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])), b).otherwise(a)

    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.col("runs")[0], better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            out = []
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary())):
                h = 1 if i is None else zlib.crc32(str(i).encode())
                if h % 10 == 0 and (words := (t.as_py() or b"").split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    again = words[a : a + p]
                    out.append(b" ".join(words[:a] + (again * ((n - a) // p + 1))[: n - a]))
                else:
                    out.append(t.as_py())
            yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``, with the words of one text in ten repeated from a place on, as its id's CRC-32 says; a null id changes nothing.

    With h the CRC, g = floor(h / 10) and n words, texts with h % 10 = 0 repeat 1 + floor((n - a) / (3 + g % 8)) words
    from word a = g % n to the end.
    """
    return pick(docs, id_col, text_col).mapInArrow(_tails, "doc_id long, text string")
