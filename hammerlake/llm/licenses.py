"""License texts in documents: winnowed fingerprints pick candidates, a banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import WordHashes, gram_hashes, pick, slices
from .license_texts import TEMPLATES

#: Words in a fingerprint, and fingerprints of which one is kept; a shared run of GRAM + WINDOW - 1 words is found.
GRAM, WINDOW = 3, 3
#: Words by which an alignment may drift from its diagonal, and the covered share of a template that is reported.
BAND, MIN_COVERAGE = 8, 0.8
WORD = re.compile(rb"[a-z0-9]+")

def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits, A-Z lower-cased."""
    return WORD.findall(text.lower())


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints that winnowing keeps: the last smallest of each window."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def align(template: list[bytes], words: list[bytes], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """The most template words that match in order within a band around a diagonal, and the span of words they cover.

    ``diagonal`` is where the template would begin. Template words may be skipped or extra words stand between;
    of equally good alignments the shortest span is taken.
    """
    lo = max(0, diagonal - band)
    hi = min(len(words), diagonal + len(template) + band)
    # best[j]: (matches, negative span, start) of alignments that end before word lo + j
    empty = (0, 0, -1)
    best: list[tuple[int, int, int]] = [empty] * (hi - lo + 1)
    ends: dict[tuple[int, int], int] = {}
    top, top_end = empty, lo
    for i, wanted in enumerate(template):
        new = best[:]
        for j in range(max(lo, diagonal + i - band), min(hi, diagonal + i + band + 1)):
            if words[j] == wanted:
                n, _, start = best[j - lo]
                start = j if start < 0 else start
                found = (n + 1, start - j - 1, start)
                if found > new[j - lo + 1]:
                    new[j - lo + 1] = found
                if found[:2] > top[:2]:
                    top, top_end = found, j + 1
        for j in range(1, len(new)):
            if new[j - 1][0] > new[j][0]:
                new[j] = new[j - 1]
        best = new
    return top[0], max(top[2], 0), top_end


class Scanner:
    """An inverted index from winnowed fingerprints to templates."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {k: words_of(t.encode()) for k, t in templates.items()}
        self.index: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.hashes = WordHashes()
        for k, w in self.words.items():
            hashes = gram_hashes(self.hashes.of(w), GRAM)
            # all fingerprints of a template that is too short for winnowing to find it whole
            for at in range(len(hashes)) if len(w) < 2 * (GRAM + WINDOW) else winnow(hashes).tolist():
                self.index[int(hashes[at])].append((k, at))
        # a small table answers for nearly all fingerprints of a document
        self.known = np.array(sorted(self.index), np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known & np.uint64(0xFFFF)] = True

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, covered share, start, end in characters), in order of start; the longest of those that overlap."""
        words = words_of(text)
        hashes = gram_hashes(self.hashes.of(words), GRAM)
        hits = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        hits = hits[np.isin(hashes[hits], self.known)]
        wanted: dict[str, set[int]] = defaultdict(set)
        for at in hits.tolist():
            for k, place in self.index[int(hashes[at])]:
                wanted[k].add(at - place)
        if not wanted:
            return []
        spans, found = [m.span() for m in WORD.finditer(text.lower())], []
        for k, diagonals in wanted.items():
            last = None
            for d in sorted(diagonals):
                if last is not None and d - last <= BAND // 2:
                    continue  # the same place: the band, wider by that much, holds this diagonal and its drift too
                last = d
                n, a, b = align(self.words[k], words, d, BAND + BAND // 2)
                if n >= MIN_COVERAGE * len(self.words[k]):
                    found.append((n, k, n / len(self.words[k]), spans[a][0], spans[b - 1][1]))
        out: list[tuple[str, float, int, int]] = []
        for _, k, share, a, b in sorted(found, key=lambda x: (-x[0], -x[2], x[3], x[1])):
            if all(b <= x[2] or a >= x[3] for x in out):
                out.append((k, share, a, b))
        return [(k, share, len(text[:a].decode()), len(text[:b].decode())) for k, share, a, b in sorted(out, key=lambda x: x[2])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, coverage, start, end`` for each place in a whole text where a template is covered.

    coverage is the share of the template's words that an alignment within ``BAND`` words of a diagonal matches in
    order, ``MIN_COVERAGE`` at least; start and end are in characters. Of places that overlap, the one with most
    matched words is reported (then the better covered template, the first, and by name): a license with one clause more
    is told from the one without it. The index holds the templates alone and is as large
    as they are; documents meet it in their own task.

    Null and empty texts have no rows; repeated rows are each scanned; a null doc_id stays null. No templates or
    an empty table give no rows.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(i, *x) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text")) for x in scanner.scan((t.as_py() or "").encode())]
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "license", "coverage", "start", "end"])

    return pick(docs, id_col, text_col).mapInArrow(scan, "doc_id long, license string, coverage double, start long, end long")
