"""Near-duplicate paragraphs by MinHash banding, verified by exact Jaccard similarity; and passages that repeat inside them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import WordHashes, cut, gram_hashes, pick, slices, whole_groups, written
from .components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Lines with fewer words are taken together with their neighbours, and each by itself as well.
MIN_WORDS = 20
ROWS_PER_BAND, RECALL = 3, 0.999
#: Words of a passage, and words around a place within which it must have the smallest hash for a passage to begin there.
PASSAGE_WORDS, REACH = 32, 5
#: Paragraphs of one band value that a task compares; more are divided in blocks.
HOT_BAND = 1024
#: Classes that are sent to every executor at most (8 bytes each, and a document's id for some of them); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
_PRIME = (1 << 31) - 1
#: Shingles whose minima are taken at a time.
_STEP = 4096


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS_PER_BAND, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` minima that bring a pair of that similarity together with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def units(sizes: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(line, first word, words) of the paragraphs of a text whose lines have so many words.

    A line of ``min_words`` or more is a paragraph, and so is a run of shorter lines that have as many together. What
    is shorter belongs to the paragraph before it, or behind it where it begins the text: both make one more paragraph,
    which takes the other's place where their shingles are similar anyhow. A text that has fewer words is one paragraph.
    """
    blocks: list[list[int]] = []  # line, first word, words, and whether it's one long line
    at = 0
    for k, n in enumerate(sizes):
        if n and blocks and n < min_words and not blocks[-1][3]:
            blocks[-1][2] += n
        elif n:
            blocks.append([k, at, n, n >= min_words])
        at += n
    if len(blocks) == 1:
        return [tuple(blocks[0][:3])]
    whole, more = {i: tuple(x[:3]) for i, x in enumerate(blocks) if x[2] >= min_words}, []
    for i, (_, _, n, _) in enumerate(blocks):
        if n < min_words:
            line, first, m = whole[beside := i - 1 if i else 1]
            both = (min(line, blocks[i][0]), min(first, blocks[i][1]), m + n)
            if m - SHINGLE_WORDS + 1 >= SIMILARITY * (m + n - SHINGLE_WORDS + 1):
                whole[beside] = both
            else:
                more.append(both)
    return sorted([*whole.values(), *more])


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes (31 bits) of a paragraph's runs of five words, from its words' hashes; of all words if there are fewer. Some may be equal."""
    return (gram_hashes(h, SHINGLE_WORDS) % np.uint64(_PRIME)).astype(np.int64)


def anchors(h: np.ndarray) -> np.ndarray:
    """Where passages begin: three words whose hash is the first of the smallest within ``REACH`` words to either side."""
    g = gram_hashes(h, 3) if len(h) >= PASSAGE_WORDS else np.zeros(0, np.uint64)
    if not len(g):
        return np.zeros(0, np.int64)
    first = np.ones(len(g), bool)
    for k in range(1, min(REACH, len(g) - 1) + 1):
        first[k:] &= g[k:] < g[:-k]
        first[:-k] &= g[:-k] <= g[k:]
    at = np.flatnonzero(first)
    return at[at + PASSAGE_WORDS <= len(h)]


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, _PRIME, count), rng.integers(0, _PRIME, count)


def _hashed(batch: pa.RecordBatch, known: WordHashes) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(row, words of each line, hashes of all words) of the texts of a batch."""
    for row, text in enumerate(batch.column("text").cast(pa.binary())):
        lines = [*map(bytes.split, (text.as_py() or b"").lower().split(b"\n"))]
        yield row, [*map(len, lines)], known.of([*chain.from_iterable(lines)])


def _named(own: np.ndarray, line: bool) -> int:
    """The class of a paragraph, or of a line by itself: these are never compared with each other."""
    return xxhash.xxh3_64_intdigest(own, int(line)) >> 1


def _units(sizes: list[int], min_words: int, lines: bool) -> list[tuple[int, int, int, bool]]:
    """(line, first word, words, whether it's a line by itself) of what is compared: paragraphs, and with ``lines`` short lines too."""
    out = [(*u, False) for u in units(sizes, min_words)]
    if lines:
        starts = np.cumsum([0, *sizes]).tolist()
        out += [(k, starts[k], n, True) for k, n in enumerate(sizes) if 0 < n < min_words]
    return out


_LAYOUT = "h long, h2 long, doc_id long, para int, first int, words int, kind byte"
#: Kinds of rows: places of paragraphs, of lines by themselves and of passages, and band values.
PARAGRAPH, LINE, PASSAGE, BAND = range(4)


def _parse(batches: Iterator[pa.RecordBatch], min_words: int, lines: bool) -> Iterator[pa.RecordBatch]:
    """Where paragraphs and lines stand, with their class as h; where passages do, with both halves of their hash; and the band values (h) of
    each class (h2) with whole shingles, once for each part of a batch."""
    known, of, bands = WordHashes(), xxhash.xxh3_128_digest, bands_for()
    a, b = _permutations(bands * ROWS_PER_BAND)
    names = [x.split()[0] for x in _LAYOUT.split(", ")]
    for batch in batches:
        for part in slices(batch, "text"):
            units_of: list[tuple[int, int, int, int, int, bool]] = []
            sets: dict[int, np.ndarray] = {}
            alone: list[bool] = []
            p_row, digests, p_para, p_first = [], [], [], []
            for r, sizes, h in _hashed(part, known):
                for line, at, n, single in _units(sizes, min_words, lines):
                    own = h[at : at + n]
                    same = _named(own, single)
                    units_of.append((same, r, line, at, n, single))
                    if n >= SHINGLE_WORDS and same not in sets:
                        sets[same] = shingles(own)
                        alone.append(single)
                if len(at := anchors(h)):
                    raw = h.view(np.uint8)
                    digests += [of(raw[8 * k : 8 * (k + PASSAGE_WORDS)]) for k in at.tolist()]
                    p_row.append(np.full(len(at), r))
                    p_para.append(np.searchsorted(np.cumsum(sizes), at, side="right"))
                    p_first.append(at)
            same, row, para, first, words, single = (np.array(x, np.int64) for x in zip(*units_of)) if units_of else (np.zeros(0, np.int64),) * 6
            ids = part.column("doc_id")
            none = pa.nulls(len(same), pa.int64())
            yield pa.record_batch([pa.array(same), none, ids.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (para, first, words)), pa.array(single.astype(np.int8))], names)
            if digests:
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                row, para, first = (np.concatenate(x).astype(np.int64) for x in (p_row, p_para, p_first))
                yield pa.record_batch([pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (para, first, np.full(len(row), PASSAGE_WORDS))), pa.array(np.full(len(row), PASSAGE, np.int8))], names)
            if sets:
                least = _minima([*sets.values()], a, b).reshape(len(sets), bands, ROWS_PER_BAND).astype(np.uint64)
                keys = np.arange(1, bands + 1, dtype=np.uint64) + (np.array(alone, np.uint64) * np.uint64(bands))[:, None]
                for k in range(ROWS_PER_BAND):
                    keys = (keys ^ least[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(32)
                flat = (keys >> np.uint64(1)).astype(np.int64).ravel()
                nothing = [pa.nulls(len(flat), pa.int64()), *[pa.nulls(len(flat), pa.int32())] * 3]
                yield pa.record_batch([pa.array(flat), pa.array(np.repeat(np.array([*sets], np.int64), bands)), *nothing, pa.array(np.full(len(flat), BAND, np.int8))], names)


def _minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation (columns) over each set (rows)."""
    sizes = np.array([len(x) for x in sets])
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    least = np.full((len(a), len(sets)), np.iinfo(np.int64).max)
    for at in range(0, len(flat), _STEP):
        x = flat[at : at + _STEP] * a[:, None] + b[:, None]
        for _ in range(2):  # modulo the Mersenne prime, by its bits
            x = (x & _PRIME) + (x >> 31)
        first, last = np.searchsorted(ends, [at, at + x.shape[1] - 1], side="right")
        starts = np.maximum(ends[first : last + 1] - sizes[first : last + 1] - at, 0)
        least[:, first : last + 1] = np.minimum(least[:, first : last + 1], np.minimum.reduceat(x, starts, axis=1))
    return least.T


def _shingled(batches: Iterator[pa.RecordBatch], min_words: int, lines: bool) -> Iterator[pa.RecordBatch]:
    """(class, distinct shingles in order) of the classes that ``wanted`` names for each text; a lone shingle has 31 more bits of its hash
    beside it, as its 31 are too few among millions."""
    known = WordHashes()
    for batch in batches:
        for part in slices(batch, "text"):
            sets: dict[int, np.ndarray] = {}
            wanted = [*map(set, part.column("wanted").to_pylist())]
            for row, sizes, h in _hashed(part, known):
                for _, first, n, line in _units(sizes, min_words, lines):
                    if n < SHINGLE_WORDS:
                        continue
                    own = h[first : first + n]
                    same = _named(own, line)
                    if same in wanted[row] and same not in sets:
                        s = shingles(own)
                        lone = len(s) == 1 or s[0] == s[1] and bool((s == s[0]).all())
                        sets[same] = np.unique(np.append(s[:1], int(gram_hashes(own[:SHINGLE_WORDS], SHINGLE_WORDS)[0]) >> 33) if lone else s)
            ends = np.cumsum([0, *map(len, sets.values())])
            flat = np.concatenate([*sets.values()]).astype(np.int32) if sets else np.zeros(0, np.int32)
            yield pa.record_batch([pa.array([*sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["same", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the paragraphs of one band value that are similar enough, at most one a paragraph."""
    for table, bounds in whole_groups(batches, ["key", "part"]):
        same, lists = table.column("same").to_numpy(), table.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        out: list[tuple[int, int]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            sizes = ends[a + 1 : b + 1] - ends[a:b]
            if b - a == 2 and min(sizes) < SIMILARITY * max(sizes):
                continue  # two sets of such sizes can't be similar
            sets = [flat[ends[k] : ends[k + 1]] for k in range(a, b)]
            joined, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
            rest = np.arange(b - a)
            while len(rest):
                reached, rest = [int(rest[0])], rest[1:]
                while reached and len(rest):
                    u = reached.pop()
                    s = sets[u]
                    if len(rest) == 1:
                        other = sets[rest[0]]
                        both = np.array([np.count_nonzero(s[np.minimum(np.searchsorted(s, other), len(s) - 1)] == other)])
                    else:
                        both = np.add.reduceat(s[np.minimum(np.searchsorted(s, joined), len(s) - 1)] == joined, starts, dtype=np.int64)[rest]
                    ok = both >= SIMILARITY * (sizes[rest] + sizes[u] - both)
                    out += [(same[a + u], same[a + v]) for v in rest[ok].tolist()]
                    reached += rest[ok].tolist()
                    rest = rest[~ok]
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["src", "dst"])


_ROW = ["doc_id", "para", "first", "words"]


def near_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, para, first, words, cluster_doc, cluster_para, cluster_first, removed)`` for each paragraph that has a near-duplicate.

    ``units`` says what a paragraph is: every word is in one. para is the number of its (first) line among all lines,
    first that of its first word among all words of the text, both from 0. Two are linked if the Jaccard similarity
    of their five-word shingles (A-Z lower-cased; of all words if there are fewer) is ``SIMILARITY`` or more; clusters
    are connected components, named by their first paragraph (smallest doc_id, then place), and every other one is
    to be removed. Equal paragraphs are one class before anything is compared. Bands are tuned to find a pair at
    the limit with probability ``RECALL``, and each found pair is verified on whole sets. With ``min_words`` of 1 each
    line that has words is a paragraph.

    Null and empty texts have no paragraphs; rows whose doc_id is null are left alone; a repeated row repeats its
    paragraphs, which stay once. An empty table gives no rows.
    """
    texts, parsed = _parsed(docs, id_col, text_col, min_words)
    return _near(texts, parsed, min_words).drop("line")


def _parsed(docs: DataFrame, id_col: str, text_col: str, min_words: int, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts, and the places and bands of their paragraphs and passages, parsed once and written; with ``lines`` those of short lines too."""
    texts = pick(docs, id_col, text_col).where("doc_id is not null")
    return texts, written(texts.mapInArrow(lambda x: _parse(x, min_words, lines), _LAYOUT))


def _near(texts: DataFrame, parsed: DataFrame, min_words: int, lines: bool = False) -> DataFrame:
    places = parsed.where(F.col("kind").isin(PARAGRAPH, LINE)).select(F.col("h").alias("same"), *_ROW, (F.col("kind") == LINE).alias("line"))
    classes = cut(places.groupBy("same").agg(F.min(F.struct(*_ROW)).alias("first"), F.count(F.lit(1)).alias("n")))
    dealt = parsed.where(F.col("kind") == BAND).select(F.col("h").alias("key"), F.col("h2").alias("same")).repartition("key").distinct()
    # bands in which the same classes meet are one: a group is named by its members, and compared once
    by_key = Window.partitionBy("key")
    grouped = dealt.withColumn("many", F.count(F.lit(1)).over(by_key)).where("many > 1").withColumn("group", F.bit_xor(F.xxhash64("same")).over(by_key))
    pairs = cut(grouped.select(F.xxhash64("group", "many").alias("key"), "same", "many").distinct())
    # only documents that are the first with a class that is met are read again, and only for those classes
    met = cut(pairs.select("same").distinct())
    holders = cut(met.join(classes, "same").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("same").alias("wanted")))
    again = texts.join(F.broadcast(holders) if met.count() <= BROADCAST_ROWS else holders, "doc_id")
    sets = again.mapInArrow(lambda x: _shingled(x, min_words, lines), "same long, shingles array<int>").groupBy("same").agg(F.any_value("shingles").alias("shingles"))
    blocks = F.ceil(F.col("many") / HOT_BAND).cast("long")
    own = F.pmod(F.xxhash64("same"), blocks)
    parts = pairs.select("key", "same", blocks.alias("b"), own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
    parts = parts.select("key", "same", (F.least("i", "j") * F.col("b") + F.greatest("i", "j")).alias("part"))
    parts = parts.join(sets, "same").select("key", "part", "same", "shingles")
    links = parts.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_similar, "src long, dst long")
    groups = connected_components(links).select(F.col("node").alias("same"), F.col("component"))
    named = classes.join(groups, "same", "left").select("same", "n", "first", F.coalesce("component", "same").alias("component"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"), F.sum("n").alias("members")).where("members > 1")
    clusters = named.join(heads, "component").select("same", "head")
    members = places.join(clusters, "same")
    return members.select(*_ROW, "line", F.col("head.doc_id").alias("cluster_doc"), F.col("head.para").alias("cluster_para"), F.col("head.first").alias("cluster_first"), (F.struct(*_ROW) != F.col("head")).alias("removed"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns for each stretch of passages of ``PASSAGE_WORDS`` words that also stand elsewhere, word for word.

    Passages begin where their own words decide (``anchors``), some eleven words apart, and run over line ends: a
    repeated stretch is cut into the same passages whatever stands around it, inside a longer paragraph too. Any stretch
    with a place that has the smallest hash of its neighbourhood and a passage behind it is found; of 50 words, 97 in 100 are, of 56 nearly
    all. Passages are equal by a hash of 128 bits, counted before they are joined. Stretches join what overlaps in
    one document; cluster_doc, cluster_para and cluster_first are the first place of their first passage, and those
    whose passages all come first somewhere are kept.

    A word or a few that are said again and again have no such place. Odd rows are as in ``near_paragraphs``.
    """
    return _repeated(_parsed(docs, id_col, text_col, MIN_WORDS)[1])


def _repeated(parsed: DataFrame) -> DataFrame:
    found = parsed.where(F.col("kind") == PASSAGE).select("h", "h2", "doc_id", "para", "first")
    # one half of the hash tells which may repeat; the few that do are then grouped by both
    maybe = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = found.join(maybe, "h")
    heads = again.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "para", "first")).alias("head")).where("n > 1").select("h", "h2", "head")
    again = again.join(heads, ["h", "h2"]).select("doc_id", "para", "first", "head", (F.struct("doc_id", "para", "first") != F.col("head")).alias("removed")).distinct()
    in_order = Window.partitionBy("doc_id", "removed").orderBy("first")
    begins = F.coalesce((F.col("first") > F.lag("first").over(in_order) + PASSAGE_WORDS).cast("int"), F.lit(0))
    runs = again.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_order))
    spans = runs.groupBy("doc_id", "removed", "run").agg(F.min(F.struct("first", "para", "head")).alias("a"), (F.max("first") + PASSAGE_WORDS - F.min("first")).alias("words"))
    return spans.select("doc_id", "a.para", "a.first", "words", F.col("a.head.doc_id").alias("cluster_doc"), F.col("a.head.para").alias("cluster_para"), F.col("a.head.first").alias("cluster_first"), "removed")


def duplicate_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate paragraphs, lines of fewer than ``MIN_WORDS`` words and repeated passages, told apart by ``kind``.

    'paragraph' rows are those of ``near_paragraphs``, and 'passage' rows those of ``repeated_passages``. 'line' rows are short lines
    by themselves, whatever stands around them, compared with each other only, in the same way. A short line that is a
    whole text is a paragraph too.
    """
    texts, parsed = _parsed(docs, id_col, text_col, MIN_WORDS, True)
    near = _near(texts, parsed, MIN_WORDS, True)
    kinds = near.withColumn("kind", F.when(F.col("line"), "line").otherwise("paragraph")).drop("line")
    return kinds.unionByName(_repeated(parsed).withColumn("kind", F.lit("passage")))
