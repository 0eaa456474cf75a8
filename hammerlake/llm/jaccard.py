"""Documents whose sets of word n-grams are alike: tiles by size, bitmaps that bound the overlap, exact intersections."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import WordHashes, cut, gram_hashes, pick, slices, whole_groups, written
from .components import connected_components

SHINGLE_WORDS = 5
#: Sets are linked if 5 times their intersection is at least 4 times their union: a similarity of 0.8.
SIMILARITY = (4, 5)
#: Counters of the table that tells common shingles from rare ones, whatever the corpus holds, and those sent at a time.
COUNTERS, COUNTERS_SENT = 1 << 21, 1 << 14
#: Bits of a signature for each element, and the most of a signature.
BITS_EACH, MOST_BITS = 2, 1 << 15
#: Members of a tile that one task compares with each other, and bytes that they have; more are divided in blocks.
HOT_TILE, HOT_BYTES = 4096, 64 << 20
#: Rows that are joined by broadcast at most (16 bytes each).
BROADCAST_ROWS = 1_000_000


def shingle_set(text: bytes | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes (64 bits) of a text's runs of five words; of all words if there are fewer."""
    return np.unique(gram_hashes(known.of((text or b"").lower().split()), SHINGLE_WORDS))


def alike(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b elements with so many in common are linked."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def prefix_size(n: int) -> int:
    """So many elements, in any order that all sets share, of which two linked sets have one in common."""
    return n - -(-SIMILARITY[0] * n // SIMILARITY[1]) + 1


def signature(elements: np.ndarray) -> bytes:
    """A bitmap with the bit of each element's hash set; a power of two bits, ``BITS_EACH`` or more for each element."""
    bits = min(MOST_BITS, max(64, 1 << (BITS_EACH * len(elements) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(elements & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """The signatures (rows) at the width of the shortest: the halves of longer ones are laid over each other."""
    least = min(map(len, signatures))
    out = np.zeros((len(signatures), least // 8), np.uint64)
    for row, s in zip(out, signatures):
        np.bitwise_or.reduce(np.frombuffer(s, "<u8").reshape(-1, least // 8), axis=0, out=row)
    return out


def may_be_alike(sizes: np.ndarray, bitmaps: np.ndarray, u: int, others: np.ndarray) -> np.ndarray:
    """Whether the bits that differ leave room for enough common elements; each comes from an element of one set only."""
    total = sizes[others] + sizes[u]
    room = (total - np.bitwise_count(bitmaps[others] ^ bitmaps[u]).sum(axis=1, dtype=np.int64)) // 2
    return alike(np.minimum(room, np.minimum(sizes[others], sizes[u])), sizes[others], sizes[u])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, size and name of its set) for each document, then the counts of the task's shingles by their hash."""
    known, counts = WordHashes(), np.zeros(COUNTERS, np.int64)
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))
    names = ["doc_id", "n", "cls", "block", "counts"]
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [shingle_set(t.as_py(), known) for t in part.column("text").cast(pa.binary())]
            sizes = np.array([len(x) for x in sets], np.int64)
            if len(sets):
                counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=COUNTERS)
            cls = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            none = pa.nulls(len(sets))
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes), pa.array(cls, mask=sizes == 0), none.cast(pa.int32()), none.cast(pa.binary())], names)
    for block, some in enumerate(counts.reshape(-1, COUNTERS_SENT)):
        if some.any():
            null = pa.nulls(1, pa.int64())
            yield pa.record_batch([null, null, null, pa.array([block], pa.int32()), pa.array([zlib.compress(some.astype("<i8").tobytes(), 1)])], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of each block as levels: eight for each doubling, so that a byte holds any count."""

    def level(block: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8).tobytes()])], ["block", "levels"])

    last, total = None, np.zeros(COUNTERS_SENT, np.int64)
    for batch in batches:
        for block, some in zip(batch.column("block").to_pylist(), batch.column("counts")):
            if block != last:
                if last is not None:
                    yield level(last, total)
                last, total = block, np.zeros(COUNTERS_SENT, np.int64)
            total += np.frombuffer(zlib.decompress(some.as_py()), "<i8")
    if last is not None:
        yield level(last, total)


def _prefixes(batches: Iterator[pa.RecordBatch], levels: Broadcast) -> Iterator[pa.RecordBatch]:
    """(class, size, the rarest elements that a linked set shares one of, signature); a class once for some time of a task."""
    known, seen = WordHashes(), set()
    rank = np.frombuffer(levels.value, np.uint8)
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))
    for batch in batches:
        for part in slices(batch, "text"):
            cls, sizes, keys, bits = [], [], [], []
            if len(seen) > 500_000:
                seen.clear()
            for t in part.column("text").cast(pa.binary()):
                x = shingle_set(t.as_py(), known)
                name = xxhash.xxh3_64_intdigest(x)
                if not len(x) or name in seen:
                    continue
                seen.add(name)
                order = (rank[(x >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                few = prefix_size(len(x))
                keys.append(x[np.argpartition(order, few - 1)[:few]])
                cls.append(name)
                sizes.append(len(x))
                bits.append(signature(x))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(bits, pa.binary())], ["cls", "n", "keys", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, its set as bytes)."""
    known = WordHashes()
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            sets = [x for t in part.column("text").cast(pa.binary()) if len(x := shingle_set(t.as_py(), known))]
            cls = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(cls), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "load"])


def spanning(n: int, other: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links among n members that connect whatever links connect, if those not ``other`` are connected anyhow.

    Members are compared with those not reached so far, so that a dense group needs few comparisons and has no more
    links than members; each ``other`` is linked to one of the rest at most.
    """
    out: list[tuple[int, int]] = []
    rest, hub = np.flatnonzero(other), np.flatnonzero(~other)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        at_hub = False
        while reached:
            u = reached.pop()
            if len(hub) and not at_hub and len(hit := hub[near(u, hub)]):
                out.append((u, int(hit[0])))
                at_hub = True  # all that are reached from here are connected with it
            if len(rest):
                ok = near(u, rest)
                out += [(u, int(v)) for v in rest[ok]]
                reached += rest[ok].tolist()
                rest = rest[~ok]
    return out


def _by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each part whose bitmaps leave room for enough common elements."""

    def comparer(loads: list[bytes], sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        bitmaps = folded(loads)
        return lambda u, others: may_be_alike(sizes, bitmaps, u, others)

    return _linked(batches, comparer)


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each part by exact intersection of sorted arrays."""

    def comparer(loads: list[bytes], sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in loads]
        bitmaps = folded([signature(x) for x in sets])

        def near(u: int, others: np.ndarray) -> np.ndarray:
            ok = may_be_alike(sizes, bitmaps, u, others)
            x = sets[u]
            for k in np.flatnonzero(ok).tolist():
                y = sets[others[k]]
                common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                ok[k] = alike(common, len(x), len(y))
            return ok

        return near

    return _linked(batches, comparer)


def _linked(batches: Iterator[pa.RecordBatch], comparer: Callable) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(batches, ["tile", "part"]):
        cls, other, sizes = (table.column(c).to_numpy() for c in ("cls", "other", "n"))
        loads, links = table.column("load"), []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                near = comparer(loads.slice(a, b - a).to_pylist(), sizes[a:b].astype(np.int64))
                links += [(cls[a + u], cls[a + v]) for u, v in spanning(b - a, other[a:b], near)]
        yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["src", "dst"])


def connect(members: DataFrame, walk: Callable) -> DataFrame:
    """Links that connect the ``(tile, cls, n, load)`` of each tile as ``walk`` finds them alike.

    A tile with more than ``HOT_TILE`` members or ``HOT_BYTES`` is divided in blocks, each with the tile's first member: what is like it,
    or like what is like it, is connected after that. Then those outside the largest group of a tile meet all its
    blocks, and nothing else does; pairs within that group need no comparison.
    """
    sizes = members.groupBy("tile").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("load")).alias("bytes"), F.min("cls").alias("head")).where("m > 1")
    dealt = members.join(sizes, "tile").withColumn("blocks", F.ceil(F.greatest(F.col("m") / HOT_TILE, F.col("bytes") / HOT_BYTES)).cast("int"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    first = dealt.withColumn("part", F.explode(F.when(F.col("cls") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block)))).withColumn("other", F.lit(True))
    layout = ["tile", "part", "cls", "n", "other", "load"]

    def links(parts: DataFrame) -> DataFrame:
        return cut(parts.select(*layout).repartition("tile", "part").sortWithinPartitions("tile", "part").mapInArrow(walk, "src long, dst long").distinct())

    found = links(first)
    divided = dealt.where("blocks > 1")
    if divided.isEmpty():
        return found
    groups = connected_components(found)
    placed = cut(divided.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).withColumn("block", block))
    largest = placed.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("tile").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("of"))
    outside = largest.where("of > top.c").select("tile", F.col("top.component").alias("top"), F.ceil((F.col("of") - F.col("top.c")) / HOT_TILE).cast("int").alias("o"))
    mixed = placed.join(outside, "tile").withColumn("other", F.col("component") != F.col("top"))
    # part (i, j): the i-th of the outsiders' blocks and the j-th of all; an outsider is in both
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_other = F.when(F.col("other"), F.transform(every("blocks"), lambda j: F.pmod(F.xxhash64("cls", F.lit(1)), F.col("o")).cast("int") * F.col("blocks") + j)).otherwise(F.array().cast("array<int>"))
    as_member = F.transform(every("o"), lambda i: i * F.col("blocks") + F.col("block"))
    second = mixed.withColumn("part", F.explode(F.array_distinct(F.concat(as_other, as_member))))
    return found.unionByName(links(second))


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(src, dst)``: links between classes that connect all linked sets of ``docs``; ``sets`` are ``_named``'s rows."""
    spark = docs.sparkSession
    counted = sets.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, levels binary")
    levels = bytearray(COUNTERS)
    for r in counted.collect():  # COUNTERS bytes in all
        levels[r.block * COUNTERS_SENT : (r.block + 1) * COUNTERS_SENT] = r.levels
    shared = spark.sparkContext.broadcast(bytes(levels))
    prefixes = written(docs.mapInArrow(lambda x: _prefixes(x, shared), "cls long, n int, keys array<long>, bits binary"))

    entries = prefixes.select("cls", "n", F.explode("keys").alias("key"))
    several = entries.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least != most").select("key")
    # linked sets differ in size by a quarter at most, and so are in one band or in neighbouring ones
    band = F.floor(F.log("n") / F.log(F.lit(SIMILARITY[1] / SIMILARITY[0])) + 1e-9).cast("int")
    tiles = cut(entries.join(several, "key").withColumn("band", F.explode(F.array(band, band - 1))).select("key", "band", "cls").distinct())
    # tiles with the same members are one
    named = tiles.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x")).where("m > 1").select("key", "band", F.xxhash64("m", "x").alias("tile"))
    tiles = tiles.join(named, ["key", "band"]).select("tile", "cls").distinct()
    signatures = prefixes.groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("load"))
    maybe = connected_components(connect(tiles.join(signatures, "cls"), _by_bits)).select(F.col("node").alias("cls"), F.col("component").alias("tile"))

    maybe = cut(maybe.join(sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n")), "cls"))
    wanted = maybe.select("doc_id").distinct()
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    loads = docs.join(few, "doc_id", "left_semi").mapInArrow(_sets, "cls long, load binary").groupBy("cls").agg(F.any_value("load").alias("load"))
    return connect(maybe.join(loads, "cls").select("tile", "cls", "n", "load"), _by_sets)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    A document's set are its distinct runs of five words (A-Z lower-cased; all words if there are fewer), by hashes of
    64 bits. Two are linked if their Jaccard similarity is ``SIMILARITY`` or more; component_id is the smallest doc_id that links lead to.

    Equal sets are one class, known by 64 bits. Linked sets share one of their rarest elements; classes that share one and are near in size
    make a tile. Hashed bitmaps bound the overlap from above; what they leave is connected to groups, in which sorted
    arrays are intersected. No link between different sets is lost; within a group only as many are looked at as connect it.

    Null texts and texts without words have no shingles, are linked with nothing and are their own component. Repeated
    rows are returned as often as they come. A row with null doc_id gets the component of other rows with
    the same set, or null, and connects nothing. An empty table gives no rows.
    """
    texts = pick(docs, id_col, text_col)
    sets = written(texts.mapInArrow(_named, "doc_id long, n long, cls long, block int, counts binary"))
    known = texts.where("doc_id is not null")
    groups = connected_components(links(known, sets.where("block is not null or doc_id is not null")))
    rows = sets.where("block is null").select("doc_id", "n", "cls")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    placed = classes.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = placed.join(least, "component").select("cls", "component_id")
    return rows.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
