"""SimHash near-duplicates: a positional byte index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, pick, whole_groups
from .components import connected_components

SHINGLE_WORDS, SEED, BITS = 4, 42, 4
#: Two fingerprints with at most four different bits differ in at most four bytes.
MIN_SHARED = 8 - BITS
#: Members of an index entry that one task compares; larger entries are divided, never shortened.
HOT_ENTRY = 4096
#: Three groups of byte positions; see ``covering_triples``.
POSITION_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def covering_triples() -> list[tuple[int, int, int]]:
    """The 20 triples of byte positions of Turan's design: any four positions contain one of them.

    Two fingerprints that share four or more positional bytes thus meet under at least one triple, and entries
    are 65,536 times as selective as those of single bytes.
    """

    def taken(t: tuple[int, int, int]) -> bool:
        of = [sum(p in g for p in t) for g in POSITION_GROUPS]
        return 3 in of or any(of[i] == 2 and of[(i + 1) % 3] == 1 for i in range(3))

    return [t for t in combinations(range(8), 3) if taken(t)]


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text; zero if it has no words.

    A-Z are lower-cased; words are runs without space and without the bytes 9 to 13, which is what ``bytes``
    do by themselves; a shingle is four words joined by a space, or all words if there are fewer.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    stops = ends[min(SHINGLE_WORDS, len(words)) - 1 :]
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in others), pa.array(prints.view(np.int64))], [*others, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row; fp is the fingerprint's 64 bits as a long."""
    return pick(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tallies the shared positional bytes of each pair, keeps pairs with the guaranteed minimum, and verifies their bits."""
    x = a ^ b
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
    kept = shared >= MIN_SHARED
    kept[kept] = np.bitwise_count(x[kept]) <= BITS
    return kept


def spanning_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within one entry, at most one for each member.

    Each member is compared once with those not reached so far, so a dense group needs few comparisons and gives
    no more links than members.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            u = reached.pop()
            ok = near(prints[rest], prints[u : u + 1])
            new = rest[ok].tolist()
            out += [(u, v) for v in new]
            reached += new
            rest = rest[~ok]
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(batches, ["key", "part"]):
        prints, reps = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        first, size = bounds[:-1], np.diff(bounds)
        two = first[size == 2]
        two = two[near(prints[two], prints[two + 1])]
        a, b = [two], [two + 1]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            if links := spanning_links(prints[at : at + n]):
                pairs = np.array(links) + at
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        yield pa.record_batch([pa.array(reps[np.concatenate(a)]), pa.array(reps[np.concatenate(b)])], ["src", "dst"])


def _byte(p: int) -> F.Column:
    return F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))


def _entries(rows: DataFrame) -> DataFrame:
    """Rows of the entries that have two members or more, with the number of members."""
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")


def links(classes: DataFrame) -> DataFrame:
    """``(src, dst)``: links that connect the classes ``(fp, rep)`` at ``BITS`` or fewer different bits.

    An entry with more than ``HOT_ENTRY`` members is divided by one more byte, as linked fingerprints share four;
    what is still larger is divided in blocks, and each pair of blocks is compared by a task of its own.
    """
    triples = covering_triples()
    key = [F.lit(t << 24).cast("long").bitwiseOR(F.shiftleft(_byte(p), 16)).bitwiseOR(F.shiftleft(_byte(q), 8)).bitwiseOR(_byte(r)) for t, (p, q, r) in enumerate(triples)]
    rows = cut(_entries(classes.select("fp", "rep", F.explode(F.array(*key)).alias("key"))))
    cold = rows.where(f"n <= {HOT_ENTRY}").select("key", F.lit(0).cast("long").alias("part"), "fp", "rep")
    # of the fourth byte; the three that define the entry add nothing new but stay in, as the entry's number hides them
    fourth = F.array(*[F.xxhash64("key", F.lit(p), _byte(p)) for p in range(8)])
    inside = F.array(*[F.lit(list(t)) for t in triples])[F.shiftright("key", 24).cast("int")]
    spare = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.lit(7)).alias("p"), fourth.alias("k")), lambda x: ~F.array_contains(inside, x["p"]))
    hot = _entries(rows.where(f"n > {HOT_ENTRY}").select("fp", "rep", F.explode(spare).alias("s")).select("fp", "rep", F.col("s.k").alias("key")))
    blocks = F.ceil(F.col("n") / HOT_ENTRY).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    hot = hot.select("key", "fp", "rep", blocks.alias("b"), own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
    hot = hot.select("key", (F.least("i", "j") * F.col("b") + F.greatest("i", "j")).alias("part"), "fp", "rep")
    return cold.unionByName(hot).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_link, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Documents are linked if their fingerprints differ in ``BITS`` bits or fewer; component_id is the smallest
    doc_id that links lead to, the document's own included. Equal fingerprints are one class, represented by its
    smallest doc_id, before anything is compared: groups of copies never meet pair by pair.

    Null texts and texts without words have fingerprint zero and are linked like others. Repeated rows are
    returned as often as they come. A row whose doc_id is null gets the component of its fingerprint's other
    rows, or null if there are none, and links nothing. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(classes.where("rep is not null")))
    by_print = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_print = by_print.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: of those with its smallest doc_id, the one whose text has the smallest hash.

    A row is known by its doc_id and text: rows of one doc_id with other texts are documents of their own, rows that
    agree in both are one, with the other columns of any of them. An empty table gives no rows. Documents whose doc_id is null are members like others, and stay if their group has no id.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, row long, fp long")
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")).select("fp", F.col("fp").alias("rep"), "first"))
    found = connected_components(links(classes)).select(F.col("node").alias("rep"), "component")
    groups = classes.join(found, "rep", "left").groupBy(F.coalesce("component", "rep").alias("group")).agg(F.min("first").alias("first"))
    kept = groups.select(F.col("first.row").alias("row"))
    whole = docs.select(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    one = whole.join(kept, "row", "left_semi").groupBy("row").agg(F.any_value("all").alias("all"))
    return one.select(*[F.col(f"all.`{c}`").alias(c) for c in docs.columns])
