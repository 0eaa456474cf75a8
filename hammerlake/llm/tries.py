"""A trie of conversation prefixes: the Cartesian tree over the common prefixes of conversations in order."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, written

#: Hexadecimal digits that name a turn's role and text.
DIGITS = 32

def rebuilt(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """``(conv_id, turn, role, text)``: each conversation begins as the first of its group of ``group`` ids does.

    With h the CRC-32 of the decimal conv_id modulo ``most`` + 1: the first h turns of conversation conv_id - conv_id %
    ``group`` (fewer if it has fewer, none if there is none), then its own turns after its first h. turn counts them
    from 0; a conversation without turns left has one row whose turn, role and text are null. Turns are in order of
    turn (null first), then role and text; null roles and texts are empty. Rows with null conv_id are left out.
    """
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id is not null")
    taken = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(most + 1))
    numbered = said.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long") - 1)
    ids = said.select("conv_id").distinct()
    first = numbered.where((F.col("k") < most) & (F.pmod("conv_id", F.lit(group)) == 0))
    first = first.select(F.explode(F.sequence("conv_id", F.col("conv_id") + (group - 1))).alias("conv_id"), "k", "role", "text")
    first = first.where(F.col("k") < taken("conv_id")).join(ids, "conv_id", "left_semi")
    own = numbered.where(F.col("k") >= taken("conv_id")).select("conv_id", "k", "role", "text")
    # own turns follow those that were taken, of which there may be fewer than h
    n_first = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_first"))
    own = own.join(n_first, "conv_id", "left").select("conv_id", (F.col("k") - taken("conv_id") + F.coalesce("n_first", F.lit(0))).alias("turn"), "role", "text")
    turns = first.select("conv_id", F.col("k").alias("turn"), "role", "text").unionByName(own)
    return ids.join(turns, "conv_id", "left")


def sequences(conversations: DataFrame) -> DataFrame:
    """``(key, sizes, convs, least, ends)`` for each distinct sequence of turns.

    key has ``DIGITS`` hexadecimal digits (MD5 of role and text) for each turn, sizes the bytes of each text. convs
    is the number of conversations, least the smallest conv_id, and ends the SHA-256 of their ids in order, with commas.
    """
    turn = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    said = F.when(F.col("text").isNotNull(), F.struct("turn", turn.alias("digest"), F.octet_length("text").cast("long").alias("size")))
    listed = conversations.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    rows = listed.select("conv_id", F.array_join(F.transform("said", lambda x: x["digest"]), "").alias("key"), F.transform("said", lambda x: x["size"]).alias("sizes"))
    rows = cut(rows.withColumn("name", F.md5(F.col("key").cast("binary"))))
    ends = rows.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_ends, "name string, ends string")
    found = rows.groupBy("name").agg(F.any_value("key").alias("key"), F.any_value("sizes").alias("sizes"), F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("least"))
    return found.join(ends, "name").drop("name")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each name's ids; ids are read in order and not kept."""
    last, h = None, None
    for batch in batches:
        names, ids, out = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), []
        for name, i in zip(names, ids):
            if name != last:
                if h is not None:
                    out.append((last, h.hexdigest()))
                last, h = name, hashlib.sha256(str(i).encode())
            else:
                h.update(b",%d" % i)
        yield pa.record_batch([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["name", "ends"])
    if h is not None:
        yield pa.record_batch([pa.array([last]), pa.array([h.hexdigest()])], ["name", "ends"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns a block's first key shares with the key before it, and its last with the key behind; -1 if there is none."""
    for batch in batches:
        first, last, before, behind = (batch.column(c).to_pylist() for c in ("first", "last", "before", "behind"))
        shared = [[-1 if x is None or y is None else common(x, y) for x, y in zip(*pair)] for pair in ((before, first), (last, behind))]
        yield pa.record_batch([batch.column("block"), *(pa.array(x, pa.int64()) for x in shared)], ["block", "before", "behind"])


def common(a: str, b: str) -> int:
    """How many turns two keys begin with alike."""
    return bisect_left(range(1, min(len(a), len(b)) // DIGITS + 1), True, key=lambda k: a[: DIGITS * k] != b[: DIGITS * k])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's first and last keys."""
    first = last = block = None
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("key")
            first, last, block = keys[0].as_py() if first is None else first, keys[batch.num_rows - 1].as_py(), batch.column("block")[0].as_py()
    if first is not None:
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([first]), pa.array([last])], ["block", "first", "last"])


class _Open:
    """A node whose interval has not ended: where it began (no place if in an earlier block), what it holds so far, and its children."""

    __slots__ = ("at", "depth", "least", "above", "ends", "sums", "children", "waiting")

    def __init__(self, at: int | None, depth: int, least: int, above: int, ends: str | None, sums: tuple[int, int, int]) -> None:
        self.at, self.depth, self.least, self.above, self.ends, self.sums, self.children, self.waiting = at, depth, least, above, ends, sums, 0, []


class _Block:
    """One pass over the distinct sequences of a block in order, with the nodes that contain the last one on a stack."""

    def __init__(self, block: int) -> None:
        self.block, self.place, self.total, self.stack, self.out = block, 0, (0, 0, 0), [], []

    def close(self, is_open: bool) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent:
            parent.least = min(parent.least, node.least)
            parent.children += node.at is not None
        row = [self.block, node.at, node.depth, node.least, *(x - y for x, y in zip(self.total, node.sums)), node.above, node.ends, node.children, is_open]
        done = node.at is not None and not is_open
        for child in node.waiting:  # a parent that isn't whole yet is named by its place instead
            self.out.append([*child, node.at, node.least if done else None])
        if parent and parent.at is not None and done:
            parent.waiting.append(row)
        else:
            self.out.append([*row, parent.at if parent else None, None])

    def add(self, key: str, sizes: list[int], convs: int, least: int, ends: str, shared: int, following: int) -> None:
        """The next sequence, which has ``shared`` turns like the one before it and ``following`` like the one behind."""
        while self.stack and self.stack[-1].depth > shared:
            self.close(False)
        if self.place == 0:  # nodes of earlier blocks that reach into this one
            self.stack = [_Open(None, d, least, 0, None, self.total) for d in range(shared + 1)]
        if self.stack:
            self.stack[-1].least = min(self.stack[-1].least, least)
        upto = [0]
        for size in sizes:
            upto.append(upto[-1] + size)
        n, again = len(sizes), upto[max(shared, 0)]
        begun = (self.total[0], self.total[1], self.total[2] + again)
        for d in range(shared + 1, n + 1):
            self.stack.append(_Open(self.place, d, least, upto[max(d - 1, 0)], ends if d == n else None, begun))
        self.total = (self.total[0] + convs, self.total[1] + (following < n), self.total[2] + again + (convs - 1) * upto[n])
        self.place += 1


_NODE = {"block": "int", "at": "long", "depth": "long", "least": "long", "convs": "long", "leaves": "long", "shared": "long", "above": "long", "ends": "string", "children": "long", "open": "boolean", "p_at": "long", "p_least": "long"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _nodes(batches: Iterator[pa.RecordBatch], met: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The nodes of a block, with their parents or these ones' places; see ``prefix_trie``."""
    state: _Block | None = None
    held: tuple | None = None  # the sequence before, which waits for the one behind it
    shared = -1

    def rows() -> pa.RecordBatch:
        columns = [pa.array([x[k] for x in state.out], _ARROW[t]) for k, t in enumerate(_NODE.values())]
        state.out = []
        return pa.record_batch(columns, [*_NODE])

    for batch in batches:
        for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "sizes", "convs", "least", "ends"))):
            if held is None:
                state, shared = _Block(block), met[block][0]
            else:
                following = common(held[0], row[0])
                state.add(*held, shared, following)
                shared = following
            held = row
        if state and state.out:
            yield rows()
    if held is not None:
        behind = met[state.block][1]
        state.add(*held, shared, behind)
        while state.stack:
            state.close(state.stack[-1].depth <= behind)
        yield rows()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` for each node.

    A node is a distinct sequence of the first depth turns (role, text) of a conversation; the root has none. ``conversations``
    has conv_id, turn (0, 1, ...), role and text, as ``rebuilt`` gives them; conv_id is the smallest
    of a node's members, with the depth it names the node. Childless nodes of the subtree are counted, and saved_tokens sums (n_convs - 1) x
    bytes of the last text over it; ends_sha256 is the hash of the ids of the conversations that end there.

    Equal conversations are one row. These are put in order over all partitions; the numbers of turns that neighbours share
    are an array whose Cartesian tree, with equal neighbours merged and depths in between filled in, is the trie. Each partition is a block: one
    pass with a stack finds the nearest smaller values on both sides, and sums of subtrees are differences of running
    sums. What is as deep as the least value of the blocks it passes stays open: each block leaves a piece for each such
    depth, and a piece belongs to the last node of its depth that began before. Pieces are as many as blocks times depths.

    An empty table gives no rows. A conversation is a row with 32 digits a turn while it is put in order.
    """
    ordered = cut(sequences(conversations).repartitionByRange("key").sortWithinPartitions("key")).withColumn("block", F.spark_partition_id())
    by_block = Window.partitionBy(F.lit(0)).orderBy("block")
    edges = ordered.mapInArrow(_edges, "block int, first string, last string")
    beside = edges.select("block", "first", "last", F.lag("last").over(by_block).alias("before"), F.lead("first").over(by_block).alias("behind"))
    met = {r.block: (r.before, r.behind) for r in beside.mapInArrow(_met, "block int, before long, behind long").collect()}  # three numbers a partition
    nodes = written(ordered.select("block", "key", "sizes", "convs", "least", "ends").mapInArrow(lambda x: _nodes(x, met), ", ".join(f"{k} {t}" for k, t in _NODE.items())))

    # pieces of nodes that several blocks share, by the block where they began
    began = Window.partitionBy("depth").orderBy("block", F.col("at").asc_nulls_first())
    pieces = nodes.where("open or at is null").withColumn("owner", F.last(F.when(F.col("at").isNotNull(), F.struct("block", "at", "p_at", "above", "ends")), ignorenulls=True).over(began))
    whole = pieces.groupBy("owner", "depth").agg(*[F.min("least").alias("least")], *[F.sum(c).alias(c) for c in ("convs", "leaves", "shared", "children")])
    across = cut(whole.select("owner.block", "owner.at", "depth", "least", "convs", "leaves", "shared", "owner.above", "owner.ends", "children", "owner.p_at", F.lit(None).cast("long").alias("p_least")))
    carried = pieces.where("at is null").select("block", F.col("depth").alias("p_depth"), "owner.block", "owner.at").toDF("block", "p_depth", "of_block", "of_at")

    alone = nodes.where("not open and at is not null").select(*across.columns)
    known = alone.where("p_least is not null")
    rest = alone.where("p_least is null").unionByName(across).withColumn("p_depth", F.col("depth") - 1)
    rest = rest.join(carried, ["block", "p_depth"], "left").withColumn("of_block", F.when(F.col("p_at").isNull(), F.col("of_block")).otherwise(F.col("block"))).withColumn("of_at", F.coalesce("p_at", "of_at"))
    parents = across.select(F.col("block").alias("of_block"), F.col("at").alias("of_at"), F.col("depth").alias("p_depth"), F.col("least").alias("of_least"))
    rest = rest.join(parents, ["of_block", "of_at", "p_depth"], "left").withColumn("p_least", F.col("of_least")).select(*across.columns)
    saved = F.col("shared") - (F.col("convs") - 1) * F.col("above")
    return known.unionByName(rest).select(F.col("least").alias("conv_id"), "depth", F.col("p_least").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
