"""Quotations in messages, linked to the messages they come from; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import let
from ._util import cut, written

#: Shorter passages are said everywhere: they are linked to another conversation only if it is the only one that says them.
MIN_WORDS = 4
_PREFIX = r"^(?:[ \t]*>)*[ \t]?"


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail clients write them: a reply quotes the message before it, and that one's own quotation.

    The ``conversations`` table has no quotation marks; its query links the quotes of this form. Of a turn that
    comes several times, the first text in order is quoted.
    """
    # texts are dealt out once, by conversation: a turn's first row sees the turn before, and tells its other rows
    in_order, of_turn = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id", "turn")
    row = conversations.select("conv_id", "turn", "role", "text", (~F.lag("turn", 1).over(in_order).eqNullSafe(F.col("turn"))).alias("opens"))
    row = row.withColumn("said", F.min("text").over(of_turn))
    for name, before in (("one", "said"), ("two", "one")):
        row = row.withColumn(name, F.when(F.col("opens"), F.lag(before, 1).over(in_order))).withColumn(name, F.max(name).over(of_turn))
    lines = lambda c, mark: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.regexp_replace(F.col(c), r"(?m)^", mark))
    text = F.concat_ws("\n", lines("two", "> > "), lines("one", "> "), F.col("text"))
    return row.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull(), text).alias("text"))


def _lines(text: Column) -> Column:
    """``(level, text)`` of each line: how many marks it begins with, and what follows them."""
    marked = F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(F.regexp_extract(x, _PREFIX, 0).alias("marks"), x.alias("line")))
    return F.transform(marked, lambda x: F.struct(F.length(F.translate(x["marks"], " \t", "")).alias("level"), F.substring(x["line"], F.length(x["marks"]) + 1, F.length(x["line"])).alias("text")))


def _normal(text: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _words(normal: Column) -> Column:
    return F.when(normal == "", 0).otherwise(F.size(F.split(normal, " ")))


def _level_of(n: Column) -> Column:
    """The greatest k with 2^k <= n."""
    return F.floor(F.log2(n) + 1e-9).cast("int")


def _doubled(h: Column, k: Column) -> Column:
    """Hashes of all runs of 2^k neighbours, from those ``h`` of all runs of 2^(k-1)."""
    step = F.pow(F.lit(2), k - 1).cast("int")
    return F.transform(F.slice(h, 1, F.greatest(F.lit(0), F.size(h) - step)), lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def _passages(lines: Column) -> Column:
    """``(passage, level, hash, m, first, last)`` of each passage of a message that has words; ``first`` and ``last`` as ``_runs`` has them.

    Neighbouring lines of one level are a passage, and own lines between them are counted as one.
    """
    opens = lambda g: F.filter(F.transform(g["lines"], lambda x, i: F.when((i == 0) | (F.get(g["lines"], i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
    part = lambda g, at, i, j: F.struct((j + 1).alias("passage"), F.get(g["lines"], i)["level"].alias("level"), F.slice(g["lines"], i + 1, F.coalesce(F.get(at, j + 1), F.size(g["lines"])) - i).alias("lines"))
    parts = let({"lines": lines}, lambda g: let({"at": opens(g)}, lambda s: F.transform(s["at"], lambda i, j: part(g, s["at"], i, j))))
    texts = F.transform(F.filter(parts, lambda p: p["level"] > 0), lambda p: F.struct(p["passage"].alias("passage"), p["level"].alias("level"), _said(F.transform(p["lines"], lambda x: x["text"])).alias("said")))

    def known(p: Column) -> Column:
        m = F.size(p["said"])
        runs = F.when(m > 1, F.aggregate(F.sequence(F.lit(1), _level_of(m)), _hashes(p["said"]), _doubled))
        return let({"runs": runs}, lambda r: F.struct(p["passage"].alias("passage"), p["level"].alias("level"), F.xxhash64(F.array_join(p["said"], " ")).alias("hash"), m.alias("m"), F.get(r["runs"], F.lit(0)).alias("first"), F.element_at(r["runs"], -1).alias("last")))

    return F.transform(F.filter(texts, lambda p: F.size(p["said"]) > 0), known)


def _said(lines: Column) -> Column:
    """The lines that have words, normalised."""
    return F.filter(F.transform(lines, _normal), lambda x: x != "")


def _hashes(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.xxhash64(x))


def _runs(own: DataFrame, passages: DataFrame) -> DataFrame | None:
    """``(conv_id, turn, hash)``: passages of several lines that are a run of whole lines of a message of their conversation, but not all its lines.

    ``own`` (conv_id, turn, row, h) has the hashes of each message's own lines that have words. A run of m lines is known by the hashes of its first
    and its last 2^k lines, with 2^k the greatest power that fits: as these double from level to level, no line meets all runs that hold it. Only
    hashes are shuffled. None if no passage has several lines.
    """
    most = passages.agg(F.max("m")).first()[0] or 0
    if most < 2:
        return None
    wanted = passages.where("m > 1").select("conv_id", _level_of(F.col("m")).alias("k"), "m", "first", "last", "hash").distinct()
    # all own lines together are the whole text, which is an original by itself
    levels = F.sequence(F.lit(1), F.least(_level_of(F.size("h") - 1), F.lit(most.bit_length() - 1)))
    table = own.where(F.size("h") > 2).select("*", F.size("h").alias("n"), F.explode(levels).alias("k"))
    table = table.select("conv_id", "turn", "row", "n", "k", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.col("k")), "h", _doubled)).alias("pos", "h"))
    begun = table.join(wanted.withColumnRenamed("first", "h"), ["conv_id", "k", "h"]).where("pos + m <= n and m < n")
    begun = begun.select("conv_id", "turn", "row", "k", (F.col("pos") + F.col("m") - F.pow(F.lit(2), F.col("k")).cast("int")).alias("pos"), F.col("last").alias("h"), "hash")
    return begun.join(table.drop("n"), ["conv_id", "turn", "row", "k", "pos", "h"]).select("conv_id", "turn", "hash")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, own_text, reply_to, quoted_conv, n_quotes, n_linked, thread, position)`` for each message.

    ``messages`` has conv_id and turn (long), role and text. Lines that begin with ``>`` are quoted, nested as
    many levels as there are marks; neighbouring lines of one level are a passage. Passages that have words are
    normalised, hashed, and joined to messages whose whole own text, one of whose own lines or paragraphs, or a run of whose own lines is the
    same: the latest earlier message of the conversation, else (but for runs of lines) the first of all conversations; one of fewer than ``MIN_WORDS``
    words only if no third conversation has it.
    A message replies to the turn of its shallowest linked passage in its conversation, or else to the turn
    before it. own_text is the text without quotes; thread the first turn that replies lead back to; position
    counts a conversation's messages thread by thread, each before its replies (equal turns in order of text).

    A null text is an empty message, and has a null own_text. Rows with null conv_id or turn are in no
    conversation: they link nothing and have null reply_to. Repeated rows are each returned; those of one turn
    share its links. Empty tables give no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.select("conv_id", "turn", "role", _lines(F.col("text")).alias("lines"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    own_text = F.trim(F.array_join(F.transform(own, lambda x: x["text"]), "\n"))
    parsed = rows.select("conv_id", "turn", "role", own_text.alias("own_text"), "lines")

    # what is looked for is hashed in place, so that no text is shuffled before the last join
    facts = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.xxhash64("role", "own_text").alias("row"), _passages(F.col("lines")).alias("passages"), _said(F.split("own_text", "\n")).alias("said"), F.when(F.col("own_text").rlike(r"\n\s*\n"), _said(F.split("own_text", r"\n\s*\n"))).otherwise(F.array()).alias("paragraphs"))
    parts = F.filter(F.concat(F.array(F.array_join("said", " ")), "said", "paragraphs"), lambda x: x != "")
    originals = F.array_distinct(F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("hash"), (_words(x) >= MIN_WORDS).alias("long"))))
    facts = written(facts.select("conv_id", "turn", "row", "passages", originals.alias("originals"), _hashes(F.col("said")).alias("h")))
    passages = facts.select("conv_id", "turn", F.inline("passages"))

    # originals: whole own texts, their lines and paragraphs, and runs of lines that a passage of the conversation asks for
    originals = facts.select("conv_id", "turn", F.inline("originals"))
    runs = _runs(facts.select("conv_id", "turn", "row", "h"), passages)
    here = originals.select("conv_id", "turn", "hash")
    here = here if runs is None else here.unionByName(runs)

    # within a conversation: the last original before each passage, by one sort instead of a join of all with all; rows are made distinct where they meet
    both = here.select("conv_id", "hash", "turn", F.col("turn").alias("original"), F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("level")).unionByName(passages.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("original"), "passage", "level"))
    both = both.repartition("conv_id", "hash").distinct()
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("from_turn", F.last("original", ignorenulls=True).over(before)).where("passage is not null").drop("original")
    first = originals.groupBy("hash").agg(F.min("conv_id").alias("first_conv"), (F.max("long") | (F.min("conv_id") == F.max("conv_id"))).alias("rare")).where("rare")
    linked = near.join(first, "hash", "left").select("conv_id", "turn", "passage", "level", "from_turn", F.when(F.col("from_turn").isNotNull(), F.col("conv_id")).otherwise(F.when(F.col("first_conv") != F.col("conv_id"), F.col("first_conv"))).alias("from_conv"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    of_turn = linked.withColumn("row", F.lit(0)).unionByName(facts.select("conv_id", "turn", none("int", "passage"), none("int", "level"), none("long", "from_turn"), none("long", "from_conv"), F.lit(1).alias("row")))
    of_turn = of_turn.groupBy("conv_id", "turn").agg(F.sum("row").alias("n_rows"), F.count("passage").alias("n_quotes"), F.count("from_conv").alias("n_linked"), F.min(F.when(F.col("from_turn").isNotNull(), F.struct("level", (-F.col("from_turn")).alias("t")))).alias("reply"), F.min(F.when(F.col("from_conv") != F.col("conv_id"), F.col("from_conv"))).alias("quoted_conv"))

    # a turn's head: the last turn up to it that doesn't reply to the turn just before; it is rooted if that one replies to none
    by_conv = Window.partitionBy("conv_id").orderBy("turn")
    turns = of_turn.select("*", F.lag("turn").over(by_conv).alias("previous"))
    turns = turns.select("conv_id", "turn", "n_rows", "n_quotes", "n_linked", "quoted_conv", "previous", F.coalesce(-F.col("reply.t"), "previous").alias("reply_to"), F.coalesce(-F.col("reply.t"), F.when(F.col("n_linked") > 0, F.col("previous")), F.col("turn")).alias("up"))
    head = F.max(F.when(~F.col("up").eqNullSafe(F.col("previous")), F.col("turn"))).over(by_conv)
    root = F.max(F.when(F.col("up") == F.col("turn"), F.col("turn"))).over(by_conv)
    turns = written(turns.select("*", head.alias("head"), root.alias("root")).withColumn("rooted", F.col("head") == F.col("root")).drop("previous", "root"))

    # the turn that replies lead back to: each round doubles the distance, for those heads that have not arrived yet
    jumps = turns.where("turn = head and up <> turn").select("conv_id", F.col("turn").alias("from"), F.col("up").alias("turn"))
    up = cut(jumps.join(turns, ["conv_id", "turn"]).select("conv_id", "from", F.col("head").alias("up"), F.col("rooted").alias("there")))
    while not up.where("not there").isEmpty():
        further = up.select("conv_id", F.col("from").alias("up"), F.col("up").alias("next"), F.col("there").alias("arrives"))
        moved = up.where("not there").join(further, ["conv_id", "up"]).select("conv_id", "from", F.col("next").alias("up"), F.col("arrives").alias("there"))
        up = cut(up.where("there").unionByName(moved))
    if not up.isEmpty():
        turns = turns.join(up.select("conv_id", F.col("from").alias("head"), F.col("up").alias("thread")), ["conv_id", "head"], "left").withColumn("head", F.coalesce("thread", "head")).drop("thread")

    # turns are counted before texts come in: equal turns are put in order where they meet their text
    threads = Window.partitionBy("conv_id").orderBy("head", "turn")
    turns = turns.select("conv_id", "turn", "reply_to", "quoted_conv", "n_quotes", "n_linked", F.col("head").alias("thread"), (F.sum("n_rows").over(threads) - F.col("n_rows")).alias("before"))
    out = parsed.drop("lines").join(turns, ["conv_id", "turn"], "left")
    in_order = Window.partitionBy("conv_id", "turn").orderBy("own_text", "role")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", "own_text", "reply_to", "quoted_conv", zero("n_quotes"), zero("n_linked"), "thread", F.when(F.col("thread").isNotNull(), F.col("before") + F.row_number().over(in_order)).cast("long").alias("position"))
