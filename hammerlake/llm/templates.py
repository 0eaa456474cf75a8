"""Benchmark passages in documents, found through templates with typed placeholders; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import cut, pick

#: Words in a window, and the share of an item's windows that must be found close together.
WINDOW_WORDS, MIN_COVERAGE = 5, 0.8
#: Words by which a place may leave its alignment, if the alignment without limit isn't consistent.
DRIFT_WORDS = 5
#: Windows of the benchmark, and ids of documents that may hold an item, that may be sent to every executor (some
#: 40 bytes each); more are shuffled.
BROADCAST_ROWS = 200_000
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
# Words for numbers, and units of measure, in English, German, French and Spanish.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million"]
NUMBER_WORDS += ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "zwanzig", "dreißig", "vierzig", "fünfzig", "hundert", "tausend", "millionen"]
NUMBER_WORDS += ["zéro", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "vingt", "trente", "quarante", "cinquante", "mille", "millions"]
NUMBER_WORDS += ["cero", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "doce", "veinte", "treinta", "cuarenta", "cincuenta", "cien", "mil", "millones"]
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hr", "hz", "v", "w", "kw", "inch", "inches", "foot", "feet", "ft", "mile", "miles", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "gram", "grams", "kilograms", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "usd", "eur"]
UNITS += ["kilometer", "gramm", "kilogramm", "pfund", "sekunde", "sekunden", "minuten", "stunde", "stunden", "tag", "tage", "woche", "wochen", "monat", "monate", "jahr", "jahre", "prozent"]
UNITS += ["mètre", "mètres", "kilomètres", "gramme", "grammes", "kilogrammes", "seconde", "secondes", "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans", "année", "années", "centimes"]
UNITS += ["metro", "metros", "kilómetros", "gramo", "gramos", "kilogramos", "litro", "litros", "segundo", "segundos", "minuto", "minutos", "hora", "horas", "día", "días", "semana", "semanas", "mes", "meses", "año", "años", "dólares", "céntimos"]
#: Before a capital within a sentence, and before one that begins a sentence or line.
_MARK, _START = "\x02", "\x03"
#: The share of an item's words that are no slots, from which equal numbers of the item may stand for different ones.
MIN_LITERAL = 0.5


def words(text: Column) -> Column:
    """The words and numbers of a text in lower case; a capital leaves a mark, another one where it begins a sentence or line."""
    marked = F.regexp_replace(text, r" (?<=[^.!?:\s] )(?=\p{Lu})", " " + _MARK)
    marked = F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{N}}{_MARK}])(?=\p{{Lu}})", _START)
    # by way of upper case, as sharp s and final sigma have two forms; Spark drops the inner one of two bare changes
    marked = F.lower(F.concat(F.upper(marked), F.lit("")))
    return F.coalesce(F.regexp_extract_all(marked, F.lit(rf"[{_MARK}{_START}]?(?:\d+(?:[.,]\d+)*|\p{{L}}+)"), F.lit(0)), F.array().cast("array<string>"))


def _bare(word: Column) -> Column:
    return F.ltrim(word, F.lit(_MARK + _START))


def canonical(rows: DataFrame, *keys: str, of: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(keys, plain, typed, open) of rows (keys, raw): ``of`` the words of ``words``, with placeholders for numbers and units
    behind a number; typed has placeholders for names too, which need the text's capitals, and open also for all words that begin a sentence."""

    def is_number(x: Column) -> Column:
        return F.substring(x, 1, 1).between("0", "9") | x.isin(NUMBER_WORDS)

    def one(x: Column, i: Column) -> Column:
        behind = F.coalesce(is_number(F.get("bare", i - 1)), F.lit(False))
        return F.when(is_number(x), NUMBER).when(x.isin(UNITS) & behind, UNIT).otherwise(x)

    def named(marks: str) -> Column:
        return F.transform("raw", lambda x, i: F.when(F.substring(x, 1, 1).isin(*marks), of(F.lit(NAME))).otherwise(F.get("plain", i)))

    bare = rows.select(*keys, "raw", F.transform("raw", _bare).alias("bare"))
    plain = bare.select(*keys, "raw", F.transform("bare", lambda x, i: of(one(x, i))).alias("plain"))
    return plain.select(*keys, "plain", named(_MARK).alias("typed"), named(_MARK + _START).alias("open"))


def _windows(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, window) of rows (keys, plain, typed, open): a hash of the word hashes of each window, or of all if there
    are fewer. A window with names stands twice, typed and plain, and once more if a sentence begins in it.

    The window's hash is taken behind the generator, in generated code: no array of windows is built, and no row
    carries the words of its document.
    """
    spread = parsed.select(*keys, "plain", "typed", "open", F.posexplode(F.slice("plain", 1, F.greatest(F.size("plain") - (WINDOW_WORDS - 1), F.lit(1)))).alias("pos", "_"))
    window = lambda c: F.xxhash64(*[F.get(c, F.col("pos") + k) for k in range(WINDOW_WORDS)])
    each = spread.select(*keys, "pos", window("plain").alias("p"), window("typed").alias("t_"), window("open").alias("o"))
    several = F.when(F.col("p") == F.col("o"), F.array("p")).when(F.col("p") == F.col("t_"), F.array("p", "o")).when(F.col("t_") == F.col("o"), F.array("p", "t_")).otherwise(F.array("p", "t_", "o"))
    return each.select(*keys, "pos", F.explode(several).alias("window"))


def _slot_kinds(items: DataFrame) -> DataFrame:
    """(item_id, raw, kinds, literal): the kind of slot that each word of an item is, or null; and the share of those that are none.

    A word that begins a sentence is a name if the item has it within a sentence too.
    """
    rows = items.join(canonical(items, "item_id"), "item_id")
    names = F.transform(F.filter("raw", lambda x: x.startswith(_MARK)), _bare)
    rows = rows.select("item_id", "raw", "typed", names.alias("names"))
    kinds = F.transform("raw", lambda x, i: F.when(x.startswith(_START) & F.array_contains("names", _bare(x)), NAME).when(F.get("typed", i).isin(NUMBER, NAME, UNIT), F.get("typed", i)))
    rows = rows.select("item_id", "raw", kinds.alias("kinds"))
    return rows.select("*", (F.size(F.filter("kinds", lambda x: x.isNull())) / F.size("kinds")).alias("literal"))


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    return canonical(rows.select(*keys, words(F.col("text")).alias("raw")), *keys, of=F.xxhash64)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, n_slots, verbatim, consistent`` for each benchmark item that a whole text holds.

    Numbers, names (capitals) and units behind numbers become placeholders, case and punctuation
    go. Windows are met in up to three readings: with names as words, so that a copy in upper, lower or title case is
    found; with placeholders for the capitals within sentences; and with placeholders for those that begin one too, as
    they may be names. An item is found where ``MIN_COVERAGE`` of its windows of ``WINDOW_WORDS`` words stand within
    twice its length, if its slots are consistent: one name of the item always stands for one name of the document, so a
    question whose parameters were exchanged is caught, and prose that only shares its frame is not. So do numbers and
    units; but where ``MIN_LITERAL`` of the item's words are no slots, numbers that are equal by chance may become
    different ones, and consistent is false. verbatim tells whether all slots have the item's own values. Slots are read
    along an alignment: of the places of a window that occurs several times, the one nearest to it counts. Of several
    places the best covered one is reported.

    Only windows meet in the join; the words of the few documents that hold enough of an item are then looked at
    again for the slots. Items of equal text are one, under their smallest id.

    Null and empty texts and items without words match nothing; shorter ones than a window match whole. Rows that
    repeat are one; a null id matches nothing. Empty tables give no rows.
    """
    items = pick(benchmark, item_col, item_text_col).where("doc_id is not null and text is not null").groupBy("text").agg(F.min("doc_id").alias("item_id"))
    items = items.select("item_id", words(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    items = cut(items)
    index = _windows(canonical(items, "item_id", of=F.xxhash64), "item_id")
    slotted = cut(_slot_kinds(items))
    sizes = items.select("item_id", F.greatest(F.size("raw") - (WINDOW_WORDS - 1), F.lit(1)).alias("of"))
    index = index.join(sizes, "item_id").select("window", "item_id", F.col("pos").alias("item_pos"), "of")
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    rows = pick(docs, id_col, text_col).where("doc_id is not null and text is not null").withColumn("t", F.xxhash64("text"))
    met = _windows(_hashed(rows, "doc_id", "t"), "doc_id", "t").join(F.broadcast(index) if few else index, "window")
    # an item and its drift fit into one of two overlapping stretches, each as long as the item twice
    place = (F.col("pos") - F.col("item_pos")) / F.greatest(F.col("of"), F.lit(2 * WINDOW_WORDS))
    stretch = F.explode(F.array(F.floor(place), F.floor(place) + 1)).alias("stretch")
    met = met.select("doc_id", "t", "item_id", "of", "item_pos", "pos", stretch)
    held = met.groupBy("doc_id", "t", "item_id", "of", "stretch").agg(F.countDistinct("item_pos").alias("n"), F.collect_set(F.struct("pos", "item_pos")).alias("hits"))
    held = cut(held.where(F.col("n") >= MIN_COVERAGE * F.col("of")))

    suspects = held.select("doc_id", "t").distinct()
    suspects = F.broadcast(suspects) if suspects.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else suspects
    again = rows.join(suspects, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    again = cut(again.select("doc_id", "t", words(F.col("text")).alias("doc_raw")))
    looked = held.join(again, ["doc_id", "t"]).join(F.broadcast(slotted) if few else slotted, "item_id")

    def slots(hit: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.lit(WINDOW_WORDS - 1)), lambda k: F.get("kinds", hit["item_pos"] + k).isNotNull())
        return F.transform(at, lambda k: F.struct((F.get("kinds", hit["item_pos"] + k) == NAME).alias("name"), _bare(F.get("raw", hit["item_pos"] + k)).alias("of"), _bare(F.get("doc_raw", hit["pos"] + k)).alias("is")))

    # each diagonal of a stretch is an alignment: of an item position's hits, the one nearest to the diagonal counts
    places = F.transform("hits", lambda x: F.struct(x["item_pos"].alias("item_pos"), (x["pos"] - x["item_pos"]).alias("diagonal"), slots(x).alias("slots")))
    looked = looked.select("doc_id", "item_id", "of", "literal", places.alias("hits"))
    lines = looked.select("doc_id", "item_id", "of", "literal", "hits", F.explode(F.array_distinct(F.transform("hits", lambda x: x["diagonal"]))).alias("d"))
    by_nearness = F.array_sort(F.transform("hits", lambda x: F.struct(x["item_pos"].alias("item_pos"), F.abs(x["diagonal"] - F.col("d")).alias("off"), x["diagonal"].alias("diagonal"), x["slots"].alias("slots"))))
    lines = lines.select("doc_id", "item_id", "of", "literal", by_nearness.alias("hits"))
    lines = lines.select("doc_id", "item_id", "of", "literal", F.filter("hits", lambda x, i: ~F.get("hits", i - 1)["item_pos"].eqNullSafe(x["item_pos"])).alias("hits"))
    lines = lines.select("doc_id", "item_id", "of", "literal", F.explode(F.array("hits", F.filter("hits", lambda x: x["off"] <= DRIFT_WORDS))).alias("hits")).where(F.size("hits") >= MIN_COVERAGE * F.col("of"))
    looked = lines.select("doc_id", "item_id", "literal", (F.size("hits") / F.col("of")).alias("coverage"), F.array_distinct(F.flatten(F.transform("hits", lambda x: x["slots"]))).alias("pairs"))
    one_each = lambda of: F.size(F.array_distinct(F.transform(of, lambda x: x["of"]))) == F.size(of)
    looked = looked.withColumn("names_agree", one_each(F.filter("pairs", lambda x: x["name"]))).withColumn("consistent", one_each(F.filter("pairs", lambda x: ~x["name"])))
    placed = looked.where(f"names_agree and (consistent or literal >= {MIN_LITERAL})").select("doc_id", "item_id", "coverage", "consistent", F.size("pairs").alias("n_slots"), F.forall("pairs", lambda x: x["of"] == x["is"]).alias("verbatim"))
    best = placed.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "verbatim", "consistent", "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", F.col("b.n_slots").cast("long").alias("n_slots"), "b.verbatim", "b.consistent")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, inconsistent: bool = True) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows with a null doc_id or text stay, and all rows of one doc_id go together.

    With ``inconsistent``, hits count whose equal numbers became different ones (``consistent`` is false in ``find_leaks``): a
    question whose parameters were exchanged, or, less often, another one with the same frame. Without it these stay.
    ``docs`` has doc_id and text; its other columns and repeated rows stay as they are. Empty tables drop nothing.
    """
    found = find_leaks(docs, benchmark)
    leaked = (found if inconsistent else found.where("consistent")).select("doc_id").distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["doc_id"], "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
