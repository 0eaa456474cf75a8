"""Language identification as a mixture: EM over n-gram likelihoods, and a penalised choice of the language set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import pick, slices

#: Letters in an n-gram, and the number of buckets that n-grams are hashed to; this bounds the model's size.
GRAM, BUCKETS = 3, 1 << 15
#: Bound of the sample that the model is fitted on: about so many documents of each language at most.
SAMPLE_PER_LANGUAGE = 4000
#: Added to each count of an n-gram.
SMOOTHING = 0.5
#: EM ends when no share moves by more, or after so many rounds.
TOLERANCE, ROUNDS = 1e-3, 30
#: What one more language must add to the log-likelihood, times the logarithm of the number of n-grams.
PENALTY = 4.0
UNKNOWN = "und"


_tables: dict[str, np.ndarray] = {}


def letters_only(points: np.ndarray) -> np.ndarray:
    """True for code points that are letters."""
    if not _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letter"][points]


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a lower-cased text; what is not a letter is one space; none if there are no letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters_only(points)
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    kept = np.concatenate([[True], letter[1:] | letter[:-1]])  # of several others in a row, one
    points = np.concatenate([[32], points[kept], [32]]).astype(np.uint64)
    n = max(1, len(points) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the documents of a task, by language and bucket."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            of = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            of += np.bincount(grams(text.as_py()), minlength=BUCKETS)
    for lang, of in total.items():
        at = np.flatnonzero(of)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(of[at])], ["lang", "bucket", "n"])


class Model:
    """Log-likelihoods of buckets in each language; ``languages`` are the learned values, sorted."""

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({lang for lang, _, _ in counts})
        table = np.full((len(self.languages), BUCKETS), SMOOTHING)
        for lang, bucket, n in counts:
            table[self.languages.index(lang), bucket] += n
        self.log = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket x language

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], bool]:
        """The languages of a text with their shares, largest first (ties by name); False if it has no letters."""
        found = grams(text or "")
        if not len(found) or not self.languages:
            return [], bool(len(found))
        bucket, n = np.unique(found, return_counts=True)
        log = self.log[bucket].astype(np.float64)
        top = log.max(axis=1, keepdims=True)
        like, total = np.exp(log - top), float(n.sum())

        def fit(chosen: list[int]) -> tuple[np.ndarray, float]:
            own = like[:, chosen]
            share = np.full(len(chosen), 1 / len(chosen))
            for _ in range(ROUNDS if len(chosen) > 1 else 0):
                of = own * share
                new = (n @ (of / of.sum(axis=1, keepdims=True))) / total
                moved = np.abs(new - share).max()
                share = new
                if moved < TOLERANCE:
                    break
            return share, float(n @ np.log(own @ share))

        one_by_one = n @ log
        best = int(one_by_one.argmax())
        chosen, (share, value) = [best], fit([best])
        rest = [k for k in np.argsort(-one_by_one, kind="stable").tolist() if k != best]
        if rest:
            # shares with all languages say which one to try next
            everything, limit = fit([best, *rest])
            order = [k for _, k in sorted(zip((-everything[1:]).tolist(), rest))]
            cost = PENALTY * np.log(total + 1)
            for k in order if limit - value > cost else []:
                new_share, new_value = fit([*chosen, k])
                if new_value - value <= cost:
                    break
                chosen, share, value = [*chosen, k], new_share, new_value
        found_here = sorted(((self.languages[k], float(s)) for k, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))
        return found_here, True


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows whose lang is not null and whose crc32(doc_id as text) mod 3 is not 1.

    Of a language with more than ``SAMPLE_PER_LANGUAGE`` such rows, a share of that size is taken by a hash of
    doc_id, so that the sample is bounded and needs no sort. What reaches the driver are ``BUCKETS`` counts for
    each language at most.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([])
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n))) for k, n in sizes.items()])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < rate * (1 << 20))
    counts = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` for each row, from its whole text alone.

    languages are (lang, share) of the set with the best penalised likelihood, largest share first; lang_pred is
    the first one and score its share. Texts that are null or without letters, and all texts if nothing could be
    learned, are ``und`` with score 0 and no languages. A null doc_id is not held out. Repeated rows are each
    returned; an empty table gives no rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.mixture(t.as_py())[0] for t in part.column("text")]
                yield pa.record_batch([
                    part.column("doc_id"),
                    pa.array([x[0][0] if x else UNKNOWN for x in found], pa.string()),
                    pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                    pa.array([[{"lang": k, "share": s} for k, s in x] for x in found], kind),
                ], ["doc_id", "lang_pred", "score", "languages"])

    out = pick(docs, id_col, text_col).mapInArrow(predict, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts whose language is unknown; a null lang becomes the prediction.

    ``docs`` has text and lang, and any other columns, which stay as they are. Null and empty texts and those without
    letters go, as all do where nothing could be learned; repeated rows and null ids stay. An empty table gives no rows.
    """
    names = docs.columns
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.mixture(t.as_py())[0] for t in part.column("text")]
                columns = dict(zip(names, part.columns))
                columns["lang"] = pa.array([a if a is not None else (x[0][0] if x else None) for a, x in zip(columns["lang"].to_pylist(), found)], pa.string())
                yield pa.record_batch([columns[k] for k in names], names).filter(pa.array([bool(x) for x in found], pa.bool_()))

    return docs.mapInArrow(predict, layout)
