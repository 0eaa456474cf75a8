"""Counts, groups and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_sum(value: Column, digits: int = 2) -> Column:
    """A sum of decimals, the same in any order."""
    return F.sum(value.cast(f"decimal(18,{digits})"))


def exact_avg(value: Column, digits: int = 2) -> Column:
    """A mean of ``digits`` exact decimals, as a double; null without values."""
    return exact_sum(value, digits).cast("double") / F.nullif(F.count(value), F.lit(0))


def zero_filled(counts: DataFrame, bucket: str, buckets: int) -> DataFrame:
    """All of ``buckets`` from 0 on, with 0 for those that ``(bucket, n)`` lacks."""
    all_of = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias(bucket))
    return all_of.join(counts, bucket, "left").select(bucket, F.coalesce("n", F.lit(0)).alias("n"))


def histogram(rows: DataFrame, value: Column, width: float, buckets: int) -> DataFrame:
    """``(bucket, n)``; the last bucket takes its upper bound too, and nulls are in none."""
    b = F.greatest(F.lit(0), F.least(F.floor(value / width), F.lit(buckets - 1))).cast("int")
    return zero_filled(rows.select(b.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", buckets)


def capped_counts(rows: DataFrame, value: Column, cap: int) -> DataFrame:
    """``(bucket, n)`` for 0 to ``cap``, which stands for all above."""
    return zero_filled(rows.select(F.least(value, F.lit(cap)).cast("int").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", cap + 1)


def calendar(rows: DataFrame, date: Column) -> DataFrame:
    """``(month, day, n)``: days, months (day null) and all (both null); rows without a date are left out."""
    days = rows.select(F.date_format(date, "yyyy-MM").alias("month"), F.date_format(date, "yyyy-MM-dd").alias("day")).where("day is not null")
    return days.rollup("month", "day").agg(F.count(F.lit(1)).alias("n"))


def majority(rows: DataFrame, key: str, verdict: str, tied: str = "unstable") -> DataFrame:
    """``(key, verdict, votes)``: the most frequent verdict, or ``tied`` if there are several."""
    votes = rows.groupBy(key, verdict).agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy(key).agg(F.max("n").alias("votes"))
    best = votes.join(top, key).where(F.col("n") == F.col("votes")).groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.min(verdict).alias("v"), F.max("votes").alias("votes"))
    return best.select(key, F.when(F.col("k") > 1, F.lit(tied)).otherwise(F.col("v")).alias(verdict), "votes")


def key_profile(rows: DataFrame, json: str) -> DataFrame:
    """``(key, present, filled)`` of the keys of JSON objects."""
    pairs = rows.select(F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("present"), F.count(F.when(F.col("value") != "", F.lit(1))).alias("filled"))


def dataset_fingerprint(rows: DataFrame, columns: Sequence[str], newest: str) -> DataFrame:
    """One row: number of rows, newest value, and a sum of checksums (the first 32 bits of MD5) that no order changes."""
    checksum = F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("newest"), F.sum(checksum).alias("checksum"))


def differences(stored: DataFrame, computed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(column, compared, different)`` for columns of two tables, joined by key."""
    both = stored.select(*keys, F.struct(*columns).alias("a")).join(computed.select(*keys, F.struct(*columns).alias("b")), list(keys))
    sums = both.agg(F.count(F.lit(1)).alias("compared"), *[F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"_{c}") for c in columns])
    return sums.select("compared", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"_{c}") for c in columns]))).alias("column", "different")).select("column", "compared", "different")


def doubled(text: Column, least: int = 10) -> Column:
    """Whether a text is the same words twice, white space aside; null for texts without any, which tell nothing."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    half = F.floor(F.length(t) / 2).cast("int")
    first, second = F.trim(F.substring(t, F.lit(1), half)), F.trim(F.substring(t, half + 1, F.length(t)))
    return F.when(t != "", (F.length(t) >= least) & (first == second))


def fidelity(stored: DataFrame, computed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(column, compared, testable, different, doubled, verdict)``: what is stored against what its source gives now.

    Texts are equal if their words are; a null number is 0. A column without any value to test is 'undecidable': nothing wrong
    was found in it because there was nothing to look at. Otherwise it is 'ok' or 'wrong'.
    """
    def norm(c: str, side: str) -> Column:
        x = F.col(f"{side}.{c}")
        if stored.schema[c].dataType.typeName() == "string":
            return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
        return F.coalesce(x, F.lit(0))

    both = stored.select(*keys, F.struct(*columns).alias("a")).join(computed.select(*keys, F.struct(*columns).alias("b")), list(keys))

    def of(c: str) -> Column:
        a, b = norm(c, "a"), norm(c, "b")
        some = (a != "") | (b != "") if stored.schema[c].dataType.typeName() == "string" else (a != 0) | (b != 0)
        twice = F.coalesce(doubled(F.col(f"a.{c}")), F.lit(False)) if stored.schema[c].dataType.typeName() == "string" else F.lit(False)
        return F.struct(F.lit(c).alias("column"), some.alias("testable"), (a != b).alias("different"), twice.alias("doubled"))

    each = both.select(F.explode(F.array(*map(of, columns))).alias("x")).select("x.*")
    sums = each.groupBy("column").agg(F.count(F.lit(1)).alias("compared"), *[F.count_if(c).alias(c) for c in ("testable", "different", "doubled")])
    verdict = F.when(F.col("testable") == 0, "undecidable").when((F.col("different") > 0) | (F.col("doubled") > 0), "wrong").otherwise("ok")
    return sums.select("*", verdict.alias("verdict"))


def unread_keys(rows: DataFrame, body: str, parsed: Sequence[str]) -> DataFrame:
    """``(key, n)``: the keys of JSON objects that have values and that no parser reads."""
    pairs = rows.select(F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))
    return pairs.where(F.trim(F.coalesce("value", F.lit(""))).isin("", "[]", "{}") == F.lit(False)).where(~F.col("key").isin(*parsed)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
