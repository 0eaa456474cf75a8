"""Asking prices that people write into files: what can't be one is put aside with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Why an element is refused.
NOT_AN_OBJECT, NO_LIST, NO_ELEMENT, NO_PRICE, NOT_POSITIVE = "not an object", "not a list", "not an object in the list", "no number as price", "price not above zero"


def _text(element: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(element, f"$.{key}"), F.lit(""))


def asking_prices(files: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(case_no, nth, price, label, observed_at)`` and ``(case_no, nth, element, reason)`` of files: one text each, a JSON object of
    lists by case.

    An element counts if its price is a number above zero (a decimal one is cut; true and quoted numbers are none). The others, lists that
    aren't lists and files that can't be read are refused, each with its reason; a file that is refused gives no prices. nth is the place in the list,
    from 0. Null and empty files give nothing.
    """
    text, none = F.trim(F.col(body)), F.lit(None).cast("string")
    known = files.where(text != "").select(text.alias("value"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).alias("cases"))
    good = F.coalesce(F.col("value").startswith("{") & F.col("cases").isNotNull() & F.try_parse_json("value").isNotNull(), F.lit(False))
    one = lambda case, element, why: F.struct(case.alias("case_no"), F.lit(None).cast("int").alias("nth"), element.alias("element"), why.alias("why"))

    def listed(x: Column) -> Column:
        each = F.transform(F.from_json(x["value"], "array<string>"), lambda e, i: F.struct(x["key"].alias("case_no"), i.alias("nth"), e.alias("element"), none.alias("why")))
        return F.when(F.coalesce(F.trim(x["value"]).startswith("["), F.lit(False)), F.coalesce(each, F.array().cast("array<struct<case_no: string, nth: int, element: string, why: string>>"))).otherwise(F.array(one(x["key"], x["value"], F.lit(NO_LIST))))

    # a file is read once: what can't be a list of elements is one element with its reason
    opened = F.when(good, F.flatten(F.transform(F.map_entries("cases"), listed))).otherwise(F.array(one(none, F.col("value"), F.lit(NOT_AN_OBJECT))))
    each = known.select(F.explode(opened).alias("_e")).select("_e.*").withColumn("_v", F.when(F.col("why").isNull(), F.try_parse_json("element")))
    each = each.withColumns({"_kind": F.schema_of_variant(F.try_variant_get("_v", "$.price", "variant")), "_number": F.try_variant_get("_v", "$.price", "double")})
    is_number = F.coalesce(F.col("_kind").rlike(r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    reason = F.when(F.col("why").isNotNull(), F.col("why")).when(~F.coalesce(F.trim("element").startswith("{"), F.lit(False)), NO_ELEMENT).when(~is_number, NO_PRICE).when(~(F.col("_number") > 0), NOT_POSITIVE)
    judged = each.select("case_no", "nth", "element", F.when(is_number, F.col("_number")).cast("bigint").alias("price"), reason.alias("reason"))
    prices = judged.where("reason is null").select("case_no", "nth", "price", _text(F.col("element"), "label").alias("label"), _text(F.col("element"), "observed_at").alias("observed_at"))
    return prices, judged.where("reason is not null").select("case_no", "nth", "element", "reason")


def against_band(prices: DataFrame, bands: DataFrame, key: str = "case_no") -> DataFrame:
    """``(key, nth, price, place, under)``: asking prices below, inside or above their band (key, band_low, band_high), the highest first.

    under tells whether the lowest of a case is below its band. Without a band, place and under are null.
    """
    from pyspark.sql import Window

    place = F.when(F.col("price") < F.col("band_low"), "below").when(F.col("price") > F.col("band_high"), "above").when(F.col("band_low").isNotNull() & F.col("band_high").isNotNull(), "inside")
    rows = prices.join(bands.select(key, "band_low", "band_high"), key, "left")
    by_key = Window.partitionBy(key)
    nth = F.row_number().over(by_key.orderBy(F.desc("price"), "nth")).alias("rank")
    return rows.select(key, "nth", "price", place.alias("place"), (F.min("price").over(by_key) < F.col("band_low")).alias("under"), nth)
