"""The gates that a scored table has to pass before it is served."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerlake.operators import gates
from hammerlake.plans.listings import KEY, SAME_SAME
from hammerlake.sources import records

# Limits of the gates, and codes that contradict housing.
MAX_RATIO, GRACE_DAYS, CANARY_SHARE, CANARY_ROWS = 2.5, 3, 0.90, 50
NOT_HOUSING = ["101", "211", "212", "221"]
APARTMENT, OFFICE = ("20104", "아파트"), ("20110", "오피스텔")
SIGNS = ["지분", "건물만", "대지권없", "대지권 없", "대지권미등기", "대지권 미등기"]


def _there(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def checks(scored: DataFrame, raw: DataFrame, rights: DataFrame, verified: DataFrame, today: str) -> dict:
    """The gates by name: each gives a table of its violations, with ``sample`` to name them; the last one a share.

    ``raw`` may have several rows for an item. ``verified`` has the keys whose prices come from the very building.
    """
    joined = scored.join(raw, KEY)
    priced, named = joined.where("est_market_price is not null"), F.col("case_no").alias("sample")
    note = F.concat(F.coalesce("mulBigo", F.lit("")), F.coalesce("alias", F.lit("")))

    def type_physical() -> DataFrame:
        building = reduce(lambda a, b: a | b, [_there(c) for c in records.BUILDING])
        groups = joined.where(F.col("property_type").isin(records.HOUSING)).groupBy(*KEY).agg(F.bool_or(building).alias("b"), F.bool_or(_there("jimokList")).alias("l"))
        return groups.where("not b and l").select(named)

    def code_and_type() -> DataFrame:
        code, kind = F.coalesce("sclsUtilCd", F.lit("")), F.col("property_type")
        crossed = ((code == APARTMENT[0]) & (kind == OFFICE[1])) | ((code == OFFICE[0]) & (kind == APARTMENT[1]))
        wrong = priced.where(kind.isin(records.HOUSING) & (F.substring(code, 1, 3).isin(NOT_HOUSING) | crossed))
        known = verified.select(*KEY).distinct().withColumn("_v", F.lit(True))
        return wrong.join(known, KEY, "left").where(F.col("_v").isNull() | ~F.coalesce(F.col("market_scope") == SAME_SAME, F.lit(False))).select(named)

    def rights_json() -> DataFrame:
        empty, broken = F.coalesce("case_no", F.lit("")) == "", F.try_parse_json(F.coalesce(F.nullif("schedule", F.lit("")), F.lit("[]"))).isNull()
        return rights.where(empty | broken).select(named)

    return {
        "type_physical": type_physical,
        "code_and_type": code_and_type,
        "extreme_estimate": lambda: scored.where(f"appraisal_price > 0 and est_market_price > appraisal_price * {MAX_RATIO}D").select(named),
        "no_orphans": lambda: scored.where("court <> ''").join(raw.select(*KEY).distinct(), KEY, "left_anti").select(named),
        "share_sale": lambda: priced.where(records.share_sale(F.col("maejibun"), F.col("mulBigo")) | reduce(lambda a, b: a | b, [F.contains(note, F.lit(s)) for s in SIGNS])).select(named),
        "stale_sale": lambda: scored.where((F.col("sale_date") != "") & (F.col("sale_date") < F.date_format(F.date_sub(F.lit(today).cast("date"), GRACE_DAYS), "yyyy-MM-dd"))).select(named),
        "keys_and_prices": lambda: scored.where("case_no = '' or min_bid_price <= 0").select(named),
        "rights_json": rights_json,
        "band_order": lambda: scored.where("market_band_low > market_band_high or profit_low > profit_high").select(named),
        "field_canary": lambda: scored,
    }


def run(scored: DataFrame, raw: DataFrame, rights: DataFrame, verified: DataFrame, today: str) -> DataFrame:
    """``(gate, violations, ok)`` of every gate; one that can't be run has failed."""
    every = checks(scored, raw, rights, verified, today)
    canary = lambda: gates.least_share("field_canary", every["field_canary"](), [F.col("appraisal_price") > 0, F.col("min_bid_price") > 0], CANARY_SHARE, CANARY_ROWS)
    plain = {name: (lambda f=f, name=name: gates.violations(name, f())) for name, f in every.items() if name != "field_canary"}
    return gates.run(scored.sparkSession, plain | {"field_canary": canary})


def samples(scored: DataFrame, raw: DataFrame, rights: DataFrame, verified: DataFrame, today: str, most: int = 5) -> DataFrame:
    """``(gate, sample)``: the first ``most`` case numbers that violate each gate."""
    every = checks(scored, raw, rights, verified, today)
    return gates.samples({name: gate() for name, gate in every.items() if name != "field_canary"}, most)
