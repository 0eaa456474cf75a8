"""Sales that are over: what they may be compared with, searches and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerlake.functions import text
from hammerlake.plans.listings import SAME_SAME, UNKNOWN

# The only scope that is trusted, the share of the appraisal below which a sale isn't an ordinary one, and what a distrusted row loses.
TRUSTED, ABNORMAL = [SAME_SAME], 0.30
DERIVED = ["est_market_price", "market_band_low", "profit_low", "expected_profit", "matched_trades", "confidence", "arb_score"]


def trusted() -> Column:
    """Whether a row's market price comes from its own building; an unknown scope is not trusted."""
    return F.trim(F.coalesce("market_scope", F.lit(""))).isin(TRUSTED)


def comparable() -> Column:
    """Whether a sale's price may be compared with the market; where the appraisal isn't known nothing is barred."""
    ratio = F.when((F.col("appraisal_price") != 0) & (F.col("sold_price") != 0), F.col("sold_price") / F.col("appraisal_price"))
    return ratio.isNull() | (ratio >= ABNORMAL)


def gap() -> Column:
    """The market's low end less the price of the sale; null where that can't be compared."""
    return F.when(trusted() & comparable(), F.col("market_band_low") - F.col("sold_price"))


def rate() -> Column:
    return F.when((F.col("appraisal_price") != 0) & (F.col("sold_price") != 0), F.col("sold_price") / F.col("appraisal_price"))


def market_policy(rows: DataFrame) -> DataFrame:
    """``rows`` whose market price isn't trusted lose all that was derived from it, and their grade says so; rows without one stay."""
    lost = ~trusted() & (F.col("est_market_price").isNotNull() | F.col("market_band_low").isNotNull())
    new = {c: F.when(~lost, F.col(c)).alias(c) for c in DERIVED} | {"grade": F.when(lost, UNKNOWN).otherwise(F.col("grade")).alias("grade")}
    return rows.select(*[new.get(c, F.col(f"`{c}`")) for c in rows.columns])


def search(rows: DataFrame, words: str | None = None, region: str | None = None, kind: str | None = None, bid: tuple[int | None, int | None] = (None, None), area: tuple[float | None, float | None] = (None, None), fails: int | None = None) -> DataFrame:
    """The rows that all given conditions hold for; words may be a case number, a price or area that isn't known holds for none."""
    hay = F.concat_ws(" ", "apt_name", "address", "case_no")
    conditions = [
        words and text.contains_squeezed(hay, words),
        kind and F.col("property_type") == kind,
        region and text.in_region(F.col("address"), region),
        area[0] is not None and F.col("area_m2") >= area[0],
        area[1] is not None and F.col("area_m2") < area[1],
        fails is not None and F.coalesce("fail_count", F.lit(0)) >= fails,
        bid[1] is not None and (F.col("min_bid_price") > 0) & (F.col("min_bid_price") <= bid[1]),
        bid[0] is not None and (F.col("min_bid_price") > 0) & (F.col("min_bid_price") >= bid[0]),
    ]
    for c in conditions:
        rows = rows.where(c) if isinstance(c, Column) else rows
    return rows


ORDERS = {
    "recent": lambda: F.nullif(F.col("sale_date"), F.lit("")).desc_nulls_last(),
    "old": lambda: F.nullif(F.col("sale_date"), F.lit("")).asc_nulls_last(),
    "price": lambda: F.col("sold_price").desc_nulls_last(),
    "price_asc": lambda: F.col("sold_price").asc_nulls_last(),
    "rate": lambda: rate().asc_nulls_last(),
    "profit": lambda: gap().desc_nulls_last(),
    "profit_asc": lambda: gap().asc_nulls_last(),
    "score": lambda: F.col("arb_score").desc_nulls_last(),
    "score_asc": lambda: F.col("arb_score").asc_nulls_last(),
}


def order_by(key: str) -> list[Column]:
    """One of the orders, what has no value last, with the key as the last word; an unknown name is the newest first."""
    return [ORDERS.get(key, ORDERS["recent"])(), F.col("court"), F.col("case_no"), F.col("item_no")]


def order_means_something(rows: DataFrame, key: str) -> bool:
    """Whether any row has a value to order by: a list without one must not look ordered."""
    value = {"profit": gap, "profit_asc": gap, "score": lambda: F.col("arb_score"), "score_asc": lambda: F.col("arb_score"), "price": lambda: F.col("sold_price"), "price_asc": lambda: F.col("sold_price")}.get(key)
    return value is None or not rows.where(value().isNotNull()).isEmpty()


def newest(rows: DataFrame, n: int = 200, priced_first: bool = True) -> DataFrame:
    """The first ``n`` closed sales: those with a known price before the others, newest first."""
    by_price = [F.col("sold_price").isNull()] if priced_first else []
    return rows.orderBy(*by_price, F.desc("sale_date"), "court", "case_no", "item_no").limit(n)
