"""State of incremental crawls: what each pair has, what is done, and where a paged scan may stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammerlake.operators import merging


def pair_state(stored: DataFrame, pairs: DataFrame, found: DataFrame, keys: Sequence[str], date: str, now: Column) -> DataFrame:
    """``(keys, n, latest, exhausted, checked)``: the state after a run that asked for ``pairs`` (keys, exhausted) and found rows.

    Pairs without rows are recorded too, so that they aren't asked again and again. latest never goes back; pairs that weren't
    asked keep their state.
    """
    got = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("latest"))
    new = pairs.join(got, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "latest", "exhausted", now.alias("checked"))
    old = stored.select(*keys, F.struct("n", "latest", "exhausted", "checked").alias("_old"))
    both = old.join(new, list(keys), "full_outer")
    asked = F.col("checked").isNotNull()
    pick = lambda c: F.when(asked, F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c)
    return both.select(*keys, pick("n"), F.greatest("latest", "_old.latest").alias("latest"), pick("exhausted"), pick("checked"))


def done_keys(rows: DataFrame, keys: Sequence[str], status: str, failed: Sequence[str], include_failed: bool = False) -> DataFrame:
    """Keys that need no further try: those with a status, but for failed ones unless they are to count as done."""
    known = rows.where(F.col(status).isNotNull())
    return (known if include_failed else known.where(~F.col(status).isin(*failed))).select(*keys).distinct()


def until_known(pages: DataFrame, keys: Sequence[str], page: str, date: str, mark: str, safety: int = 1) -> DataFrame:
    """Rows of pages up to the place where a scan may stop: behind ``safety`` + 1 pages in a row without anything newer than ``mark``.

    A date that can't be read may be new, and without a mark everything is. Pages are judged by their newest row.
    """
    new = F.col(mark).isNull() | ~F.coalesce(F.col(date).rlike(r"^\d{8}$"), F.lit(False)) | (F.col(date) > F.col(mark))
    by_page = pages.groupBy(*keys, page).agg(F.bool_or(new).alias("_new"))
    w = Window.partitionBy(*keys).orderBy(page)
    # pages since the last one with something newer, this one included; the first page beyond the safety ends the scan
    last = F.coalesce(F.max(F.when(F.col("_new"), F.col(page))).over(w), F.min(page).over(w) - 1)
    idle = by_page.withColumn("_idle", F.col(page) - last)
    stop = idle.where(F.col("_idle") > safety).groupBy(*keys).agg(F.min(page).alias("_stop"))
    return pages.join(stop, list(keys), "left").where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")


def trade_lists(prices: DataFrame, trades: DataFrame, keys: Sequence[str], on: Sequence[str], trusted: Sequence[str], most: int = 240) -> DataFrame:
    """``(keys, trades)``: the newest ``most`` confirmed trades of each listing whose building was matched with a trusted confidence."""
    pairs = prices.where(F.col("match_conf").isin(*trusted) & (F.coalesce(F.col(on[0]).cast("string"), F.lit("")) != "")).select(*keys, *on)
    rows = pairs.join(trades.where("deleted = 0"), list(on))
    w = Window.partitionBy(*keys).orderBy(F.desc("trade_ymd"), F.desc("price"))
    newest = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    return newest.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "trade_ymd", "price"))), lambda x: F.struct(x["trade_ymd"].alias("trade_ymd"), x["price"].alias("price"))).alias("trades"))


def labelled_steps(rounds: DataFrame, keys: Sequence[str], date: str, price: str, current: DataFrame) -> DataFrame:
    """``(keys, nth, date, price, label)``: the rounds at which the price changed, labelled by their number, and the current price
    (keys, date, price of ``current``) as the last step."""
    w = Window.partitionBy(*keys).orderBy(date, price)
    rows = rounds.where(F.col(price) > 0).withColumn("round", F.row_number().over(w)).withColumn("_b", F.lag(price).over(w)).where(~F.col("_b").eqNullSafe(F.col(price)))
    steps = rows.select(*keys, F.col(date).alias("date"), F.col(price).alias("price"), F.format_string("%d차", "round").alias("label"), F.lit(0).alias("_last"))
    now = current.select(*keys, F.col(date).alias("date"), F.col(price).alias("price"), F.lit("현재").alias("label"), F.lit(1).alias("_last"))
    every = steps.unionByName(now).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_last", "date", "price")))
    return every.select(*keys, "nth", "date", "price", "label")


def picks(rows: DataFrame, order: Sequence[Column], closed: Column, sent: DataFrame, keys: Sequence[str], now: Column, pool: int = 50, n: int = 5, days: int = 30) -> DataFrame:
    """The first ``n`` of the best ``pool`` rows that aren't closed and weren't sent within ``days`` (``sent``: keys, at)."""
    best = rows.orderBy(*order).limit(pool).where(~closed)
    recent = merging.latest(sent, keys, ["at"]).where(F.col("at") > now - F.make_interval(days=F.lit(days))).select(*keys)
    return best.join(recent, list(keys), "left_anti").orderBy(*order).limit(n)
