"""Taxes and cash flows of a purchase."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds taxed as housing, and rates for tax, education and rural development.
HOUSING = ["아파트", "연립", "연립주택", "다세대", "다세대주택", "연립다세대", "빌라", "단독", "단독주택", "다가구", "다가구주택", "단독다가구", "주택"]
OTHER_RATES = (0.04, 0.004, 0.002)
SMALL_AREA = 85.0
#: Rural tax of large homes, by the surcharge.
RURAL = {0: 0.002, 8: 0.006, 12: 0.010}
#: Income tax: upper bounds of the base, rate, and deduction.
INCOME_BRACKETS = [(14_000_000, 0.06, 0), (50_000_000, 0.15, 1_260_000), (88_000_000, 0.24, 5_760_000), (150_000_000, 0.35, 15_440_000), (300_000_000, 0.38, 19_940_000), (500_000_000, 0.40, 25_940_000), (1_000_000_000, 0.42, 35_940_000), (None, 0.45, 65_940_000)]


def surcharge(houses: int = 1, regulated: bool = False, corporation: bool = False) -> int:
    """Per cent of the surcharged rate: 0, 8 or 12, for the number of houses that the buyer then has."""
    if corporation:
        return 12
    above = houses - (2 if regulated else 3)
    return 0 if above < 0 else 8 if above == 0 else 12


def housing_rate(price: Column) -> Column:
    """One per cent up to 600 million, three from 900 million on, and a straight line between."""
    return F.when(price <= 600_000_000, F.lit(0.01)).when(price <= 900_000_000, F.bround(price * 2 / F.lit(300_000_000.0) - 3, 4) / 100).otherwise(F.lit(0.03))


def _base_rate(price: Column, extra: int) -> Column:
    return F.lit(extra / 100) if extra else housing_rate(price)


def _acquisition_tax(price: Column, base: Column, kind: Column, area: Column, extra: int) -> Column:
    large = area > SMALL_AREA
    education = F.lit(0.004) if extra else base * 0.5 * 0.20
    rural = F.when(large, F.lit(RURAL[extra])).otherwise(F.lit(0.0))
    part = lambda rate: _won(price * rate)
    other = part(F.lit(OTHER_RATES[0])) + part(F.lit(OTHER_RATES[1])) + part(F.lit(OTHER_RATES[2]))
    return F.when(F.trim(F.coalesce(kind, F.lit(""))).isin(HOUSING), part(base) + part(education) + part(rural)).otherwise(other)


def acquisition_tax(price: Column, kind: Column, area: Column, houses: int = 1, regulated: bool = False, corporation: bool = False) -> Column:
    """Acquisition, education and rural tax together, each rounded half to even."""
    extra = surcharge(houses, regulated, corporation)
    return _acquisition_tax(price, _base_rate(price, extra), kind, area, extra)


# Stamp tax and agents' fees by price, the taxes of a sale, and what a simulation takes for granted.
STAMPS = [(10_000_000, 0), (30_000_000, 20_000), (50_000_000, 40_000), (100_000_000, 70_000), (1_000_000_000, 150_000), (None, 350_000)]
HOUSING_FEES = [(50_000_000, 0.006, 250_000), (200_000_000, 0.005, 800_000), (900_000_000, 0.004, None), (1_200_000_000, 0.005, None), (1_500_000_000, 0.006, None), (None, 0.007, None)]
OFFICE, OFFICE_FEE, OTHER_FEE = "오피스텔", 0.005, 0.009
BASIC_DEDUCTION, LOCAL_TAX, SHORT_TERM = 2_500_000, 0.10, {12: (0.70, 0.50), 24: (0.60, 0.40)}
LONG_TERM_YEARS, LONG_TERM_RATE, LONG_TERM_MOST, SURCHARGES = 3, 0.02, 0.30, {2: 0.20, 3: 0.30}
DEFAULTS = {"holding_months": 6, "assumed": 0, "eviction": 3_000_000, "repair": 0, "unpaid": 0, "registry": 500_000, "loan_share": 0.70, "loan_rate": 0.055, "mode": "dealer"}
MOST_LOAN = 0.80


#: How an amount is rounded to whole won.
Rounding = Callable[[Column], Column]


def _won(x: Column) -> Column:
    """A double to whole won, half to even."""
    return F.rint(x).cast("bigint")


def _first(cases: list[tuple[Column | None, Column]]) -> Column:
    out = None
    for cond, value in cases:
        out = value if cond is None and out is None else out.otherwise(value) if cond is None else F.when(cond, value) if out is None else out.when(cond, value)
    return out


def stamp_tax(price: Column) -> Column:
    return _first([(None if cap is None else price <= cap, F.lit(v).cast("bigint")) for cap, v in STAMPS])


def agent_fee(sale: Column, kind: Column, area: Column, won: Rounding = _won) -> Column:
    """An agent's highest fee for a sale: by brackets, some with a limit, for housing; a rate for small offices and for the rest."""
    of = lambda i: _first([(None if b[0] is None else sale < b[0], F.lit(b[i]).cast(("double", "bigint")[i - 1])) for b in HOUSING_FEES])
    housing = F.least(won(sale * of(1)), of(2))
    k = F.trim(F.coalesce(kind, F.lit("")))
    small = F.contains(k, F.lit(OFFICE)) & (area > 0) & (area <= SMALL_AREA)
    return F.when(sale <= 0, F.lit(0).cast("bigint")).when(k.isin(HOUSING), housing).when(small, won(sale * OFFICE_FEE)).otherwise(won(sale * OTHER_FEE))


def progressive(base: Column, more: float = 0.0, won: Rounding = _won) -> Column:
    """Progressive tax, with a surcharge on each bracket's rate; nothing on a loss."""
    of = lambda value: _first([(None if cap is None else base <= cap, F.lit(value(rate, less))) for cap, rate, less in INCOME_BRACKETS])
    zero = F.lit(0).cast("bigint")
    return F.when(base <= 0, zero).otherwise(F.greatest(zero, won(base * of(lambda rate, _: rate + more)) - of(lambda _, less: less)))


def _short_rate(months: Column, housing: Column) -> Column:
    """The flat rate of a sale within two years, or null."""
    return _first([(months < m, F.when(housing, F.lit(a)).otherwise(F.lit(b))) for m, (a, b) in SHORT_TERM.items()])


def sale_tax(sale: Column, bought: Column, narrow: Column, broad: Column, months: Column, kind: Column, mode: str = "dealer", houses: int = 1, regulated: bool = False, won: Rounding = _won) -> Column:
    """The tax of a sale with its local tax, for one who sells privately, as a dealer, or untaxed ('individual', 'dealer', 'none').

    A private sale is taxed by a flat rate within two years, else progressively behind a deduction for long holding; a dealer
    progressively, on what is left after all expenses. Several homes in a regulated area are surcharged: then there is no
    such deduction, and the highest of the candidates counts. A loss isn't taxed. ``won`` rounds.
    """
    tax = _national(sale - bought - narrow, F.greatest(F.lit(0).cast("bigint"), sale - bought - broad), months, kind, mode, houses, regulated, won)
    return tax + won(tax * LOCAL_TAX)


def _national(gain: Column, earned: Column, months: Column, kind: Column, mode: str, houses: int, regulated: bool, won: Rounding = _won) -> Column:
    """The tax of a sale without its local tax: of what is gained after the narrow expenses, or earned after all (a loss is 0)."""
    k = F.trim(F.coalesce(kind, F.lit("")))
    housing = k.isin(HOUSING) | F.contains(k, F.lit(OFFICE))
    extra = SURCHARGES[3 if houses >= 3 else 2] if regulated and houses >= 2 else None
    heavy = housing if extra is not None else F.lit(False)
    flat = _short_rate(months, housing)
    zero = F.lit(0).cast("bigint")
    if mode == "none":
        return zero
    surcharged = F.when(heavy, progressive(F.greatest(zero, gain - BASIC_DEDUCTION), extra or 0.0, won)).otherwise(zero)
    if mode == "dealer":
        own = progressive(earned, 0.0, won)
        short = F.when(heavy & flat.isNotNull(), won(F.greatest(zero, gain - BASIC_DEDUCTION) * flat)).otherwise(zero)
        return F.greatest(own, surcharged, short)
    years = F.floor(months / 12)
    long_term = F.when(heavy | flat.isNotNull() | (years < LONG_TERM_YEARS), F.lit(0.0)).otherwise(F.least(F.lit(LONG_TERM_MOST), years * LONG_TERM_RATE))
    base = F.greatest(zero, gain - won(gain * long_term) - BASIC_DEDUCTION)
    return F.when(gain <= 0, zero).otherwise(F.greatest(F.when(flat.isNotNull(), won(base * flat)).otherwise(progressive(base, 0.0, won)), surcharged))


def let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of named values that are computed once, however often it uses them: brackets would copy them into each of their cases."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), 1)


#: A part of a simulation: names values that it makes of those that are there.
Stage = Callable[[dict[str, Column]], dict[str, Column]]


def _staged(stages: list[Stage], there: dict[str, Column], then: Callable[[dict[str, Column]], Column]) -> Column:
    """``then`` of what the stages name, each bound by ``let``."""
    if not stages:
        return then(there)
    named = stages[0](there)
    return let(named, lambda g: _staged(stages[1:], {**there, **{k: g[k] for k in named}}, then))


def _facts(sale: Column, kind: Column, area: Column, over: dict) -> Stage:
    """What is known of a purchase before a bid."""
    given = {**DEFAULTS, **over}
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    at_least = lambda k: F.greatest(F.lit(0), value(given[k]))
    shares = {"loan_share": F.least(F.lit(MOST_LOAN), F.greatest(F.lit(0.0), value(given["loan_share"]))), "loan_rate": F.greatest(F.lit(0.0), value(given["loan_rate"]))}
    return lambda _: {"sale": sale.cast("bigint"), "kind": F.trim(F.coalesce(kind, F.lit(""))), "area": area.cast("double"), "months": at_least("holding_months"), "registry": at_least("registry"), "assumed": at_least("assumed"), "other": at_least("assumed") + at_least("eviction") + at_least("repair") + at_least("unpaid"), **shares}


def _fee(x: dict[str, Column]) -> dict[str, Column]:
    return {"fee": agent_fee(x["sale"], x["kind"], x["area"])}


def _costs(houses: int, regulated: bool, corporation: bool) -> list[Stage]:
    """What a bid costs."""
    extra = surcharge(houses, regulated, corporation)
    return [
        lambda x: {"rate": _base_rate(x["bid"], extra)},
        lambda x: {"taxed": _acquisition_tax(x["bid"], x["rate"], x["kind"], x["area"], extra), "stamp": stamp_tax(x["bid"]), "loan": _won(x["bid"] * x["loan_share"])},
        lambda x: {"interest": _won(x["loan"] * x["loan_rate"] * x["months"] / 12), "total": x["bid"] + x["taxed"] + x["stamp"] + x["registry"] + x["other"]},
    ]


def _taxes(houses: int, regulated: bool, mode: str) -> list[Stage]:
    """What the sale is taxed, as ``sale_tax`` says."""

    def spent(x: dict[str, Column]) -> dict[str, Column]:
        narrow = x["taxed"] + x["stamp"] + x["registry"] + x["fee"]
        own = x["sale"] - x["bid"]
        return {"gain": own - (narrow if mode == "individual" else narrow + x["assumed"]), "earned": F.greatest(F.lit(0).cast("bigint"), own - (narrow + x["other"] + x["interest"]))}

    national = lambda x: _national(x["gain"], x["earned"], x["months"], x["kind"], mode, houses, regulated)
    return [spent, lambda x: {"national": national(x)}, lambda x: {"tax": x["national"] + _won(x["national"] * LOCAL_TAX)}]


def _untaxed(x: dict[str, Column]) -> Column:
    """What a sale leaves before its tax."""
    return x["sale"] - x["total"] - x["interest"] - x["fee"]


def _left(x: dict[str, Column]) -> dict[str, Column]:
    net, equity = _untaxed(x) - x["tax"], x["total"] - x["loan"]
    named = {"acquisition_tax": x["taxed"], "total": x["total"], "equity": equity, "interest": x["interest"], "fee": x["fee"], "tax": x["tax"], "net": net}
    return {**{k: v.cast("bigint") for k, v in named.items()}, "roi": F.when(equity > 0, net / equity)}


def _simulation(sale: Column, kind: Column, area: Column, houses: int, regulated: bool, corporation: bool, over: dict) -> tuple[list[Stage], list[Stage]]:
    """What is known before a bid, and what follows from it."""
    return [_facts(sale, kind, area, over), _fee], [*_costs(houses, regulated, corporation), *_taxes(houses, regulated, over.get("mode", DEFAULTS["mode"]))]


def simulate(bid: Column, sale: Column, kind: Column, area: Column, houses: int = 1, regulated: bool = False, corporation: bool = False, **over) -> Column:
    """``(acquisition_tax, total, equity, interest, fee, tax, net, roi)`` of buying at ``bid`` and selling at ``sale``; ``over`` replaces
    ``DEFAULTS`` by columns or values. roi is null without own money in it."""
    known, stages = _simulation(sale, kind, area, houses, regulated, corporation, over)
    return _staged([lambda _: {"bid": bid.cast("bigint")}, *known, *stages], {}, lambda x: F.struct(*[v.alias(k) for k, v in _left(x).items()]))


def _with_stages(rows: DataFrame, into: str, stages: list[Stage], there: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with what the stages name as columns, and these by name: Spark compiles columns of columns, but reads the
    functions of ``let`` anew for each row."""
    for stage in stages:
        named = {f"_{into}_{k}": v for k, v in stage(there).items()}
        rows, there = rows.withColumns(named), {**there, **{k.removeprefix(f"_{into}_"): F.col(k) for k in named}}
    return rows, there


def simulated(rows: DataFrame, into: str, bid: Column, sale: Column, kind: Column, area: Column, houses: int = 1, regulated: bool = False, corporation: bool = False, **over) -> DataFrame:
    """``rows`` with the values of ``simulate`` as columns, named by ``into`` and their own names: for many rows.

    Two in a row make a function that is too large for the JVM to compile; what is between them in ``with_break_even`` keeps them apart.
    """
    known, stages = _simulation(sale, kind, area, houses, regulated, corporation, over)
    staged, x = _with_stages(rows, into, [lambda _: {"bid": bid.cast("bigint")}, *known, *stages], {})
    return staged.select(*rows.columns, *[v.alias(f"{into}{k}") for k, v in _left(x).items()])


def _lighter(houses: int, regulated: bool, over: dict) -> bool:
    """Whether a sale's tax is always less than what is left before it."""
    mode = over.get("mode", DEFAULTS["mode"])
    return mode == "none" or mode == "dealer" and not (regulated and houses >= min(SURCHARGES))


#: Most rounds of a search, and how many cuts a round has: the last one halves.
ROUNDS, CUTS = 40, 3


def break_even(sale: Column, kind: Column, area: Column, houses: int = 1, regulated: bool = False, corporation: bool = False, **over) -> Column:
    """The highest bid that still leaves a net profit (which falls as the bid rises); null if none does.

    The interval is cut where a straight line between its ends would have no profit, and halved at every third cut, so that
    few bids are simulated, and never more than thrice as many as by halving alone. An end that stays counts half, or the other one would creep.
    A tax that is less than what it is taken from leaves a profit wherever there was one: then no bid is taxed in the search.
    """
    mode, lighter = over.get("mode", DEFAULTS["mode"]), _lighter(houses, regulated, over)
    stages = [*_costs(houses, regulated, corporation), *([] if lighter else _taxes(houses, regulated, mode))]
    none = F.lit(None).cast("double")

    def search(x: dict[str, Column]) -> Column:
        profit = lambda b: _staged(stages, {**x, "bid": b}, lambda y: (_untaxed(y) if lighter else _untaxed(y) - y["tax"]).cast("double"))
        start = F.struct(F.lit(-1).cast("bigint").alias("lo"), (x["sale"] * 2 + 100_000_000).cast("bigint").alias("hi"), none.alias("gain"), none.alias("loss"))

        def cut(s: Column, i: Column) -> Column:
            straight = s["lo"] + F.floor((s["hi"] - s["lo"]) * (s["gain"] / (s["gain"] - s["loss"]))).cast("bigint")
            half = F.floor((s["lo"] + s["hi"]) / 2).cast("bigint")
            # no profit is left at a bid of the sale's price
            inner = F.when(s["loss"].isNull(), x["sale"]).when(i == CUTS, half).otherwise(F.coalesce(straight, half))
            bid = F.when(s["lo"] < 0, F.lit(0).cast("bigint")).otherwise(F.least(s["hi"] - 1, F.greatest(s["lo"] + 1, inner)))
            kept = lambda c: s[c] / 2
            above = lambda t: F.struct(t["bid"].alias("lo"), s["hi"].alias("hi"), t["left"].alias("gain"), kept("loss").alias("loss"))
            below = lambda t: F.struct(s["lo"].alias("lo"), t["bid"].alias("hi"), kept("gain").alias("gain"), t["left"].alias("loss"))
            tried = let({"bid": bid}, lambda b: let({"bid": b["bid"], "left": profit(b["bid"])}, lambda t: F.when(t["left"] > 0, above(t)).otherwise(below(t))))
            return F.when(done(s), s).otherwise(tried)

        done = lambda s: s["hi"] - s["lo"] <= 1
        cuts, rounds = (F.array(*[F.lit(i) for i in range(1, n + 1)]) for n in (CUTS, ROUNDS))
        return F.aggregate(rounds, start, lambda s, _: F.when(done(s), s).otherwise(F.aggregate(cuts, s, cut)), lambda s: F.when(s["lo"] >= 0, s["lo"]))

    return _staged([_facts(sale, kind, area, over), _fee], {}, search)


def _near_costs(bid: np.ndarray, housing: np.ndarray, large: np.ndarray, extra: int) -> np.ndarray:
    """``acquisition_tax`` and ``stamp_tax`` of bids; by a won or so wrong where a rate lies between two roundings."""
    base = extra / 100 if extra else np.where(bid <= 600_000_000, 0.01, np.where(bid <= 900_000_000, np.round(bid * 2 / 300_000_000.0 - 3, 4) / 100, 0.03))
    rates = base, 0.004 if extra else base * 0.5 * 0.20, np.where(large, RURAL[extra], 0.0)
    own, other = (sum(np.rint(bid * rate) for rate in r) for r in (rates, OTHER_RATES))
    stamps = np.array([v for _, v in STAMPS])[np.searchsorted([cap for cap, _ in STAMPS[:-1]], bid)]
    return np.where(housing, own, other) + stamps


def _near_most(extra: int) -> Callable[..., Column]:
    """The highest bid that costs less than ``room``, by halving, many rows at once."""

    def most(room: pd.Series, housing: pd.Series, large: pd.Series, loan_share: pd.Series, loan_rate: pd.Series, months: pd.Series) -> pd.Series:
        homes, wide = (x.fillna(False).to_numpy(dtype=bool) for x in (housing, large))
        share, rate, held, most = (x.fillna(0).to_numpy(dtype="float64") for x in (loan_share, loan_rate, months, room))
        low, high = np.zeros(len(most), "int64"), np.clip(most, 1, 1 << 62).astype("int64")
        while (high - low > 1).any():
            bid = low + (high - low) // 2
            gains = bid + _near_costs(bid, homes, wide, extra) + np.rint(np.rint(bid * share) * rate * held / 12) < most
            low, high = np.where(gains, bid, low), np.where(gains, high, bid)
        return pd.Series(low)

    return F.pandas_udf(most, "long")


def with_break_even(rows: DataFrame, into: str, sale: Column, kind: Column, area: Column, houses: int = 1, regulated: bool = False, corporation: bool = False, **over) -> DataFrame:
    """``rows`` with ``break_even`` and its net profit (``into`` with ``_net``) as columns, for many rows.

    A bid is found by numpy and kept if it leaves a profit and the next one doesn't, by the rules themselves; any other row is searched.
    """
    of = {"houses": houses, "regulated": regulated, "corporation": corporation, **over}
    searched = let({"bid": break_even(sale, kind, area, **of)}, lambda x: F.struct(x["bid"].alias("bid"), simulate(x["bid"], sale, kind, area, **of)["net"].alias("net")))
    if _lighter(houses, regulated, over):
        known, stages = _simulation(sale, kind, area, houses, regulated, corporation, over)
        staged, x = _with_stages(rows, into, known, {})
        room = (x["sale"] - x["registry"] - x["other"] - x["fee"]).cast("double")
        given = [x["kind"].isin(HOUSING), x["area"] > SMALL_AREA, *[x[k].cast("double") for k in ("loan_share", "loan_rate", "months")]]
        staged, near = _with_stages(staged, into, [lambda _: {"bid": _near_most(surcharge(houses, regulated, corporation))(room, *given)}, *stages], x)
        staged, above = _with_stages(staged, f"{into}_above", [lambda _: {"bid": near["bid"] + 1}, *_costs(houses, regulated, corporation)], x)
        net = _left(near)["net"]
        searched = F.when((net > 0) & (_untaxed(above) <= 0), F.struct(near["bid"].alias("bid"), net.alias("net"))).otherwise(searched)
    else:
        staged = rows
    found = staged.withColumn(f"_{into}_found", searched)
    return found.select(*rows.columns, F.col(f"_{into}_found.bid").alias(into), F.col(f"_{into}_found.net").alias(f"{into}_net"))
