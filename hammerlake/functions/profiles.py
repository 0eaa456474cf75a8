"""What is left of a purchase for a private seller, a dealer and a company, for some lengths of holding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hammerlake.functions import money

PROFILES, BANDS = ("individual", "dealer", "corp"), (6, 18, 30)
# Rates of companies by the part of the gain up to a bound, what is added for housing; and of the yearly tax on housing:
# its day (month, day), the official share of a price, the share that is taxed, brackets (bound, tax below, begin, rate) and additions.
CORP_BRACKETS, CORP_HOUSING = [(200_000_000, 0.10), (20_000_000_000, 0.20), (300_000_000_000, 0.22), (None, 0.25)], 0.20
TAX_DAY, OFFICIAL_SHARE, TAXED_SHARE = (6, 1), 0.7, 0.6
YEARLY_BRACKETS, CITY_RATE, EDUCATION_SHARE = [(60_000_000, 0, 0, 0.001), (150_000_000, 60_000, 60_000_000, 0.0015), (300_000_000, 195_000, 150_000_000, 0.0025), (None, 570_000, 300_000_000, 0.004)], 0.0014, 0.2
NOT_HOUSING_RATE = 0.046
#: Days from the sale to the last day of payment: a week until it is allowed, a week until that is final, and thirty days.
PAYMENT_DAYS = 44


def _won(x: Column) -> Column:
    """Rounded half up, as browsers do."""
    return F.floor(x + 0.5).cast("bigint")


def marginal(gain: Column, brackets: list[tuple[int | None, float]]) -> Column:
    """A tax whose rates apply to the parts of a gain between bounds; nothing on a loss."""
    total, below = F.lit(0.0), 0
    for upper, rate in brackets:
        within = gain if upper is None else F.least(gain, F.lit(upper))
        total = total + F.greatest(F.lit(0), within - below) * F.lit(rate)
        below = upper
    return _won(total)


def days_within(begin: Column, end: Column, day: tuple[int, int] = TAX_DAY) -> Column:
    """How often a day of the year lies after ``begin`` and not after ``end``: a difference of counts, without a sequence of years."""
    month, dom = day
    before = lambda d: F.year(d) - ((F.month(d) * 100 + F.dayofmonth(d)) < month * 100 + dom).cast("int")
    return F.greatest(F.lit(0), before(end) - before(begin))


def yearly_tax(price: Column) -> Column:
    """A year's tax on housing with its additions, by a share of the price as no official one is known."""
    base = price * F.lit(OFFICIAL_SHARE) * F.lit(TAXED_SHARE)
    own = money._first([(None if cap is None else base <= cap, _won(F.lit(least) + (base - over) * F.lit(rate))) for cap, least, over, rate in YEARLY_BRACKETS])
    return own + _won(base * F.lit(CITY_RATE)) + _won(own * F.lit(EDUCATION_SHARE))


def acquisition(bid: Column, kind: Column, area: Column, regulated: Column, houses: int, profile: str) -> Column:
    """The tax on a purchase; companies pay the highest rate for housing, dealers what private buyers pay."""
    line = F.least(F.lit(3.0), F.greatest(F.lit(1.0), bid * 2 / F.lit(300_000_000.0) - 3)) / 100
    plain = F.when(bid <= 600_000_000, F.lit(0.01)).when(bid <= 900_000_000, line).otherwise(F.lit(0.03))

    def tax(extra: int) -> Column:
        own, education, rural = (F.lit(extra / 100), F.lit(0.004), {8: 0.006, 12: 0.010}[extra]) if extra else (plain, plain * 0.1, 0.002)
        return _won(bid * own) + _won(bid * education) + F.when(area > money.SMALL_AREA, _won(bid * F.lit(rural))).otherwise(F.lit(0))

    housing = F.trim(F.coalesce(kind, F.lit(""))).isin(money.HOUSING)
    inside, outside = (money.surcharge(houses, x, profile == "corp") for x in (True, False))
    return F.when(~housing, _won(bid * F.lit(NOT_HOUSING_RATE))).when(regulated, tax(inside)).otherwise(tax(outside))


def outcome(profile: str, months: int | Column, bid: Column, sale: Column, kind: Column, area: Column, regulated: Column, sale_date: Column, houses: int = 1, assumed: Column | int = 0, eviction: Column | int = 3_000_000, unpaid: Column | int = 0, repair: Column | int = 0, registry: Column | int = 500_000, loan_share: float = 0.7, loan_rate: float = 0.055, first_sale_exempt: bool = False) -> Column:
    """``(acquisition_tax, total_in, cash, interest, yearly_tax, fee, tax, net, roi)`` for one profile and length of holding (months).

    A company deducts all expenses, and pays more on what it gains on housing over its book value; a dealer deducts all
    expenses too, and pays the highest of the candidates where several homes in a regulated area make the sale a
    surcharged one; a private seller is taxed by ``money.sale_tax``. Housing is taxed once for each first of June between the last
    day of payment and the sale; with no date, never. roi is null where no own money is in it.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    long = lambda x: lit(x).cast("bigint")
    paid = F.date_add(sale_date.try_cast("date"), PAYMENT_DAYS)
    given = {"months": lit(months).cast("int"), "bid": long(bid), "sale": long(sale), "kind": F.trim(F.coalesce(kind, F.lit(""))), "area": area.cast("double"), "inside": F.coalesce(regulated, F.lit(False)), "assumed": long(assumed), "registry": long(registry), "other": long(eviction) + long(unpaid) + long(repair), "paid": paid}

    def costs(g: Column) -> Column:
        taxed = acquisition(g["bid"], g["kind"], g["area"], g["inside"], houses, profile)
        loan = _won(g["bid"] * F.lit(loan_share))
        held = F.coalesce(days_within(g["paid"], F.add_months(g["paid"], g["months"])), F.lit(0))
        yearly = F.when(g["kind"].isin(money.HOUSING), yearly_tax(g["sale"]) * held).otherwise(F.lit(0)).cast("bigint")
        more = {"taxed": taxed, "stamp": money.stamp_tax(g["bid"]), "fee": money.agent_fee(g["sale"], g["kind"], g["area"], _won), "loan": loan, "interest": _won(loan * F.lit(loan_rate) * g["months"] / 12), "yearly": yearly}
        return money.let(more, lambda x: money.let({"book": g["bid"] + x["taxed"] + x["stamp"] + g["registry"] + g["assumed"]}, lambda y: taxes(g, x, y["book"])))

    def taxes(g: Column, x: Column, book: Column) -> Column:
        total, fee = book + g["other"], x["fee"]
        if profile == "corp":
            as_housing = g["kind"].isin(money.HOUSING) | F.contains(g["kind"], F.lit(money.OFFICE))
            more = F.lit(0) if first_sale_exempt else F.when(as_housing, _won(F.greatest(F.lit(0), g["sale"] - book) * F.lit(CORP_HOUSING))).otherwise(F.lit(0))
            tax = money.let({"national": marginal(g["sale"] - total - x["interest"] - fee, CORP_BRACKETS) + more}, lambda v: v["national"] + _won(v["national"] * F.lit(money.LOCAL_TAX)))
        else:
            spent = {"narrow": book - g["bid"] + fee, "broad": total - g["bid"] + x["interest"] + fee}
            of = lambda v, inside: money.sale_tax(g["sale"], g["bid"], v["narrow"], v["broad"], g["months"], g["kind"], profile, houses, inside, _won)
            tax = money.let(spent, lambda v: F.when(g["inside"], of(v, True)).otherwise(of(v, False)) if houses > 1 else of(v, False))
        left = {"total": total, "cash": total - x["loan"], "tax": tax}
        return money.let(left, lambda v: result(g, x, v))

    def result(g: Column, x: Column, v: Column) -> Column:
        net = g["sale"] - v["total"] - x["interest"] - x["yearly"] - x["fee"] - v["tax"]
        named = {"acquisition_tax": x["taxed"], "total_in": v["total"], "cash": v["cash"], "interest": x["interest"], "yearly_tax": x["yearly"], "fee": x["fee"], "tax": v["tax"], "net": net}
        return F.struct(*[y.cast("bigint").alias(k) for k, y in named.items()], F.when(v["cash"] > 0, net / v["cash"]).alias("roi"))

    return money.let(given, costs)


def matrix(bands: tuple[int, ...] = BANDS, **facts) -> Column:
    """An array of ``(profile, months, of)`` for each profile and length of holding; ``facts`` as in ``outcome``, whose result is ``of``."""
    row = lambda m: F.array(*[F.struct(F.lit(p).alias("profile"), m.alias("months"), outcome(p, m, **facts).alias("of")) for p in PROFILES])
    return F.flatten(F.transform(F.array(*map(F.lit, bands)), row))


def lowest_sale(profile: str, months: int, bid: Column, sale: Column, steps: int = 60, **facts) -> Column:
    """The lowest whole price at which a sale gains, by halving an interval whose upper end is doubled until it gains; null if none does.

    The gain rises with the price but for steps of brackets' roundings, of which one is found.
    """
    gains: Callable[[Column], Column] = lambda x: outcome(profile, months, bid, x, **facts)["net"] > 0
    whole = lambda x: x.cast("bigint")
    start = F.greatest(bid * 4, sale * 3, F.lit(100_000_000))
    upper = F.aggregate(F.sequence(F.lit(1), F.lit(20)), whole(start), lambda h, _: F.when(gains(h), h).otherwise(h * 2))

    def halve(s: Column, _: Column) -> Column:
        mid = whole(F.floor((s["lo"] + s["hi"]) / 2))
        narrower = F.struct(F.when(gains(mid), s["lo"]).otherwise(mid).alias("lo"), F.when(gains(mid), mid).otherwise(s["hi"]).alias("hi"))
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(narrower)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).cast("bigint").alias("lo"), upper.alias("hi")), halve, lambda s: s["hi"])
    return F.when(gains(found), found)
