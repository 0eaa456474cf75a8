"""From listings and trades to estimates, scores, grades and served lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammerlake.functions import money, numbers, text
from hammerlake.operators import bands, matching

# Limits, penalties, knots and grades of the published scoring rules.
SAME_AREA, NEAR_AREA = 0.03, 0.10
MAX_RATIO, FALLBACK_RATIO, CONFIRMED_MIN, MAX_SPREAD = 2.5, (0.6, 1.5), 0.35, 1.6
COMPS = 240
GAP_KNOTS = [(-1.0, 0.0), (0.0, 0.0), (0.10, 35.0), (0.20, 60.0), (0.30, 80.0), (0.40, 100.0), (1.0, 100.0)]
CONFIDENCE = [(3, 1.0), (2, 0.85), (1, 0.70), (0, 0.60)]
GRADES = [(80, "차익 유력"), (60, "양호"), (40, "관심"), (0, "주의")]
NO_PROFIT, UNVERIFIED, RISK, UNKNOWN, UNSUPPORTED = "차익없음", "권리미확인", "위험", "시세추정불가", "미지원유형"
PENALTIES = {"유치권": 30, "법정지상권": 25, "지분": 20, "분묘기지권": 20, "대지권미등기": 15, "위반건축물": 15, "지분매각": 30, "가등기": 25, "가처분": 25, "토지별도등기": 15, "선순위전세권": 20}
OTHER_PENALTY, FATAL, MAX_BURDEN, GATE_CEILING = 10, ["유치권", "지분매각"], 0.30, 25.0
OCCUPANTS = {"공실": 0, "임차인": 10, "소유자점유": 15, "다수점유": 25}
OTHER_OCCUPANT, OPPOSABLE = 15, 30
TYPE_BASE = {"아파트": 90, "오피스텔": 75, "다세대": 60, "빌라": 60, "연립": 60, "상가": 45, "토지": 35}
OTHER_TYPE = 30
REGIONS = [(["서울"], 1.10), (["경기"], 1.05), (["부산", "대구", "인천", "광주", "대전", "울산"], 1.00)]
OTHER_REGION = 0.85
WEIGHTS = (0.5, 0.3, 0.2)
LOW_FLOOR, LOW_FACTORS = 2, {0: 0.92, 1: 0.92, 2: 0.945}
KB, ASK, ASK_SINGLE, LEASE = 0.75, 0.55, 0.45, 0.50
HAIRCUT, LEASE_RATIO = {"오피스텔": 0.85, "": 0.93}, {"오피스텔": 0.80, "": 0.65}
SUPPORTED = {"아파트": "apt", "오피스텔": "offi"}
SAME_SAME, SAME_NEAR, SAME_DONG = "same_complex_same_area", "same_complex_near_area", "same_dong_fallback"
KEY = ["court", "case_no", "item_no"]


def _of(table: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(float(v))) for k, v in table.items()], F.lit(float(other)))


def kind_of(property_type: Column) -> Column:
    """The kind of trades that a type is compared with; null if it isn't estimated."""
    return F.coalesce(*[F.when(property_type == k, F.lit(v)) for k, v in SUPPORTED.items()])


def match_trades(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """Listings with the trades they are compared with, of the first of three tiers: the building's with the same
    area, those with a near area, or those of the neighbourhood. Cancelled trades are in none; a tier of the
    building's that mixes several blocks is passed over.

    Names meet by equality of their parts and neighbourhoods by equality, so that a listing meets its own trades and not its district's.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # a district meets itself; what has none meets all: listings trades of any place, and trades listings of any place
    places = lambda c, mine, every: F.explode(F.when(blank(c), F.array(F.lit(every[0]), *map(F.lit, every[1:]))).otherwise(F.array(F.concat(F.lit("="), F.col(c)), F.lit(mine)))).alias("place")
    t = trades.where(~F.coalesce(F.col("cancelled"), F.lit(False)) & (F.col("price") > 0)).select("kind", places("lawd_cd", "any", ["any", "none"]), text.name_key(F.col("apt_name")).alias("t_name"), F.to_json(text.block_numbers(F.col("apt_name"))).alias("blocks"), text.squeezed(F.col("dong")).alias("t_dong"), F.col("area_m2").alias("t_area"), "price", "deal_ym", "floor")
    a = listings.select(*KEY, kind_of(F.col("property_type")).alias("kind"), places("lawd_cd", "none", ["any"]), text.name_key(F.col("apt_name")).alias("name"), text.squeezed(F.col("dong")).alias("own_dong"), "area_m2")
    a = a.where(F.col("kind").isNotNull()).where(" and ".join(f"{k} is not null" for k in KEY))
    own = ["kind", "place"]
    names = matching.contained(a.select(*own, "name").where(F.length("name") >= 2), t.select(*own, "t_name").where(F.length("t_name") >= 1), own, "name", "t_name")
    fits = blank("t_dong") | (F.col("t_dong") == F.col("own_dong"))
    named = matching.by_size(a.join(names, [*own, "name"]), t, [*own, "t_name"], "area_m2", "t_area", NEAR_AREA).where(fits)
    beside = matching.by_size(a.where(~blank("own_dong")), t.withColumnRenamed("t_dong", "own_dong"), [*own, "own_dong"], "area_m2", "t_area", NEAR_AREA)
    close = F.abs(F.col("t_area") - F.col("area_m2")) / F.col("area_m2") <= SAME_AREA
    kept = [*KEY, "blocks", "t_area", "price", "deal_ym", "floor"]
    met = named.select(*kept, F.when(close, 1).otherwise(2).alias("tier")).unionByName(beside.select(*kept, F.lit(3).alias("tier")))
    # two different sets of block numbers are told by their extremes; the first tier is part of the second
    of = Window.partitionBy(*KEY)
    within = {k: F.col("tier") <= k if k < 3 else F.col("tier") == k for k in (1, 2, 3)}
    blocks = lambda f, k: f(F.when(within[k] & (F.col("blocks") != "[]"), F.col("blocks"))).over(of)
    met = met.withColumns({"_n1": F.min("tier").over(of), "_n3": F.max("tier").over(of), **{f"_{n}{k}": blocks(f, k) for n, f in (("x", F.min), ("y", F.max)) for k in (1, 2)}})
    single = lambda k: F.col(f"_x{k}").isNull() | (F.col(f"_x{k}") == F.col(f"_y{k}"))
    best = F.when((F.col("_n1") == 1) & single(1), 1).when((F.col("_n1") <= 2) & single(2), 2).when(F.col("_n3") == 3, 3)
    met = met.withColumn("_best", best).where(F.coalesce(*[F.when(F.col("_best") == k, within[k]) for k in (1, 2, 3)], F.lit(False)))
    scope = F.when(F.col("_best") == 1, SAME_SAME).when(F.col("_best") == 2, SAME_NEAR).otherwise(SAME_DONG)
    return met.select(*KEY, scope.alias("scope"), "t_area", "price", "deal_ym", "floor")


def floor_factor(floor: Column, measured: Column | None = None) -> Column:
    """What a price is multiplied by for a low floor: the measured ratio, or the usual one."""
    low = floor <= LOW_FLOOR
    usual = F.coalesce(*[F.when(floor == k, F.lit(v)) for k, v in LOW_FACTORS.items()], F.lit(LOW_FACTORS[1]))
    return F.when(low, F.coalesce(measured, usual) if measured is not None else usual).otherwise(F.lit(1.0))


def estimate(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """``(keys, est, matched, scope, band_low, band_high, basis, floor_mult)`` for each listing.

    Recent matches are trimmed; their median per square metre, times area and floor factor, is the estimate, and
    their least the lower end. Too few, too far from the appraisal or too wide a band give none, and scope says why.
    """
    found = match_trades(listings, trades).withColumn("m", numbers.month_of(F.col("deal_ym"))).withColumn("unit", F.col("price") / F.col("t_area"))
    band = bands.recent_band(found, KEY, "m", "unit", F.col("floor") <= LOW_FLOOR, F.col("floor") > 0, F.count(F.lit(1)).alias("matched"), F.min("scope").alias("tier_scope"))
    band = band.withColumnsRenamed({"mid": "unit_mid", "lo": "unit_lo"})
    joined = listings.join(band, KEY, "left").withColumn("floor_mult", floor_factor(text.floor_of(F.col("address")), F.col("ratio")))
    shared = F.arrays_overlap(F.coalesce("special_rights", F.array().cast("array<string>")), F.array(F.lit("지분"), F.lit("대지권미등기")))
    est = F.bround(F.col("unit_mid") * F.col("area_m2") * F.col("floor_mult")).cast("bigint")
    low = F.bround(F.col("unit_lo") * F.col("area_m2") * F.col("floor_mult")).cast("bigint")
    far = est / F.when(F.col("appraisal_price") > 0, F.col("appraisal_price"))
    fallback = F.col("tier_scope") == SAME_DONG
    scope = F.when(kind_of(F.col("property_type")).isNull(), "unsupported").when(shared, "share_sale").when(F.col("matched").isNull(), "no_comps").when(F.col("basis") < bands.MIN_BASIS, F.col("tier_scope"))
    scope = scope.when((far > F.when(fallback, FALLBACK_RATIO[1]).otherwise(MAX_RATIO)) | (fallback & (far < FALLBACK_RATIO[0])), "appraisal_mismatch").when(fallback & (low > 0) & (est / low > MAX_SPREAD), "band_too_wide").otherwise(F.col("tier_scope"))
    valid = (scope == F.col("tier_scope")) & (F.col("basis") >= bands.MIN_BASIS)
    return joined.select(*KEY, F.when(valid, est).alias("est"), F.coalesce("matched", F.lit(0)).alias("matched"), scope.alias("scope"), F.when(valid, low).alias("band_low"), F.when(valid, est).alias("band_high"), "basis", F.when(valid, F.col("floor_mult")).otherwise(1.0).alias("floor_mult"))


def estimate_confirmed(listings: DataFrame, trades: DataFrame) -> DataFrame:
    """As ``estimate``, from ``trades`` (keys, trade_ymd, price, deleted, floor) of the very building and size (floor may be missing).

    Prices themselves are compared, in the shortest window of 12, 24 or 60 months with enough of them; confidence
    falls with its length, and an estimate far from the appraisal is none. A low floor costs what it does in that window, or the
    usual part. Every listing has a row: kinds that aren't estimated, shares, and those without trades enough have no
    estimate, and scope says why.
    """
    rows = trades.where((F.coalesce("deleted", F.lit(0)) == 0) & (F.col("price") > 0)).withColumn("m", numbers.month_of(F.col("trade_ymd"))).where("m is not null").withColumn("price", F.col("price").cast("double"))
    band = bands.window_ladder(rows, KEY, "m", "price")
    newest = rows.groupBy(*KEY).agg(F.max("m").alias("newest"))
    rows = rows if "floor" in rows.columns else rows.withColumn("floor", F.lit(None).cast("int"))
    within = rows.join(band.select(*KEY, "months"), KEY).join(newest, KEY).where("m >= newest - months and floor > 0")
    ratio = bands.clamped_ratio(within, KEY, F.col("floor") <= LOW_FLOOR, "price")
    joined = listings.select(*KEY, "address", "appraisal_price", "property_type", "special_rights").join(band, KEY, "left").join(ratio, KEY, "left").withColumn("mult", floor_factor(text.floor_of(F.col("address")), F.col("ratio")))
    est = F.bround(F.col("mid") * F.col("mult")).cast("bigint")
    far = est / F.when(F.col("appraisal_price") > 0, F.col("appraisal_price"))
    shared = F.arrays_overlap(F.coalesce("special_rights", F.array().cast("array<string>")), F.array(F.lit("지분"), F.lit("대지권미등기")))
    scope = F.when(kind_of(F.col("property_type")).isNull(), "unsupported").when(shared, "share_sale").when(F.col("mid").isNull(), "no_comps").when(F.coalesce((far > MAX_RATIO) | (far < CONFIRMED_MIN), F.lit(False)), "appraisal_mismatch").otherwise(SAME_SAME)
    ok = scope == SAME_SAME
    return joined.select(*KEY, F.when(ok, est).alias("est"), F.when(ok, F.bround(F.col("lo") * F.col("mult")).cast("bigint")).alias("band_low"), "basis", "months", F.when(ok, F.col("confidence")).otherwise(1.0).alias("window_mult"), scope.alias("scope"))


def in_order(confirmed: DataFrame, by_name: DataFrame) -> DataFrame:
    """The estimate that counts for each listing of ``by_name``, with ``source`` 'confirmed', 'by_name' or 'blocked', and ``window_mult``.

    ``confirmed`` (``estimate_confirmed``) has three outcomes: a value, which counts; none for want of trades, where the
    match by name takes its place; or a contradiction of the appraisal, which bars that too, as trades of the very building
    say that something is wrong.
    """
    own = confirmed.select(*KEY, F.struct("est", "band_low", "basis", "window_mult", "scope").alias("_c"))
    rows = by_name.join(own, KEY, "left")
    source = F.when(F.col("_c.est").isNotNull(), "confirmed").when(F.col("_c.scope") == "appraisal_mismatch", "blocked").otherwise("by_name")
    rows = rows.withColumn("source", source)
    of = lambda a, b, kind: F.when(F.col("source") == "by_name", F.col(a)).otherwise(b).cast(kind).alias(a)
    basis = F.coalesce("_c.basis", F.lit(0))
    return rows.select(*KEY, of("est", F.col("_c.est"), "bigint"), of("matched", basis, "bigint"), of("scope", F.col("_c.scope"), "string"), of("band_low", F.col("_c.band_low"), "bigint"), of("band_high", F.col("_c.est"), "bigint"), of("basis", F.col("_c.basis"), "bigint"), of("floor_mult", F.lit(1.0), "double"), F.when(F.col("source") == "confirmed", F.col("_c.window_mult")).otherwise(F.lit(1.0)).alias("window_mult"), "source")


def comps(found: DataFrame) -> DataFrame:
    """``(keys, comps)``: the newest ``COMPS`` dated prices of each listing, in arrays of that bounded length."""
    from hammerlake.operators.ranking import ranked_within

    one = found.where("deal_ym is not null").withColumn("_key", F.concat_ws("|", *KEY))
    newest = ranked_within(one, "_key", [F.desc("deal_ym"), F.asc("price")], COMPS)
    return newest.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "deal_ym", "price"))), lambda x: F.struct(x["deal_ym"].alias("ym"), x["price"].alias("price"))).alias("comps"))


def hard_gated() -> Column:
    """Burdens above the limit (a bid of 0 counts as all burden), or a right that no price heals."""
    ratio = F.when(F.coalesce("min_bid_price", F.lit(0)) != 0, F.coalesce("assumed_amount", F.lit(0)) / F.col("min_bid_price")).otherwise(1.0)
    return (ratio > MAX_BURDEN) | F.arrays_overlap(F.coalesce("special_rights", F.array().cast("array<string>")), F.array(*map(F.lit, FATAL)))


def rights_score() -> Column:
    ratio = F.when(F.coalesce("min_bid_price", F.lit(0)) != 0, F.coalesce("assumed_amount", F.lit(0)) / F.col("min_bid_price")).otherwise(1.0)
    penalty = F.aggregate(F.array_distinct(F.coalesce("special_rights", F.array().cast("array<string>"))), F.lit(0.0), lambda s, x: s + _of(PENALTIES, x, OTHER_PENALTY))
    score = 100.0 - ratio * 100 - penalty - F.when(F.coalesce("tenant_opposable", F.lit(False)), F.lit(float(OPPOSABLE))).otherwise(0.0) - _of(OCCUPANTS, F.col("occupant_type"), OTHER_OCCUPANT)
    return F.when(hard_gated(), 0.0).otherwise(numbers.clamp(F.bround(score, 1), 0.0, 100.0))


def liquidity_score(matched: Column) -> Column:
    region = F.lit(OTHER_REGION)
    for prefixes, factor in reversed(REGIONS):
        region = F.when(F.substring("address", 1, 2).isin(prefixes), F.lit(factor)).otherwise(region)
    return numbers.clamp(F.bround(_of(TYPE_BASE, F.col("property_type"), OTHER_TYPE) * region + F.least(F.lit(10), 2 * matched), 1), 0.0, 100.0)


def grade(arb: Column, gated: Column, verified: Column, gap: Column, profit_low: Column, burden_unknown: Column, scope: Column | None = None, basis: Column | None = None, matched: Column | None = None) -> Column:
    """One order of precedence: risk, no profit, unverified rights, then the ladder, which a weak basis and an
    unread burden lower. With ``scope``, basis and matched the sample limits hold too."""
    top, second, third, rest = (g for _, g in GRADES)
    by_score = F.when(arb.isNull(), UNKNOWN).otherwise(numbers.ladder(arb, GRADES, rest))
    if scope is not None:
        weak = (~scope.isin("", SAME_SAME)) | (F.coalesce(basis, F.lit(5)) < 5)
        by_score = F.when(weak & by_score.isin(top, second), third).when((F.coalesce(matched, F.lit(3)) < 3) & (by_score == top), second).otherwise(by_score)
    capped = F.when(burden_unknown & by_score.isin(top, second, third), rest).otherwise(by_score)
    nothing = F.coalesce(gap <= 0, F.lit(False)) | F.coalesce(profit_low <= 0, F.lit(False))
    return F.when(gated, RISK).when(nothing, NO_PROFIT).when(~verified, UNVERIFIED).otherwise(capped)


def _scored(rows: DataFrame, matched: Column, sample: tuple[Column, Column, Column] | None) -> DataFrame:
    """Profits, scores and grade from the columns _price, _low, _high and _confidence, which are dropped.

    Each step is a column of its own: an expression that later ones use more than once is computed once.
    """
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    priced = lambda profit: F.when(F.col("_price").isNotNull(), profit)
    rows = rows.withColumns({"expected_profit": F.col("_price") - F.col("cost"), "profit_low": priced(F.col("_low") - F.col("cost") - F.coalesce("assumed_amount", F.lit(0))), "profit_high": priced(F.col("_high") - F.col("cost")), "_gated": hard_gated()})
    rows = rows.withColumn("gap_rate", F.col("expected_profit") / F.col("_price"))
    rows = rows.withColumn("gap_score", numbers.interpolate(F.col("gap_rate"), GAP_KNOTS)).withColumn("_liquidity", liquidity_score(matched))
    rows = rows.withColumn("arb_score", F.bround((F.col("gap_score") * WEIGHTS[0] + F.col("rights_score") * WEIGHTS[1] + F.col("_liquidity") * WEIGHTS[2]) * F.col("_confidence"), 1))
    rows = rows.withColumn("arb_score", F.when(F.col("_gated") & (F.col("arb_score") > GATE_CEILING), F.lit(GATE_CEILING)).otherwise(F.col("arb_score")))
    rows = rows.withColumn("grade", grade(F.col("arb_score"), F.col("_gated"), false("rights_verified"), F.col("gap_rate"), F.col("profit_low"), false("burden_amount_unknown"), *(sample or ())))
    return rows.drop("_price", "_low", "_high", "_confidence", "_liquidity")


def score(listings: DataFrame, estimates: DataFrame) -> DataFrame:
    """Listings with cost, estimate, profits, scores and grade. Without an estimate profits and score stay null:
    the grade tells whether the type isn't estimated, the rights are a risk, or the market isn't known. Unverified
    rights leave no score, but for those that bar the sale anyhow.
    ``estimates`` is meant to be a written table, as each estimate serves many scorings."""
    cost = F.col("min_bid_price") + money.acquisition_tax(F.col("min_bid_price"), F.col("property_type"), F.col("area_m2"))
    rows = listings.join(estimates, KEY, "left").withColumns({"cost": cost, "rights_score": rights_score(), "matched": F.coalesce("matched", F.lit(0))})
    rows = rows.withColumns({"liquidity_score": liquidity_score(F.col("matched")), "confidence": numbers.ladder(F.col("matched"), CONFIDENCE, 0.6), "est": F.when((F.col("est") > 0) & (F.col("matched") >= 2), F.col("est"))})
    rows = rows.withColumns({"_price": F.col("est"), "_low": F.col("band_low"), "_high": F.col("band_high"), "_confidence": F.col("confidence")})
    out = _scored(rows, F.col("matched"), (F.coalesce("scope", F.lit("")), F.col("basis"), F.col("matched")))
    out = out.withColumn("arb_score", F.when(F.coalesce("rights_verified", F.lit(False)) | F.col("_gated"), F.col("arb_score")))
    missing = F.when(F.col("_gated"), RISK).when(kind_of(F.col("property_type")).isNull(), UNSUPPORTED).otherwise(UNKNOWN)
    return out.withColumns({"gap_score": F.coalesce("gap_score", F.lit(0.0)), "grade": F.when(F.col("est").isNull(), missing).otherwise(F.col("grade"))}).drop("_gated")


def market_view(scored: DataFrame, prices: DataFrame) -> DataFrame:
    """Served prices: trades first, then the bank's price, asking prices less a haircut, or leases over their ratio.

    Share sales take none of these; a price from trades more than 15 % outside the bank's band is flagged. A row
    that takes a fallback has no score while its rights are unverified.
    """
    kept = ["kb_low", "kb_avg", "kb_high", "lease_avg", "ask_min", "ask_max", "ask_count"]
    changed = ["expected_profit", "profit_low", "profit_high", "gap_rate", "gap_score", "arb_score", "grade", "est", "confidence"]
    rows = scored.select(*[c for c in scored.columns if c not in changed], F.struct(*changed).alias("_old")).join(prices.select(*KEY, *kept, F.lit(True).alias("_has")), KEY, "left")
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    by_type = lambda t: F.when(F.col("property_type") == "오피스텔", F.lit(t["오피스텔"])).otherwise(F.lit(t[""]))
    rows = rows.withColumns({"_ask_low": (pos("ask_min") * by_type(HAIRCUT)).cast("bigint"), "_ask_high": (F.greatest(F.coalesce(pos("ask_max"), F.col("ask_min")), F.col("ask_min")) * by_type(HAIRCUT)).cast("bigint"), "_lease": (pos("lease_avg") / by_type(LEASE_RATIO)).cast("bigint"), "_mult": floor_factor(text.floor_of(F.col("address")))})
    source = F.when(F.col("_has").isNull(), F.lit(None)).when(F.col("scope") == "share_sale", "none").when(F.col("_old.est") > 0, "trades").when(F.col("kb_avg") > 0, "kb").when(F.col("_ask_low").isNotNull(), "ask").when(F.col("_lease").isNotNull(), "lease").otherwise("none")
    rows = rows.withColumn("market_source", source)
    choose = lambda kb, ask, lease: F.when(F.col("market_source") == "kb", kb).when(F.col("market_source") == "ask", ask).when(F.col("market_source") == "lease", lease)
    low, high = F.col("_ask_low"), F.col("_ask_high")
    rows = rows.withColumns({
        "_price": (choose(F.col("kb_avg"), F.floor((low + high) / 2), F.col("_lease")) * F.col("_mult")).cast("bigint"),
        "_low": (choose(F.coalesce(pos("kb_low"), F.col("kb_avg")), low, F.col("_lease")) * F.col("_mult")).cast("bigint"),
        "_high": (choose(F.coalesce(pos("kb_high"), F.col("kb_avg")), high, F.col("_lease")) * F.col("_mult")).cast("bigint"),
        "_confidence": choose(F.lit(KB), F.when(F.coalesce("ask_count", F.lit(0)) <= 1, ASK_SINGLE).otherwise(ASK), F.lit(LEASE)),
    })
    rows = _scored(rows.withColumns({"est": F.col("_price"), "confidence": F.col("_confidence")}), F.col("matched"), None)
    rows = rows.withColumn("arb_score", F.when(F.coalesce(F.col("rights_verified"), F.lit(False)) | F.col("_gated"), F.col("arb_score")))
    trades = F.col("market_source") == "trades"
    flag = F.when(trades & (F.col("_old.est") > pos("kb_high") * 1.15), "over").when(trades & (F.col("_old.est") < pos("kb_low") * 0.85), "under")
    new = {c: F.when(F.col("est").isNotNull(), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in changed}
    return rows.select(*[new.get(c, F.col(c)) for c in scored.columns], "market_source", flag.alias("kb_divergence"))


#: Square metres of a pyeong, brackets of areas in pyeong, tiers of scopes, and days that count as soon.
PYEONG, BRACKETS = 3.3058, {"~20": (None, 20), "20": (20, 30), "30": (30, 40), "40": (40, 50), "50plus": (50, None)}
SCOPE_TIERS, OTHER_TIER = {SAME_SAME: 0, SAME_NEAR: 0, "": 1, SAME_DONG: 2}, 3
SOON_DAYS, OPENS, OPEN_MINUTES, ENOUGH_BASIS = 7, "1000", 120, 5


def decision_profit() -> Column:
    """The profit that decides: at the low end, or else the expected one."""
    return F.coalesce("profit_low", "expected_profit")


def net_profit(burden: str | None = None) -> Column:
    """The profit that decides less what a buyer takes over, if that column is given."""
    return decision_profit() - (F.coalesce(burden, F.lit(0)) if burden else F.lit(0))


def scope_tier() -> Column:
    tier = F.coalesce(*[F.when(F.col("scope") == k, F.lit(v)) for k, v in SCOPE_TIERS.items()], F.lit(OTHER_TIER))
    return F.when(decision_profit().isNull(), OTHER_TIER).otherwise(tier)


def days_until(today: Column, date: str = "sale_date") -> Column:
    """Days to a sale; null if its date can't be read."""
    return F.date_diff(F.substring(date, 1, 10).try_cast("date"), today)


def bidding_closed(now: Column, date: str = "sale_date", time: str = "sale_time") -> Column:
    """Whether a sale of today is over: two hours behind its opening (``HHMM``; ten o'clock if that can't be read). Other days' aren't."""
    t = F.when(F.col(time).rlike(r"^(?:[01]\d|2[0-3])[0-5]\d$"), F.col(time)).otherwise(OPENS)
    minutes = F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 3, 2).cast("int") + OPEN_MINUTES
    passed = F.unix_seconds(now) - F.unix_seconds(F.date_trunc("day", now)) > minutes * 60
    return F.coalesce((days_until(now.cast("date"), date) == 0) & passed, F.lit(False))


def split_upcoming(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` that have a date, with ``upcoming``: later days, and today until bidding has closed."""
    days = days_until(now.cast("date"))
    return rows.where(days.isNotNull() & F.col("sale_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).withColumn("upcoming", (days > 0) | ((days == 0) & ~bidding_closed(now)))


def positive(rows: DataFrame, burden: str | None = None, uncertain: str | None = None) -> DataFrame:
    """Rows with a profit left after burdens; where those aren't known, none is."""
    rows = rows.where(~F.coalesce(F.col(uncertain), F.lit(False))) if uncertain else rows
    return rows.where(net_profit(burden) > 0)


def recommended(rows: DataFrame, legacy: bool = True) -> DataFrame:
    """Rows that may be recommended: a profit at the low end, no risk, prices of the same building and size from enough trades.

    With ``legacy`` rows from before scopes and bases were kept pass, without it what isn't known doesn't.
    """
    gain = (decision_profit() > 0) & ~F.coalesce(F.col("grade") == RISK, F.lit(False))
    scope, enough = F.coalesce("scope", F.lit("")), F.col("basis") >= ENOUGH_BASIS
    old = scope.isin("", SAME_SAME) & (F.col("basis").isNull() | enough)
    new = F.col("profit_low").isNotNull() & (scope == SAME_SAME) & enough
    return rows.where(gain & (old if legacy else new))


def search(rows: DataFrame, words: str | None = None, area: tuple[float | None, float | None] | str | None = None, fails: int | None = None, profit: int | None = None, least_score: float | None = None, kind: str | None = None, region: str | None = None, bid: tuple[int | None, int | None] = (None, None), evaluable: bool = False, burden: str | None = None) -> DataFrame:
    """The rows that all given conditions hold for; one that isn't given holds for all.

    ``area`` is a range in square metres or the name of a bracket, ``burden`` the column that profits are lessened by. What isn't known
    holds for no condition.
    """
    low, high = tuple(x and x * PYEONG for x in BRACKETS.get(area, (None, None))) if isinstance(area, str) else area or (None, None)
    conditions = [
        words and text.contains_squeezed(F.concat_ws(" ", "apt_name", "address"), words),
        evaluable and F.col("est").isNotNull(),
        low is not None and F.col("area_m2") >= low,
        high is not None and F.col("area_m2") < high,
        fails is not None and F.coalesce("fail_count", F.lit(0)) >= fails,
        profit is not None and net_profit(burden) >= profit,
        least_score is not None and F.col("arb_score") >= least_score,
        kind and F.col("property_type") == kind,
        region and text.in_region(F.col("address"), region),
        bid[1] is not None and (F.col("min_bid_price") > 0) & (F.col("min_bid_price") <= bid[1]),
        bid[0] is not None and (F.col("min_bid_price") > 0) & (F.col("min_bid_price") >= bid[0]),
    ]
    for c in conditions:
        rows = rows.where(c) if isinstance(c, Column) else rows
    return rows


#: Fixed value: a profit that counts as high.
HIGH_PROFIT = 200_000_000
CHIPS = ("clean", "soon", "high")


def home(rows: DataFrame, now: Column, chip: str | None = None, burden: str | None = None, losses: bool = False) -> DataFrame:
    """The list that is shown first: what has a price, without losses after burdens unless they are asked for; of a chip only those that are
    clean (``clean`` column), sold soon and still open to bids, or of high profit. In the usual order."""
    rows = rows.where(F.col("est").isNotNull()) if losses else positive(rows.where(F.col("est").isNotNull()), burden)
    return ordered(rows.where(_chips(now)[chip]) if chip else rows, "profit", burden)


def _chips(now: Column) -> dict[str, Column]:
    until = days_until(now.cast("date"))
    soon = until.between(0, SOON_DAYS) & ~bidding_closed(now)
    return {"clean": F.coalesce("clean", F.lit(False)), "soon": F.coalesce(soon, F.lit(False)), "high": F.coalesce(decision_profit() >= HIGH_PROFIT, F.lit(False))}


def chip_counts(rows: DataFrame, now: Column, burden: str | None = None) -> DataFrame:
    """``(chip, n)``: how many rows ``home`` shows for each chip, and in all, by one aggregate."""
    chips = _chips(now)
    counts = positive(rows.where(F.col("est").isNotNull()), burden).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(chips[k]).alias(k) for k in CHIPS])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ("all", *CHIPS)]), F.array("all", *CHIPS))).alias("chip", "n"))


_verified = lambda: F.coalesce("rights_verified", F.lit(False))
ORDERS = {
    "profit": lambda b, u: [scope_tier(), F.when((F.coalesce(F.col(u), F.lit(False)) if u else F.lit(False)) | ~_verified(), 1).otherwise(0), F.coalesce(net_profit(b), F.lit(0)).desc()],
    "gap": lambda b, u: [F.col("gap_rate").desc_nulls_last()],
    "score": lambda b, u: [F.when(F.col("arb_score").isNull() | ~_verified(), 1).otherwise(0), F.col("arb_score").desc_nulls_last()],
    "score_asc": lambda b, u: [F.col("arb_score").asc_nulls_last()],
    "profit_asc": lambda b, u: [net_profit(b).asc_nulls_last()],
    "recent": lambda b, u: [F.nullif(F.col("sale_date"), F.lit("")).desc_nulls_last()],
    "old": lambda b, u: [F.nullif(F.col("sale_date"), F.lit("")).asc_nulls_last()],
}


def order_by(by: str = "profit", burden: str | None = None, uncertain: str | None = None) -> list[Column]:
    """One of the orders, with the key as the last word; an unknown name is the first. The first puts prices of the same
    building before others, sure burdens before unsure ones, and then the larger net profit."""
    return [*ORDERS.get(by, ORDERS["profit"])(burden, uncertain), *map(F.col, KEY)]


def ordered(rows: DataFrame, by: str = "profit", burden: str | None = None, uncertain: str | None = None) -> DataFrame:
    return rows.orderBy(*order_by(by, burden, uncertain))
