"""Boundary cases of estimates, scores and merges, as small tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hammerlake.functions import money, numbers, text
from hammerlake.operators import bands, matching, merging, ranking
from hammerlake.plans import listings as L

COLUMNS = "court string, case_no string, item_no string, property_type string, apt_name string, dong string, address string, lawd_cd string, area_m2 double, appraisal_price bigint, min_bid_price bigint, fail_count int, sale_date string, assumed_amount bigint, burden_amount_unknown boolean, tenant_opposable boolean, rights_verified boolean, special_rights array<string>, occupant_type string"
TRADES = "apt_name string, area_m2 double, price bigint, deal_ym string, dong string, floor int, kind string, lawd_cd string, cancelled boolean"


def listing(case="1", **over):
    row = {"court": "c", "case_no": case, "item_no": "1", "property_type": "아파트", "apt_name": "푸른마을", "dong": "가동", "address": "서울 가동 1 15층", "lawd_cd": "11110", "area_m2": 84.9, "appraisal_price": 500_000_000, "min_bid_price": 300_000_000, "fail_count": 1, "sale_date": "2026-08-01", "assumed_amount": 0, "burden_amount_unknown": False, "tenant_opposable": False, "rights_verified": True, "special_rights": [], "occupant_type": "공실"}
    return tuple({**row, **over}.values())


def trade(price, ym="202601", name="푸른마을", area=84.9, dong="가동", floor=9, lawd="11110", cancelled=False):
    return (name, area, price, ym, dong, floor, "apt", lawd, cancelled)


def estimated(spark, trades, **over):
    return L.estimate(spark.createDataFrame([listing(**over)], COLUMNS), spark.createDataFrame(trades, TRADES)).first()


@pytest.mark.parametrize(("n", "basis", "known"), [(2, 2, False), (3, 3, True), (4, 2, False), (5, 3, True), (7, 5, True)])
def test_sample_gate(spark, n, basis, known):
    r = estimated(spark, [trade(500_000_000 + k * 1_000_000) for k in range(n)])
    assert (r.basis, r.est is not None, r.matched) == (basis, known, n)


def test_band_is_trimmed_least_and_median(spark):
    r = estimated(spark, [trade(p * 1_000_000) for p in (100, 480, 490, 500, 900)])
    assert (r.band_low, r.est) == (480_000_000, 490_000_000)


def test_cancelled_far_area_and_other_district_are_excluded(spark):
    r = estimated(spark, [trade(500_000_000)] * 3 + [trade(900_000_000, cancelled=True), trade(900_000_000, area=59.8), trade(900_000_000, lawd="99999")])
    assert (r.matched, r.scope) == (3, L.SAME_SAME)


def test_several_blocks_fall_through_to_the_neighbourhood(spark):
    r = estimated(spark, [trade(500_000_000, name="푸른마을1차"), trade(500_000_000, name="푸른마을2차"), trade(505_000_000, name="푸른마을2차")])
    assert r.scope == L.SAME_DONG


def test_low_floor_and_share_sale(spark):
    assert estimated(spark, [trade(500_000_000)] * 3, address="서울 가동 1 1층").est == 460_000_000
    r = estimated(spark, [trade(500_000_000)] * 3, special_rights=["지분"])
    assert (r.est, r.scope) == (None, "share_sale")


def test_far_from_appraisal_is_unknown(spark):
    r = estimated(spark, [trade(500_000_000)] * 3, appraisal_price=100_000_000)
    assert (r.est, r.scope) == (None, "appraisal_mismatch")


def test_confirmed_ladder_widens(spark):
    rows = [("c", "1", "1", ym, 500_000_000, 0) for ym in ("20260100", "20250100", "20240200", "20230100")] + [("c", "1", "1", "20260100", 1, 1)]
    t = spark.createDataFrame(rows, "court string, case_no string, item_no string, trade_ymd string, price bigint, deleted int")
    r = L.estimate_confirmed(spark.createDataFrame([listing()], COLUMNS), t).first()
    assert (r.months, r.window_mult, r.basis) == (24, 0.9, 3)


def stored(df):
    """As a job writes its result before the next one reads it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def score_of(spark, n=7, **over):
    a = spark.createDataFrame([listing(**over)], COLUMNS)
    return stored(L.score(a, stored(L.estimate(a, spark.createDataFrame([trade(500_000_000 + k) for k in range(n)], TRADES)))))


def test_grades(spark):
    good = score_of(spark).first()
    assert good.grade == "차익 유력" and good.cost == 300_000_000 + 3_300_000
    assert score_of(spark, rights_verified=False).first().grade == L.UNVERIFIED
    assert score_of(spark, special_rights=["유치권"]).first().grade == L.RISK
    assert score_of(spark, min_bid_price=600_000_000).first().grade == L.NO_PROFIT
    assert score_of(spark, burden_amount_unknown=True).first().grade == "주의"
    assert score_of(spark, property_type="토지").first().grade == L.UNSUPPORTED
    assert score_of(spark, n=3).first().grade == "관심"
    none = score_of(spark, n=1).first()
    assert (none.grade, none.expected_profit, none.arb_score) == (L.UNKNOWN, None, None)


def test_fallback_prices(spark):
    none, share = score_of(spark, n=1), score_of(spark, special_rights=["지분"])
    price = lambda *v: spark.createDataFrame([("c", "1", "1", *v)], "court string, case_no string, item_no string, kb_low bigint, kb_avg bigint, kb_high bigint, lease_avg bigint, ask_min bigint, ask_max bigint, ask_count int")
    kb, m = price(390_000_000, 400_000_000, 410_000_000, 0, 0, 0, 0), 1_000_000
    r = L.market_view(none, kb).first()
    assert (r.market_source, r.est, r.confidence, r.profit_low) == ("kb", 400 * m, 0.75, 390 * m - 303_300_000)
    r = L.market_view(none, price(0, 0, 0, 0, 400 * m, 0, 1)).first()
    assert (r.market_source, r.est, r.confidence) == ("ask", 372 * m, 0.45)
    assert L.market_view(none, price(0, 0, 0, 260 * m, 0, 0, 0)).first().est == 400 * m
    assert L.market_view(share, kb).first().market_source == "none"
    r = L.market_view(score_of(spark), kb).first()
    assert (r.market_source, r.kb_divergence) == ("trades", "over")


def test_search_and_order(spark):
    rows = score_of(spark)
    assert L.ordered(L.search(rows, words="푸른 마을", area=(80, 90), evaluable=True), "score").count() == 1
    assert L.search(rows, fails=2).count() == 0


def test_band_against_a_plain_model(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), float(rng.randrange(9))) for _ in range(150)]
    found = {r.k: (r.basis, r.lo, r.mid) for r in bands.trimmed_band(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(x for j, x in rows if j == k)
        v = v[1:-1] if len(v) >= 4 else v
        if len(v) >= 3:
            want[k] = (len(v), v[0], statistics.median(v))
    assert found == want


def test_month_edges(spark):
    rows = spark.createDataFrame([(1, m) for m in (88, 89, 100, None)], "k int, m int")
    assert bands.recent(rows, ["k"], "m").count() == 4
    assert bands.recent(rows, ["k"], "m", inclusive=False).count() == 3


def test_equal_candidates_link_nothing(spark):
    a = spark.createDataFrame([("a", i) for i in range(4)], "l string, x int")
    b = spark.createDataFrame([(r, i) for r in "pq" for i in range(4)], "r string, x int")
    assert matching.fingerprint_link(a, b, "l", "r", ["x"]).count() == 0
    assert matching.fingerprint_link(a, b.where("r = 'p'"), "l", "r", ["x"]).count() == 1


def test_merges(spark, tmp_path):
    base = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, s string, n int")
    delta = spark.createDataFrame([(1, "", 0), (3, "z", 7)], "k int, s string, n int")
    merged = {r.k: (r.s, r.n) for r in merging.merge_known(base, delta, ["k"], ["s"], ["n"]).collect()}
    assert merged == {1: ("x", 0), 2: ("y", 6), 3: ("z", 7)}
    again = merging.merge_known(spark.createDataFrame([(k, *v) for k, v in merged.items()], "k int, s string, n int"), delta, ["k"], ["s"], ["n"])
    assert {r.k: (r.s, r.n) for r in again.collect()} == merged
    assert not merging.replace_snapshot(base.where("false"), str(tmp_path / "t"))
    changes = {r.k: r.change for r in merging.diff(base, delta, ["k"], ["s"]).collect()}
    assert changes == {1: "changed", 2: "removed", 3: "new"}


def test_texts(spark):
    d = spark.createDataFrame([("유치권 신고 있음. 가등기 없음",), (None,)], "t string")
    assert [r[0] for r in d.select(text.labels(F.col("t"), {"유치권": "유치권", "가등기": "가등기"})).collect()] == [["유치권"], []]
    one = spark.range(1)
    assert one.select(text.korean_number(F.lit("2억 8,000")), text.korean_number(F.lit("3억5천만")), text.korean_number(F.lit("x"))).first()[:] == (280_000_000, 350_000_000, None)
    assert one.select(text.masked_names(F.lit("임차인 홍길동 전입"))).first()[0] == "임차인 [성명] 전입"
    assert one.select(text.floor_of(F.lit("가동 1 지하 1층")), text.floor_of(F.lit("가동 3층 12층")), text.floor_of(F.lit("가동"))).first()[:] == (0, 3, None)


def test_masks(spark):
    cases = {
        "임차인 홍길동, 김철수 전입": "임차인 [성명], [성명] 전입",
        "채무자 한국전력공사, 박영희의 지분": "채무자 한국전력공사, [성명]의 지분",
        "소유자 전원의 지분": "소유자 전원의 지분",
        "윤용섭 지분 2분의 1": "[성명] 지분 2분의 1",
        "공유자 배우자 이순신": "공유자 배우자 [성명]",
        "신청인 서울보증보험주식회사": "신청인 서울보증보험주식회사",
    }
    rows = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    assert [(r.m, r.want) for r in rows.select(text.masked_names("t").alias("m"), "want").collect()] == [(w, w) for w in (*cases.values(), None)]
    assert spark.range(1).select(text.names_left(F.lit("세입자 홍길동 거주")), text.names_left(F.lit("임차인 [성명] 전입"))).first()[:] == (True, False)


def test_names_of_brands(spark):
    keys = spark.createDataFrame([("e편한세상 가동",), ("이편한세상가동",)], "n string").select(text.name_key(F.col("n"))).distinct()
    assert keys.count() == 1
    assert estimated(spark, [trade(500_000_000, name="e편한세상")] * 3, apt_name="이편한세상").scope == L.SAME_SAME


def test_unverified_rights_leave_no_score(spark):
    unverified, barred = score_of(spark, rights_verified=False), score_of(spark, rights_verified=False, special_rights=["유치권"])
    assert unverified.first().arb_score is None and barred.first().arb_score is not None
    both = unverified.unionByName(score_of(spark, case_no="2", appraisal_price=900_000_000))
    assert [r.case_no for r in L.ordered(both, "score").collect()] == ["2", "1"]


def test_confirmed_estimates_of_all_listings(spark):
    kinds = "court string, case_no string, item_no string, trade_ymd string, price bigint, deleted int, floor int"
    rows = [("c", case, "1", "20260100", 500_000_000, 0, 9) for case in "124" for _ in range(3)] + [("c", "1", "1", "20260100", 450_000_000, 0, 1)] * 3
    listed = spark.createDataFrame([listing(address="서울 가동 1 1층"), listing("2", property_type="토지"), listing("3"), listing("4", special_rights=["지분"])], COLUMNS)
    got = {r.case_no: r for r in L.estimate_confirmed(listed, spark.createDataFrame(rows, kinds)).collect()}
    assert {k: r.scope for k, r in got.items()} == {"1": L.SAME_SAME, "2": "unsupported", "3": "no_comps", "4": "share_sale"}
    assert got["1"].est == 427_500_000 and all(got[k].est is None for k in "234")  # 475 million, and a low floor costs a tenth there


def test_archive_and_snapshot_keep_what_is_stored(spark, tmp_path):
    from hammerlake.sources import sinks

    path, rows = str(tmp_path / "raw"), lambda *r: spark.createDataFrame([*r], "uid string, at int, body string")
    sinks.archive(rows(("a", 1, "x"), ("b", 1, "x")), path, "uid", "at")
    sinks.archive(rows(("b", 2, "y")), path, "uid", "at")
    assert {(r.uid, r.body) for r in spark.read.parquet(path).collect()} == {("a", "x"), ("b", "y")}
    broken = rows(("c", 1, "z")).withColumn("body", F.raise_error(F.lit("midway")).cast("string"))
    with pytest.raises(Exception, match="midway"):
        merging.swap_in(broken, path)
    assert spark.read.parquet(path).count() == 2
    merging.replace_snapshot(spark.read.parquet(path).where("uid = 'a'"), path)
    assert spark.read.parquet(path).count() == 1
    kept = merging.replace_children(spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k int, seq int"), spark.createDataFrame([(1, 0)], "k int, seq int"), ["k"])
    assert sorted(map(tuple, kept.collect())) == [(1, 0), (2, 0)]


def test_a_gate_that_fails_at_run_time_fails_alone(spark):
    from hammerlake.operators import gates

    rows = spark.range(3).toDF("k")
    found = gates.run(spark, {"good": lambda: gates.violations("good", rows.where("k > 9")), "bad": lambda: gates.violations("bad", rows.where(F.raise_error(F.lit("no")).cast("boolean"))), "unknown": lambda: gates.violations("unknown", rows.where("nothing = 1"))})
    assert {r.gate: (r.violations, r.ok) for r in found.collect()} == {"good": (0, True), "bad": (None, False), "unknown": (None, False)}


def test_taxes(spark):
    tax = lambda p, kind="아파트", area=84.0, **k: spark.range(1).select(money.acquisition_tax(F.lit(p).cast("bigint"), F.lit(kind), F.lit(area), **k)).first()[0]
    assert tax(500_000_000) == 5_500_000
    assert tax(750_000_000) == 16_500_000
    assert tax(1_000_000_000, area=100.0) == 35_000_000
    assert tax(100_000_000, "상가") == 4_600_000
    assert tax(100_000_000, houses=3) == 8_400_000
    assert tax(100_000_000, corporation=True) == 12_400_000


def plain_simulation(bid, sale, kind, area, mode, months, houses, regulated):
    """The same simulation in plain Python."""
    housing = kind == "아파트"
    part = lambda x: round(x)
    heavy_buy = {0: 0, 8: 8, 12: 12}[money.surcharge(houses, regulated)]
    base = heavy_buy / 100 if heavy_buy else 0.01 if bid <= 600_000_000 else round(bid * 2 / 300_000_000 - 3, 4) / 100 if bid <= 900_000_000 else 0.03
    if housing:
        rural = {0: 0.002, 8: 0.006, 12: 0.010}[heavy_buy] if area > 85 else 0
        buy = part(bid * base) + part(bid * (0.004 if heavy_buy else base * 0.5 * 0.20)) + part(bid * rural)
    else:
        buy = part(bid * 0.04) + part(bid * 0.004) + part(bid * 0.002)
    stamp = next(v for cap, v in money.STAMPS if cap is None or bid <= cap)
    total = bid + buy + stamp + 500_000 + 3_000_000
    loan = part(bid * 0.7)
    interest = part(loan * 0.055 * months / 12)
    fee = 0
    if sale > 0 and housing:
        rate, most = next((r, m) for cap, r, m in money.HOUSING_FEES if cap is None or sale < cap)
        fee = min(part(sale * rate), most) if most else part(sale * rate)
    elif sale > 0:
        fee = part(sale * (0.005 if kind == "오피스텔" and area <= 85 else 0.009))
    narrow = buy + stamp + 500_000 + fee

    def progressive(b, more=0.0):
        return 0 if b <= 0 else next(max(0, round(b * (r + more)) - d) for cap, r, d in money.INCOME_BRACKETS if cap is None or b <= cap)

    as_home = housing or kind == "오피스텔"
    heavy, extra = as_home and regulated and houses >= 2, 0.3 if houses >= 3 else 0.2
    flat = (0.7 if as_home else 0.5) if months < 12 else (0.6 if as_home else 0.4) if months < 24 else None
    gain = sale - bid - narrow
    tbase = max(0, gain - 2_500_000)
    if mode == "none":
        tax = 0
    elif mode == "dealer":
        tax = max([progressive(max(0, gain - 3_000_000 - interest)), *([progressive(tbase, extra)] if heavy else []), *([round(tbase * flat)] if heavy and flat else [])])
    elif gain <= 0:
        tax = 0
    else:
        rate = 0 if flat or heavy or months // 12 < 3 else min(0.3, months // 12 * 0.02)
        b = max(0, gain - round(gain * rate) - 2_500_000)
        tax = max(round(b * flat) if flat else progressive(b), progressive(tbase, extra) if heavy else 0)
    return sale - total - interest - fee - tax - round(tax * 0.1)


def test_simulations_against_a_plain_model(spark):
    rng = random.Random(5)
    for mode, houses, regulated in (("dealer", 1, False), ("individual", 1, False), ("dealer", 3, True), ("individual", 2, True), ("none", 1, False)):
        rows = [(rng.choice([0, 9_000_000, *[rng.randrange(10_000_000, 1_500_000_000)] * 4]), rng.randrange(0, 2_000_000_000), rng.choice(["아파트", "오피스텔", "토지"]), rng.choice([59.0, 101.0]), rng.choice([6, 12, 23, 24, 40, 200])) for _ in range(40)]
        d = spark.createDataFrame(rows, "bid bigint, sale bigint, kind string, area double, months int")
        out = d.select(*d.columns, money.simulate(F.col("bid"), F.col("sale"), F.col("kind"), F.col("area"), houses, regulated, mode=mode, holding_months=F.col("months"))["net"].alias("net")).collect()
        for r in out:
            assert r.net == plain_simulation(r.bid, r.sale, r.kind, r.area, mode, r.months, houses, regulated), (mode, r)


def test_break_even_is_the_last_bid_with_a_profit(spark):
    d = spark.createDataFrame([(500_000_000, "아파트", 84.0), (90_000_000, "토지", 50.0), (1_000_000, "아파트", 84.0)], "sale bigint, kind string, area double")
    for r in d.select("*", money.break_even(F.col("sale"), F.col("kind"), F.col("area")).alias("most")).collect():
        net = lambda b: plain_simulation(b, r.sale, r.kind, r.area, "dealer", 6, 1, False)  # noqa: B023, E731
        assert r.most is None if net(0) <= 0 else net(r.most) > 0 >= net(r.most + 1)


def test_coordinates_against_the_way_back(spark):
    """Degrees to projected metres, step by step in plain Python, and back by the columns."""
    import math

    from hammerlake.functions import coords as G

    def space(lon, lat, a, f):
        e2 = f * (2 - f)
        n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
        return n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * math.sin(lat)

    def project(lon, lat):
        x, y, z = space(math.radians(lon), math.radians(lat), *G.WGS84)
        dx, dy, dz, *angles, ppm = G.SHIFT
        rx, ry, rz = (math.radians(v / 3600) for v in angles)
        p, q, s = x - dx, y - dy, z - dz
        for _ in range(20):  # the shift's inverse, by iteration
            k = 1 + ppm * 1e-6
            u, v, w = k * (p - rz * q + ry * s), k * (rz * p + q - rx * s), k * (-ry * p + rx * q + s)
            p, q, s = p + x - dx - u, q + y - dy - v, s + z - dz - w
        a, f = G.BESSEL
        e2, lon, lat = f * (2 - f), math.atan2(q, p), math.atan2(s, math.hypot(p, q) * (1 - f * (2 - f)))
        for _ in range(20):
            n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
            lat = math.atan2(s + e2 * n * math.sin(lat), math.hypot(p, q))
        n, t, c, d = a / math.sqrt(1 - e2 * math.sin(lat) ** 2), math.tan(lat) ** 2, e2 / (1 - e2) * math.cos(lat) ** 2, (lon - math.radians(G.LON_0)) * math.cos(lat)
        ep2 = e2 / (1 - e2)
        east = G.SCALE * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * d**5 / 120)
        north = G.SCALE * (G._meridian(lat, a, e2) - G._meridian(math.radians(G.LAT_0), a, e2) + n * math.tan(lat) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * d**6 / 720))
        return G.X_0 + east, G.Y_0 + north

    places = [(126.978, 37.5665, "서울특별시 중구"), (129.075, 35.18, "부산광역시 연제구"), (126.53, 33.5, "제주특별자치도"), (128.0, 38.0, "강원도"), (130.9, 37.2, "경상북도")]
    rows = spark.createDataFrame([(*project(lon, lat), lon, lat, a) for lon, lat, a in places] + [(0.0, 5.0, None, None, None), (None, 1.0, None, None, None)], "x double, y double, lon double, lat double, address string")
    got = rows.select("*", G.to_wgs84(F.col("x"), F.col("y")).alias("g")).collect()
    assert all(abs(r.g.lon - r.lon) < 1e-7 and abs(r.g.lat - r.lat) < 1e-7 for r in got[:5]) and [r.g for r in got[5:]] == [None, None]
    # Seoul's city hall in the projection, as maps of that time have it
    assert abs(got[0].x - 309_950) < 150 and abs(got[0].y - 552_100) < 150
    ok = rows.where("lon is not null").select(G.plausible(F.col("lon"), F.col("lat"), F.col("address")), G.plausible(F.col("lon"), F.col("lat"), F.lit("대구광역시"))).collect()
    assert [tuple(r) for r in ok] == [(True, False)] * 5


def test_numbers(spark):
    one = spark.range(1)
    assert one.select(numbers.lenient_number(F.lit("1,234.9")), numbers.lenient_number(F.lit("-")), numbers.iso_date(F.lit("20260701"))).first()[:] == (1234, None, "2026-07-01")
    assert one.select(numbers.month_text(F.lit(2026 * 12 + 12)), numbers.month_of(F.lit("202612")), numbers.month_of(F.lit("x"))).first()[:] == ("202612", 2026 * 12 + 12, None)


def test_steps_and_rates(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 5, 6, 5])], "k int, at int, v int")
    assert ranking.steps(rows, "k", ["at"], "v").count() == 3
