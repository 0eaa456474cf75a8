"""Profiles against plain Python, the days in an interval, and the lowest price that gains."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from hammerlake.functions import money, profiles, text
from hammerlake.plans import listings as L


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_first_of_june(spark):
    for begin, months, want in (("2024-05-31", 6, 1), ("2024-06-01", 6, 0), ("2024-06-01", 12, 1), ("2023-12-01", 6, 1), ("2023-12-02", 30, 3), ("2024-07-01", 10, 0)):
        a = datetime.date.fromisoformat(begin)
        found = one(spark, profiles.days_within(F.lit(a), F.add_months(F.lit(a), months)))
        assert found == want, (begin, months)


@pytest.mark.parametrize(("gain", "tax"), [(-5, 0), (100_000_000, 10_000_000), (300_000_000, 40_000_000), (21_000_000_000, 20_000_000 + 19_800_000_000 // 5 + 220_000_000)])
def test_marginal(spark, gain, tax):
    assert one(spark, profiles.marginal(F.lit(gain), profiles.CORP_BRACKETS)) == tax


def plain_corp(bid, sale, area, junes):
    up = lambda x: math.floor(x + 0.5)
    acquired = up(bid * 0.12) + up(bid * 0.004) + (up(bid * 0.01) if area > 85 else 0)
    stamp, fee = next(v for cap, v in money.STAMPS if cap is None or bid <= cap), up(sale * 0.004)
    interest = up(up(bid * 0.7) * 0.055 * 18 / 12)
    total = bid + acquired + stamp + 500_000 + 3_000_000
    gain, over = sale - total - interest - fee, sale - bid - acquired - stamp - 500_000
    national = up(max(0, min(gain, 200_000_000)) * 0.1 + max(0, gain - 200_000_000) * 0.2) + up(max(0, over) * 0.2)
    base = sale * 0.7 * 0.6
    own = up(60_000 + (base - 60_000_000) * 0.0015) if base <= 150_000_000 else up(195_000 + (base - 150_000_000) * 0.0025) if base <= 300_000_000 else up(570_000 + (base - 300_000_000) * 0.004)
    yearly = junes * (own + up(base * 0.0014) + up(own * 0.2))
    return sale - total - interest - yearly - fee - national - up(national * 0.1)


@pytest.mark.parametrize(("bid", "sale", "area"), [(300_000_000, 400_000_001, 84.0), (300_000_000, 310_000_000, 99.0), (500_000_000, 899_999_999, 101.0)])
def test_company(spark, bid, sale, area):
    facts = {"bid": F.lit(bid), "sale": F.lit(sale), "kind": F.lit("아파트"), "area": F.lit(area), "regulated": F.lit(False), "sale_date": F.lit("2024-03-01")}
    assert one(spark, profiles.outcome("corp", 18, **facts)).net == plain_corp(bid, sale, area, 2)  # paid on 2024-04-14


def test_lowest_sale(spark):
    facts = {"kind": F.lit("아파트"), "area": F.lit(84.0), "regulated": F.lit(True), "sale_date": F.lit("2024-03-01"), "houses": 2}
    rows = spark.createDataFrame([(300_000_000, 0), (50_000_000, 900_000_000)], "bid long, sale long")
    for p in profiles.PROFILES:
        low = rows.select("bid", profiles.lowest_sale(p, 18, F.col("bid"), F.col("sale"), **facts).alias("low"))
        net = lambda d: profiles.outcome(p, 18, F.col("bid"), F.col("low") + d, **facts)["net"]  # noqa: E731, B023
        assert [(r.a > 0, r.b > 0) for r in low.select(net(0).alias("a"), net(-1).alias("b")).collect()] == [(True, False)] * 2


def masked(spark, said):
    df = spark.createDataFrame([(x,) for x in said], "t string").select(text.masked_names(F.col("t")).alias("t")).select("t", text.names_left(F.col("t")).alias("left"))
    return [tuple(r) for r in df.collect()]


def test_every_role_is_masked(spark):
    assert masked(spark, [f"{role} 홍길동, 김철수의 청구" for role in text.ROLES]) == [(f"{role} [성명], [성명]의 청구", False) for role in text.ROLES]
    kept = ["근저당권자 신한은행", "지상권자 한국전력", "근저당권자 지에스칼텍스(주)", "채권자 제출 보정서", "소유자 미상의 점유", "현장조사 당시 소유자 확인", "공유자의 지분", "임차인 전원"]
    assert [m for m, _ in masked(spark, kept)][:5] + [m for m, _ in masked(spark, kept)][6:] == kept[:5] + kept[6:]
    assert masked(spark, ["임차인 전원철, 박화란", "홍길동 소유", "홍길동 소유권", "윤용섭로부터 지분"]) [:3] == [("임차인 [성명], [성명]", False), ("[성명] 소유", False), ("홍길동 소유권", False)]


def test_the_canary_needs_no_list(spark):
    assert [x for _, x in masked(spark, ["가등기권자 홍길동", "분양권자: 이순신이 점유", "가등기권자 국민은행", "가등기권자 미상", "세입자 김철수", "근저당권자 홍길동", None])] == [True, True, False, False, True, False, None]


def test_order_of_estimators(spark):
    """A value counts, a lack falls back, a contradiction bars the fallback."""
    keys, rest = "court string, case_no string, item_no string", "est long, band_low long, basis long, window_mult double, scope string"
    confirmed = spark.createDataFrame([("c", "1", "1", 5, 4, 3, 0.9, "same_complex_same_area"), ("c", "2", "1", None, None, 2, 1.0, "no_comps"), ("c", "3", "1", None, None, 9, 1.0, "appraisal_mismatch")], f"{keys}, {rest}")
    by_name = spark.createDataFrame([("c", str(k), "1", 100 + k, 7, "same_dong_fallback", 90, 100 + k, 6, 0.92) for k in range(1, 5)], f"{keys}, est long, matched long, scope string, band_low long, band_high long, basis long, floor_mult double")
    got = {r.case_no: (r.source, r.est, r.scope, r.window_mult) for r in L.in_order(confirmed, by_name).collect()}
    assert got == {"1": ("confirmed", 5, "same_complex_same_area", 0.9), "2": ("by_name", 102, "same_dong_fallback", 1.0), "3": ("blocked", None, "appraisal_mismatch", 1.0), "4": ("by_name", 104, "same_dong_fallback", 1.0)}
