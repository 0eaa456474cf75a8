"""Queries over the domain's own functions: court texts, records, closed sales, filters, orders and gates.

There is no table of sales among the inputs. Each query makes one of all rows of a table: a row's keys choose its wording and its
values, so that the SQL can give the answer from the keys and never from the wording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerlake.functions import detail, rights, text
from hammerlake.operators import lookups, merging, ranking
from hammerlake.plans import audits, closed, listings
from hammerlake.plans.registry import query
from hammerlake.sources import records

c = F.col
K, C = "o_orderkey", "o_custkey"


def chosen(key: str, values: list) -> Column:
    """The value that a key's remainder chooses; null where it is None."""
    return F.element_at(F.array(*map(F.lit, values)), (c(key) % len(values) + 1).cast("int"))


def in_sql(key: str, values: list) -> str:
    said = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) for v in values)
    return f"([{said}])[({key} % {len(values)} + 1)::INTEGER]"


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


# court texts ----------------------------------------------------------------------------------------------------------
RIGHTS_A = [("유치권 신고 있음", "유치권"), ("유치권 신고 없음", ""), ("법정지상권 성립 여지 있음", "법정지상권"), ("대지권미등기임", "대지권미등기"), ("대지권 유무 알 수 없음, 대지권 없음", "대지권미등기"), ("제시외 건물 포함", "위반건축물"), ("공유자의 2분의 1", "지분"), ("매각에 따라 설정된 것으로 보는 지상권의 개요", ""), ("분묘 있음", "분묘기지권")]
RIGHTS_B = [("가처분 등기됨", "가처분"), ("가등기 설정된 바 없음", ""), ("토지 별도등기 있음", "토지별도등기"), ("유치권 여부는 불분명", "유치권"), ("특이사항 기재", "")]


@query(f"SELECT o_orderkey, array_to_string(list_filter([{', '.join(repr(x) for x in rights.SPECIAL)}], lambda x: x IN (a, b)), ',') AS labels FROM (SELECT o_orderkey, {in_sql(K, [x[1] for x in RIGHTS_A])} AS a, {in_sql(C, [x[1] for x in RIGHTS_B])} AS b FROM orders)")
def special_rights(t):
    return t("orders").select(K, joined(rights.special_rights(chosen(K, [x[0] for x in RIGHTS_A]), F.lit(None).cast("string"), chosen(C, [x[0] for x in RIGHTS_B]))).alias("labels"))


# wording; what the buyer takes over; whether a tenant can stay
TERMS = [("매수인이 인수함 보증금 금 150,000,000원", 150_000_000, True), ("임차권등기 말소 동의함", 0, False), ("특이사항 기재", 0, False), ("보증금 1억9천5백만원 매수인에게 인수", 195_000_000, True), ("보증금 금 8천만원은 매수인이 인수하지 아니함", 0, False), ("임차권 5천만원과 임차권 2억 3,000만원 미배당", 280_000_000, False), ("소멸되지 않는 전세권 70,000,000원 부담", 70_000_000, False)]
NOTES = [("비고란 기재", 0, False), ("금 50,000,000원 중 미반환 금 3천만원 매수인 인수", 30_000_000, True), ("위 보증금 1억원 인수됨을 재안내", 0, False), ("대항력 있는 임차권", 0, True), ("말소되는 근저당 90,000,000원 부담 없음", 0, False)]
SURVEYS = [("다수 점유", "다수점유"), ("임차인이 점유", "임차인"), ("소유자 점유", "소유자점유"), ("공실임", "공실"), ("", "소유자점유")]
REPORTS = [("감정평가액 금 120,000,000원", 120_000_000), ("", 0), ("감정평가액 98,500,000원", 98_500_000)]
RATES = [("매수신청보증금은 최저매각가격의 20%", 20), ("보증금은 5%", None), ("보증금 30% 및 보증금 10%", 30), ("특이사항 기재", None)]


def _terms() -> Column:
    return F.concat(chosen(K, [x[0] for x in TERMS]), F.lit("\n"), chosen(C, [x[0] for x in NOTES]))


@query(f"SELECT o_orderkey, (a + b)::BIGINT AS assumed_amount, p OR q AS tenant_opposable, occupant_type, appraisal::BIGINT AS appraisal_amount, (o_orderkey % 5 = 4)::INTEGER + (o_custkey % 3 = 1)::INTEGER > 0 AS partial FROM (SELECT o_orderkey, o_custkey, {in_sql(K, [x[1] for x in TERMS])} AS a, {in_sql(C, [x[1] for x in NOTES])} AS b, {in_sql(K, [x[2] for x in TERMS])} AS p, {in_sql(C, [x[2] for x in NOTES])} AS q, {in_sql(K, [x[1] for x in SURVEYS])} AS occupant_type, {in_sql(C, [x[1] for x in REPORTS])} AS appraisal FROM orders)")
def rights_struct(t):
    found = t("orders").select(K, rights.parsed(_terms(), chosen(K, [x[0] for x in SURVEYS]), chosen(C, [x[0] for x in REPORTS])).alias("r"))
    return found.select(K, "r.assumed_amount", "r.tenant_opposable", "r.occupant_type", "r.appraisal_amount", "r.partial")


@query(f"SELECT o_orderkey, coalesce(r, 10)::INTEGER AS rate, r IS NOT NULL AS stated, round_even(floor(o_totalprice)::BIGINT * coalesce(r, 10) / 100, 0)::BIGINT AS amount FROM (SELECT *, {in_sql(K, [x[1] for x in RATES])} AS r FROM orders)")
def bid_deposit(t):
    return t("orders").select(K, rights.bid_deposit(F.floor("o_totalprice").cast("bigint"), chosen(K, [x[0] for x in RATES])).alias("d")).select(K, "d.rate", "d.stated", "d.amount")


@query("SELECT o_orderkey, concat_ws(' / ', CASE WHEN o_orderkey % 9 = 0 OR o_custkey % 5 = 3 THEN '치명적 특수권리: 유치권' END, CASE WHEN o_custkey % 4 = 1 THEN '인수금액 비율 50% (>30%)' END) AS reasons FROM orders")
def gate_reasons(t):
    labels = rights.special_rights(chosen(K, [x[0] for x in RIGHTS_A]), chosen(C, [x[0] for x in RIGHTS_B]))
    return t("orders").select(K, F.array_join(rights.gate_reasons(labels, F.when(c(C) % 4 == 1, 100).otherwise(60), F.lit(200)), " / ").alias("reasons"))


PRIORITY = "SELECT o_orderkey, CASE WHEN k % 4 <> 0 AND k % 11 < 3 THEN 'confirmed_opposable' WHEN k % 13 = 0 AND (k % 4 <> 0 OR u % 3 <> 0) AND NOT (k % 4 <> 0 AND u % 3 = 0) THEN 'possible_opposable' WHEN k % 4 <> 0 AND u % 3 = 0 THEN 'contradiction' WHEN k % 4 <> 0 THEN 'not_opposable' WHEN u % 3 = 0 THEN 'dates_incomplete' WHEN k % 13 = 0 THEN 'possible_opposable' ELSE 'no_basis' END AS verdict FROM (SELECT o_orderkey, o_orderkey AS k, o_custkey AS u FROM orders)"


@query(PRIORITY)
def priority_verdict(t):
    day = lambda n: F.date_format(F.date_add(c("o_orderdate").cast("date"), n), "yyyy.M.d")
    moved = F.when(c(K) % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(day((c(K) % 11 - 2).cast("int")), day(F.lit(400))))
    unclear = F.when(c(K) % 13 == 0, F.array(day(F.lit(0)))).otherwise(F.array().cast("array<string>"))
    surviving = F.when(c(C) % 3 == 0, "을구 5번 임차권 인수").when(c(C) % 3 == 1, "해당사항 없음.")
    return t("orders").select(K, detail.priority(F.concat(F.lit("근저당권 "), day(F.lit(0))), surviving, F.lit(""), moved, unclear)["verdict"].alias("verdict"))


@query("SELECT l_orderkey, coalesce(sum(floor(l_extendedprice)) FILTER (l_returnflag = 'R' AND l_shipdate::DATE <= o_orderdate::DATE + 60), 0)::BIGINT AS deposits, count(*) FILTER (l_returnflag = 'R') AS tenants, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS unclear FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def tenant_deposits(t):
    tenant = F.struct((c("l_returnflag") == "R").alias("is_tenant_like"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("movein_ymd"), F.floor("l_extendedprice").cast("bigint").alias("deposit"), F.when(c("l_linestatus") == "O", "소유자와의 관계를 알 수 없는 세대").otherwise("채무자 겸 소유자가 점유").alias("possession"))
    homes = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(tenant).alias("tenants")).join(t("orders").select(c(K).alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    senior = F.concat(F.lit("근저당 "), F.date_format(F.date_add(c("o_orderdate").cast("date"), 60), "yyyy-MM-dd"))
    return homes.select("l_orderkey", detail.opposable_deposits(c("tenants"), senior).alias("deposits"), F.size(detail.tenant_moveins(c("tenants"))).cast("long").alias("tenants"), F.size(detail.unclear_moveins(c("tenants"))).cast("long").alias("unclear"))


@query("WITH x AS (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') || '#' || l_linenumber || '#' || l_partkey AS ymd, l_returnflag AS f, floor(l_extendedprice)::BIGINT AS p FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ymd, p) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM x), s AS (SELECT l_orderkey, count(*) AS sold_count, max(i) AS i FROM y WHERE f = 'R' AND i < n GROUP BY 1) SELECT s.l_orderkey, s.sold_count, a.ymd AS last_sold_ymd, a.p AS floor, coalesce((SELECT CASE arg_max(z.f, z.i) WHEN 'A' THEN '대금 미납' END FROM y z WHERE z.l_orderkey = s.l_orderkey AND z.i > s.i AND z.f = 'A'), '사유 미상') AS reason FROM s JOIN y a ON a.l_orderkey = s.l_orderkey AND a.i = s.i")
def resale_history(t):
    day = F.concat_ws("#", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_linenumber", "l_partkey")
    round_ = F.struct(day.alias("ymd"), F.when(c("l_returnflag") == "R", "매각").when(c("l_returnflag") == "A", "미납").otherwise("유찰").alias("result"), F.floor("l_extendedprice").cast("bigint").alias("price"), F.lit(None).cast("bigint").alias("sold"))
    found = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(round_)).alias("s")).select("l_orderkey", F.explode(F.array(detail.resale(c("s")))).alias("r")).where("r is not null")  # by way of an array, or the condition reads each schedule a second time
    return found.select("l_orderkey", c("r.sold_count").cast("long").alias("sold_count"), "r.last_sold_ymd", "r.floor", "r.reason")


CLEAN = "o_orderkey % 7 IN (1, 4) AND o_custkey % 3 <> 0 AND o_custkey % 5 NOT IN (1, 3)"


@query(f"SELECT o_orderkey, CASE WHEN {CLEAN} THEN 'clean' ELSE 'burden' END AS status, CASE WHEN a + b > 0 THEN a + b WHEN NOT ({CLEAN}) AND o_custkey % 5 = 2 THEN 100000000 ELSE 0 END::BIGINT AS assumed FROM (SELECT *, {in_sql(K, [x[1] for x in TERMS])} AS a, {in_sql(C, [x[1] for x in NOTES])} AS b FROM orders)")
def rights_badge(t):
    remark, surviving = chosen(C, ["", *[x[0] for x in NOTES[1:]]]), chosen(K, [x[0] for x in TERMS])
    found = detail.badge(surviving, F.lit("해당사항없음"), remark, F.when(c(C) % 3 == 0, "전세권 2020.1.1").otherwise("근저당 2020.1.1"))
    return t("orders").select(K, found.alias("b")).select(K, "b.status", "b.assumed")


# records --------------------------------------------------------------------------------------------------------------
USAGES = [("아파트", "아파트"), ("상가,오피스텔", "혼합"), ("아파트형공장", "상가"), ("도시형생활주택", "다세대"), ("다가구주택", "단독"), ("창고시설의 이름이 아주 길게 이어진다", "창고시설의 이름이 아주"), ("", "기타"), ("임야", "토지")]
CODES = [("20104", "아파트"), ("", None), ("10105", "토지"), ("99999", None), ("22101", "공장")]
RECORD_FIELDS = {
    "area_m2": ([("철근 33.56㎡", 33.56), ("면적 없음", 84.0), ("120 ㎡ 외 3㎡", 120.0)], lambda x: records.area(x, F.lit("84㎡"))),
    "lawd_cd": ([("11110", "11110"), (",47290", "47290"), ("5115, 42150", "42150"), ("12,34", "1234")], records.district),
    "share": ([("갑구 2분의 1 지분 전부", True), ("공유자 전원의 지분 1/2", False), ("지분 3분의 1", True), ("500분의 21.7", False)], lambda x: records.share_sale(x, F.lit("없음"))),
    "floor": ([("금 295,400,000원의 매수신청", 295_400_000), ("없음", 0), ("1,000,000원 매수신청, 2,000,000원 매수신청", 2_000_000)], records.creditor_floor),
    "case_no": ([("20230130002726", "2023타경2726"), ("20230131002726", None), ("2023", None)], records.case_number),
    "serial": ([("2025-101763", 101763), ("광주지방법원 2025타경 55", 55), ("101763", 101763), ("12 9999 3", 9999), ("아파트", None)], lambda x: records.case_query(x)["serial"]),
    "year": ([("2025-101763", 2025), ("광주지방법원 2025타경 55", 2025), ("101763", None), ("1203 7", None)], lambda x: records.case_query(x)["year"]),
    "day": ([("2026-07-15", "수"), ("20260715", ""), ("2024-02-30", ""), ("2024-02-29", "목")], text.weekday),
    "name": ([("e편한 세상(주상복합)", "이편한세상"), ("이편한세상 아파트", "이편한세상"), ("GS자이", "지에스자이"), ("LH 2단지", "엘에이치2단지")], text.name_key),
    "blocks": ([("푸른마을 2단지 3차", "2,3"), ("푸른마을 1블럭", ""), ("10차", "10")], lambda x: joined(text.block_numbers(x))),
}


@query(f"SELECT o_orderkey, CASE WHEN kind IN ('아파트', '오피스텔', '다세대', '연립', '빌라') AND o_custkey % 3 = 0 THEN '토지' ELSE kind END AS property_type FROM (SELECT o_orderkey, o_custkey, coalesce({in_sql(C, [x[1] for x in CODES])}, {in_sql(K, [x[1] for x in USAGES])}) AS kind FROM orders)")
def property_types(t):
    kind = records.property_type(chosen(K, [x[0] for x in USAGES]), chosen(C, [x[0] for x in CODES]))
    return t("orders").select(K, records.checked_type(kind, c(C) % 3 != 0, F.lit(True)).alias("property_type"))


@query("SELECT o_orderkey, " + ", ".join(f"{in_sql(K, [x[1] for x in cases])} AS {name}" for name, (cases, _) in RECORD_FIELDS.items()) + " FROM orders")
def record_fields(t):
    return t("orders").select(K, *[f(chosen(K, [x[0] for x in cases])).alias(name) for name, (cases, f) in RECORD_FIELDS.items()])


@query("SELECT l_orderkey::VARCHAR AS case_no, arg_min(greatest(coalesce(floor(l_extendedprice)::BIGINT, 0), 0), (CASE WHEN l_returnflag = 'R' THEN '0' ELSE '1' END) || lpad(coalesce(l_linenumber::VARCHAR, ''), 11, '0') || lpad(coalesce(l_partkey::VARCHAR, ''), 20, '0') || lpad(place::VARCHAR, 19, '0')) AS min_bid_price FROM (SELECT *, row_number() OVER () AS place FROM lineitem) GROUP BY 1")
def item_rows(t):
    s = lambda x: F.lit(x)
    # as wide as the largest number and its sign, or large ones would lose their last digits
    wide = lambda x, n: F.lpad(F.coalesce(c(x).cast("string"), s("")), n, "0")
    # some lines of an order have one number and one part: the one that is written first is the first
    place = F.concat(c("_metadata.file_path"), wide("_metadata.row_index", 19))
    raw = t("lineitem").select(s("c").alias("court"), c("l_orderkey").cast("string").alias("case_no"), s("1").alias("item_no"), F.concat(wide("l_linenumber", 11), wide("l_partkey", 20), place).alias("doc_id"), F.when(c("l_returnflag") == "R", "건물").alias("buldNm"), s("").alias("buldList"), s("").alias("pjbBuldList"), s("대").alias("jimokList"), s("아파트").alias("dspslUsgNm"), s("").alias("sclsUtilCd"), s("").alias("maejibun"), s("").alias("mulBigo"), s("").alias("convAddr"), s("84㎡").alias("areaList"), s("500,000,000").alias("gamevalAmt"), s("0").alias("notifyMinmaePrice1"), F.floor("l_extendedprice").cast("bigint").cast("string").alias("minmaePrice"), s("11110").alias("lawdCd"), s("20260701").alias("maeGiil"))
    return records.to_listings(raw).select("case_no", "min_bid_price")


# sales ----------------------------------------------------------------------------------------------------------------
SCOPES = [listings.SAME_SAME, listings.SAME_NEAR, listings.SAME_DONG, "", None]
SALES = f"(SELECT o_orderkey::VARCHAR AS case_no, o_custkey::VARCHAR AS item_no, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE floor(o_totalprice)::BIGINT END AS sold_price, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE (o_custkey % 500 + 1) * 1000 END::BIGINT AS appraisal_price, {in_sql(C, SCOPES)} AS market_scope, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 900) * 500 END::BIGINT AS market_band_low, (o_orderkey % 4)::INTEGER AS fail_count, (o_custkey % 150 + 10)::DOUBLE AS area_m2, floor(o_totalprice)::BIGINT - 5000 AS min_bid_price, strftime(o_orderdate, '%Y-%m-%d') AS sale_date, o_orderpriority AS grade FROM orders)"


def _sales(t) -> DataFrame:
    low = F.when(c(K) % 6 != 0, (c(K) % 900) * 500).cast("bigint")
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return t("orders").select(F.lit("c").alias("court"), c(K).cast("string").alias("case_no"), c(C).cast("string").alias("item_no"), F.when(c(K) % 10 != 0, F.floor("o_totalprice")).cast("bigint").alias("sold_price"), F.when(c(C) % 7 == 0, 0).otherwise((c(C) % 500 + 1) * 1000).cast("bigint").alias("appraisal_price"), chosen(C, SCOPES).alias("market_scope"), low.alias("market_band_low"), low.alias("est_market_price"), nothing("profit_low", "bigint"), nothing("expected_profit", "bigint"), nothing("matched_trades", "int"), nothing("confidence", "double"), nothing("arb_score", "double"), (c(K) % 4).cast("int").alias("fail_count"), (c(C) % 150 + 10).cast("double").alias("area_m2"), (F.floor("o_totalprice") - 5000).cast("bigint").alias("min_bid_price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"), c("o_orderpriority").alias("grade"), F.lit("푸른마을").alias("apt_name"), F.lit("서울 가동").alias("address"), F.lit("아파트").alias("property_type"))


GAP = f"CASE WHEN market_scope = '{listings.SAME_SAME}' AND NOT coalesce(sold_price::DOUBLE / nullif(appraisal_price, 0) < 0.3, false) THEN market_band_low - sold_price END"


@query(f"SELECT case_no, {GAP} AS gap, CASE WHEN market_scope = '{listings.SAME_SAME}' THEN market_band_low END AS est_market_price, CASE WHEN market_band_low IS NOT NULL AND coalesce(market_scope, '') <> '{listings.SAME_SAME}' THEN '{listings.UNKNOWN}' ELSE grade END AS grade FROM {SALES}")
def closed_sales(t):
    rows = closed.market_policy(_sales(t).withColumn("gap", closed.gap()))
    return rows.select("case_no", "gap", "est_market_price", "grade")


@query(f"SELECT case_no, {GAP} AS gap FROM {SALES} WHERE area_m2 >= 40 AND area_m2 < 120 AND fail_count >= 1 AND min_bid_price BETWEEN 1 AND 200000 ORDER BY gap DESC NULLS LAST, case_no, item_no LIMIT 100")
def closed_search(t):
    rows = closed.search(_sales(t), words="푸른 마을", region="서울", kind="아파트", bid=(None, 200_000), area=(40, 120), fails=1)
    return ranking.top(rows, closed.order_by("profit"), 100).select("case_no", closed.gap().alias("gap"))


LISTED = f"(SELECT o_orderkey::VARCHAR AS case_no, o_custkey::VARCHAR AS item_no, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 37 % 1000 - 300) END::BIGINT AS profit_low, (o_custkey % 400)::BIGINT AS expected_profit, (o_custkey % 5 * 40)::BIGINT AS burden, o_custkey % 11 = 0 AS uncertain, o_orderkey % 3 = 0 AS rights_verified, {in_sql(C, SCOPES)} AS scope, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 10 END::BIGINT AS basis, CASE WHEN o_custkey % 6 = 0 THEN '위험' ELSE '양호' END AS grade, (o_custkey % 150 + 10)::DOUBLE AS area_m2, (o_orderkey % 100)::DOUBLE AS arb_score FROM orders)"
NET = "coalesce(profit_low, expected_profit) - burden"


def _listed(t) -> DataFrame:
    return t("orders").select(F.lit("c").alias("court"), c(K).cast("string").alias("case_no"), c(C).cast("string").alias("item_no"), F.when(c(K) % 9 != 0, c(K) * 37 % 1000 - 300).cast("bigint").alias("profit_low"), (c(C) % 400).cast("bigint").alias("expected_profit"), (c(C) % 5 * 40).cast("bigint").alias("burden"), (c(C) % 11 == 0).alias("uncertain"), (c(K) % 3 == 0).alias("rights_verified"), chosen(C, SCOPES).alias("scope"), F.when(c(K) % 8 != 0, c(K) % 10).cast("bigint").alias("basis"), F.when(c(C) % 6 == 0, "위험").otherwise("양호").alias("grade"), (c(C) % 150 + 10).cast("double").alias("area_m2"), (c(K) % 100).cast("double").alias("arb_score"), F.lit(1).alias("est"), F.lit(3).alias("fail_count"), F.lit("아파트").alias("property_type"), F.lit("부산 나동").alias("address"), F.lit("한빛").alias("apt_name"), F.lit(5).alias("min_bid_price"))


@query(f"SELECT case_no, {NET} AS net FROM {LISTED} WHERE {NET} >= 50 AND area_m2 >= 20 * 3.3058 AND area_m2 < 30 * 3.3058 AND NOT uncertain AND {NET} > 0")
def net_filters(t):
    rows = listings.search(_listed(t), words="한 빛", area="20", fails=2, profit=50, kind="아파트", region="부산", bid=(1, 10), evaluable=True, burden="burden")
    return listings.positive(rows, "burden", "uncertain").select("case_no", listings.net_profit("burden").alias("net"))


@query(f"SELECT case_no, tier, {NET} AS net FROM (SELECT *, CASE WHEN coalesce(profit_low, expected_profit) IS NULL OR scope IS NULL THEN 3 WHEN scope IN ('{listings.SAME_SAME}', '{listings.SAME_NEAR}') THEN 0 WHEN scope = '' THEN 1 ELSE 2 END AS tier FROM {LISTED}) ORDER BY tier, CASE WHEN uncertain OR NOT rights_verified THEN 1 ELSE 0 END, coalesce({NET}, 0) DESC, case_no, item_no LIMIT 200")
def net_order(t):
    return ranking.top(_listed(t), listings.order_by("profit", "burden", "uncertain"), 200).select("case_no", listings.scope_tier().alias("tier"), listings.net_profit("burden").alias("net"))


@query(f"SELECT case_no FROM {LISTED} WHERE rights_verified ORDER BY arb_score DESC, case_no, item_no LIMIT 100")
def score_order(t):
    return ranking.top(_listed(t), listings.order_by("score"), 100).select("case_no")


@query(f"SELECT case_no, profit_low IS NOT NULL AND coalesce(scope, '') = '{listings.SAME_SAME}' AND coalesce(basis, 0) >= 5 AS strict FROM {LISTED} WHERE coalesce(profit_low, expected_profit) > 0 AND grade <> '위험' AND coalesce(scope, '') IN ('', '{listings.SAME_SAME}') AND coalesce(basis, 5) >= 5")
def recommended(t):
    rows = _listed(t)
    strict = listings.recommended(rows, legacy=False).select("case_no", F.lit(True).alias("s"))
    return listings.recommended(rows).select("case_no").join(strict, "case_no", "left").select("case_no", F.coalesce("s", F.lit(False)).alias("strict"))


@query("SELECT o_orderkey, date_diff('day', DATE '1998-01-05', o_orderdate::DATE)::INTEGER AS days, o_orderdate::DATE > DATE '1998-01-05' OR (o_orderdate::DATE = DATE '1998-01-05' AND o_custkey % 3 = 0) AS upcoming FROM orders WHERE o_orderkey % 17 <> 0")
def upcoming(t):
    # bidding from 14:00 is still open at 12:30, from 10:00 or an hour that can't be read it is over
    rows = t("orders").select(K, F.when(c(K) % 17 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("sale_date"), chosen(C, ["1400", "1000", "2530"]).alias("sale_time"))
    now = F.lit("1998-01-05 12:30:00").cast("timestamp")
    return listings.split_upcoming(rows, now).select(K, listings.days_until(now.cast("date")).alias("days"), "upcoming")


@query("SELECT coalesce(p, '기타') AS province, count(*) AS n, count(*) FILTER (p IS NULL AND c_custkey % 4 = 2) AS no_address FROM (SELECT c_custkey, (['서울', '부산', NULL, NULL])[(c_custkey % 4 + 1)::INTEGER] AS p FROM customer) GROUP BY 1")
def province_counts(t):
    address = F.when(c("c_custkey") % 4 == 0, "서울 가동 1").when(c("c_custkey") % 4 == 1, "부산 나동 2").when(c("c_custkey") % 4 == 3, "어디 다동 3")
    rows = t("customer").select(text.province(address).alias("p"), address.alias("a"))
    return rows.groupBy(F.coalesce("p", F.lit("기타")).alias("province")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("a").isNull()).alias("no_address"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'below' WHEN p_retailprice > 1500 THEN 'above' ELSE 'inside' END AS position FROM part")
def band_position(t):
    return t("part").select("p_partkey", F.when(c("p_retailprice") < 1000, "below").when(c("p_retailprice") > 1500, "above").otherwise("inside").alias("position"))


@query("SELECT l_orderkey, l_linenumber, max(floor(l_extendedprice)::BIGINT) FILTER (l_returnflag <> 'A') AS amount FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2")
def sold_amounts(t):
    # amounts are text, some of them empty: those that can't be read don't count
    said = F.when(c("l_returnflag") != "A", F.format_number(F.floor("l_extendedprice"), 0)).otherwise("")
    from hammerlake.functions import numbers

    rows = t("lineitem").select("l_orderkey", "l_linenumber", numbers.lenient_number(said).alias("amount")).where("amount > 0")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("amount").alias("amount"))


@query("WITH p AS (SELECT o_custkey || '|' || o_orderpriority AS key, o_custkey::VARCHAR AS short FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '|' || o_orderpriority ELSE o_custkey::VARCHAR END AS key FROM orders WHERE o_orderstatus = 'O' EXCEPT (SELECT key FROM p UNION SELECT short FROM p)")
def watched_missing(t):
    whole, short = F.concat_ws("|", C, "o_orderpriority"), c(C).cast("string")
    watched = t("orders").where("o_orderstatus = 'O'").select(F.when(c(K) % 2 == 0, whole).otherwise(short).alias("key"))
    return lookups.absent_keys(watched, t("orders").where("o_orderstatus = 'F' and o_orderkey % 3 = 0"), "key", [whole, short])


@query("SELECT l_orderkey, l_linenumber, arg_min(l_partkey, l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def union_dedup(t):
    # two overlapping regions are read; a record that both have is one
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return merging.first(lines.where("l_partkey % 3 <> 0").unionByName(lines.where("l_partkey % 3 <> 1")), ["l_orderkey", "l_linenumber"], ["l_partkey"])


GATES = {
    "type_physical": "o_orderkey % 10 = 0",
    "code_and_type": "o_custkey % 5 = 1 AND NOT (o_orderkey % 4 = 0 AND o_orderkey % 2 = 0)",
    "extreme_estimate": "o_orderkey % 40 = 7",
    "no_orphans": "o_orderkey % 97 = 5",
    "share_sale": "o_orderkey % 97 <> 5 AND o_custkey % 13 = 0",
    "stale_sale": "o_orderdate::DATE < DATE '1995-01-01' - 3",
    "keys_and_prices": "false",
    "rights_json": "o_custkey % 50 = 0",
    "band_order": "o_orderkey % 60 = 1",
}


@query("SELECT gate, violations, violations = 0 AS ok FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER ({cond.replace('o_custkey % 5 = 1', 'o_orderkey % 97 <> 5 AND o_custkey % 5 = 1') if g == 'code_and_type' else 'o_orderkey % 97 <> 5 AND ' + cond if g == 'type_physical' else cond}) AS violations FROM orders" for g, cond in GATES.items()) + " UNION ALL SELECT 'field_canary', CASE WHEN count(*) >= 50 AND count(*) FILTER (o_orderkey % 8 <> 0) < 0.9 * count(*) THEN count(*) FILTER (o_orderkey % 8 = 0) ELSE 0 END FROM orders)")
def data_gates(t):
    return audits.run(*_gated(t))


_SAMPLED = " UNION ALL ".join(f"(SELECT '{g}' AS gate, o_orderkey::VARCHAR AS sample FROM orders WHERE {'o_orderkey % 97 <> 5 AND ' if g in ('type_physical', 'code_and_type') else ''}{cond} ORDER BY 2 LIMIT 5)" for g, cond in GATES.items())


@query(f"SELECT gate, sample FROM ({_SAMPLED})")
def gate_samples(t):
    return audits.samples(*_gated(t))


def _gated(t):
    o = t("orders")
    key = [F.lit("c").alias("court"), c(K).cast("string").alias("case_no"), F.lit("1").alias("item_no")]
    scored = o.select(*key, F.lit("아파트").alias("property_type"), F.when(c(K) % 4 == 0, listings.SAME_SAME).otherwise("").alias("market_scope"), F.when(c(K) % 40 == 7, 900).otherwise(100).alias("est_market_price"), F.when(c(K) % 8 != 0, 300).otherwise(0).alias("appraisal_price"), F.lit(80).alias("min_bid_price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"), F.when(c(K) % 60 == 1, 9).otherwise(1).alias("market_band_low"), F.lit(5).alias("market_band_high"), F.lit(1).alias("profit_low"), F.lit(2).alias("profit_high"))
    parts = o.where(c(K) % 97 != 5).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))  # an item has its land and its building
    land = c("part") == 0
    raw = parts.where(land | (c(K) % 10 != 0)).select(*key, F.when(~land, "동").alias("buldNm"), F.lit("").alias("buldList"), F.lit("").alias("pjbBuldList"), F.when(land, "대").alias("jimokList"), F.when((c(C) % 5 == 1) & land, "20110").otherwise("20104").alias("sclsUtilCd"), F.when((c(C) % 13 == 0) & land, "2분의 1 지분").alias("maejibun"), F.lit("").alias("mulBigo"), F.lit("").alias("alias"))
    opinions = o.select(*key, F.when(c(C) % 50 == 0, "[{").otherwise("[]").alias("schedule"))
    return scored, raw, opinions, scored.where(c("case_no").cast("long") % 2 == 0), "1995-01-01"
