"""The estimate itself as queries: each part is a listing, and its lines are trades (see ``cases`` for how such rows are made)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammerlake.functions import money
from hammerlake.operators import ranking
from hammerlake.plans import listings as L
from hammerlake.plans.cases import C, K, c, chosen
from hammerlake.plans.registry import query

P = "p_partkey"
TYPES, KINDS = ["아파트", "아파트", "오피스텔", "상가", "아파트"], ["apt", "apt", "offi", "etc", "apt"]
FLOORS = ["1층", "지하 1층", "15층", "9층", "3층", "2층"]


def _listings(t):
    far = F.when(c(P) % 4 == 0, 4).otherwise(25)
    shares = F.when(c(P) % 7 == 0, F.array(F.lit("지분"))).otherwise(F.array().cast("array<string>"))
    name = F.concat(F.lit("단지"), F.lpad(c(P).cast("string"), 8, "0"))
    return t("part").select(F.lit("C").alias("court"), c(P).cast("string").alias("case_no"), F.lit("1").alias("item_no"), chosen(P, TYPES).alias("property_type"), name.alias("apt_name"), F.lit("").alias("dong"), F.concat(F.lit("서울 가동 1 "), chosen(P, FLOORS)).alias("address"), F.lpad((c(P) % 25).cast("string"), 5, "0").alias("lawd_cd"), F.lit(84.9).alias("area_m2"), F.floor(c("p_retailprice") * 10_000 * far).cast("bigint").alias("appraisal_price"), shares.alias("special_rights"))


def _lines(t):
    ym = F.concat(F.when(c("l_suppkey") % 3 == 0, "1998").otherwise("2000"), F.date_format("l_shipdate", "MM"))
    price = F.floor(c("l_extendedprice") * 10_000).cast("bigint")
    return t("lineitem").select("l_partkey", "l_linenumber", price.alias("price"), ym.alias("deal_ym"), (c("l_suppkey") % 5).cast("int").alias("floor"), (c("l_returnflag") == "A").alias("cancelled"))


def _trades(t):
    name = F.concat(F.lit("단지"), F.lpad(c("l_partkey").cast("string"), 8, "0"))
    return _lines(t).select(name.alias("apt_name"), (c("l_linenumber") * 0.009 * 84.9 + 84.9).alias("area_m2"), "price", "deal_ym", F.lit("").alias("dong"), "floor", chosen("l_partkey", KINDS).alias("kind"), F.lpad((c("l_partkey") % 25).cast("string"), 5, "0").alias("lawd_cd"), "cancelled")


def _confirmed(t):
    rows = _lines(t).where("l_linenumber >= 4 and l_partkey % 3 > 0")
    return rows.select(F.lit("C").alias("court"), c("l_partkey").cast("string").alias("case_no"), F.lit("1").alias("item_no"), F.concat("deal_ym", F.lit("01")).alias("trade_ymd"), "price", c("cancelled").cast("int").alias("deleted"), "floor")


_ROWS = f"""a AS (SELECT p_partkey AS k, {'CASE ' + ' '.join(f"WHEN p_partkey % 5 = {i} THEN '{x}'" for i, x in enumerate(TYPES)) + ' END'} AS type, p_partkey % 6 AS f, floor(p_retailprice * 10000 * CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE 25 END)::BIGINT AS appraisal, p_partkey % 7 = 0 AS share FROM part),
x AS (SELECT l_partkey AS k, l_linenumber AS n, floor(l_extendedprice * 10000)::BIGINT AS price, CASE WHEN l_suppkey % 3 = 0 THEN 1998 ELSE 2000 END * 12 + month(l_shipdate) AS m, l_suppkey % 5 AS floor, l_linenumber * 0.009e0 * 84.9e0 + 84.9e0 AS area FROM lineitem WHERE l_returnflag <> 'A')"""
_TRIM = "SELECT {k}, count(*) AS basis, min(v) AS lo, median(v) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v) AS nth, count(*) OVER (PARTITION BY {k}) AS of FROM {rows}) WHERE of < 4 OR (nth > 1 AND nth < of) GROUP BY {k}"
_FACTOR = "CASE WHEN f IN (0, 5) THEN coalesce(ratio, CASE f WHEN 0 THEN 0.92e0 ELSE 0.945e0 END) WHEN f = 1 THEN coalesce(ratio, 0.92e0) ELSE 1e0 END"
_RATIO = "SELECT k, CASE WHEN count(*) FILTER (floor <= 2) >= 3 AND count(*) FILTER (floor > 2) >= 3 THEN greatest(0.65e0, least(1e0, median(v) FILTER (floor <= 2) / median(v) FILTER (floor > 2))) END AS ratio FROM {rows} WHERE floor > 0 GROUP BY 1"
_BY_NAME = f"""b AS (SELECT x.*, price / area AS v FROM x JOIN a USING (k) WHERE type <> '상가'), t AS (SELECT k, CASE WHEN min(n) <= 3 THEN 1 ELSE 2 END AS tier FROM b GROUP BY 1),
found AS (SELECT b.*, tier FROM b JOIN t USING (k) WHERE tier = 2 OR n <= 3), new AS (SELECT * FROM found QUALIFY m >= max(m) OVER (PARTITION BY k) - 12),
matched AS (SELECT k, count(*) AS matched, any_value(tier) AS tier FROM found GROUP BY 1), band AS ({_TRIM.format(k='k', rows='new')}), ratio AS ({_RATIO.format(rows='new')}),
j AS (SELECT a.*, matched, CASE tier WHEN 1 THEN 'same_complex_same_area' WHEN 2 THEN 'same_complex_near_area' END AS tier, basis, {_FACTOR} AS mult, round_even(mid * 84.9e0 * {_FACTOR}, 0)::BIGINT AS est, round_even(lo * 84.9e0 * {_FACTOR}, 0)::BIGINT AS low FROM a LEFT JOIN matched USING (k) LEFT JOIN band USING (k) LEFT JOIN ratio USING (k)),
s AS (SELECT *, CASE WHEN type = '상가' THEN 'unsupported' WHEN share THEN 'share_sale' WHEN matched IS NULL THEN 'no_comps' WHEN basis < 3 THEN tier WHEN est > 2.5e0 * appraisal THEN 'appraisal_mismatch' ELSE tier END AS scope FROM j),
by_name AS (SELECT k, CASE WHEN ok THEN est END AS est, coalesce(matched, 0) AS matched, scope, CASE WHEN ok THEN low END AS band_low, CASE WHEN ok THEN est END AS band_high, basis, CASE WHEN ok THEN mult ELSE 1e0 END AS floor_mult FROM (SELECT *, coalesce(scope = tier AND basis >= 3, false) AS ok FROM s))"""
_CONFIRMED = f"""c AS (SELECT *, price::DOUBLE AS v FROM x WHERE n >= 4 AND k % 3 > 0), w AS (SELECT * FROM (SELECT *, max(m) OVER (PARTITION BY k) AS newest FROM c), (VALUES (12), (24), (60)) AS s(months) WHERE m >= newest - months),
cb AS (SELECT * FROM ({_TRIM.format(k='k, months', rows='w')}) WHERE basis >= 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY months) = 1), cr AS ({_RATIO.format(rows='(SELECT w.* FROM w JOIN cb USING (k, months))')}),
cj AS (SELECT a.*, basis, CASE months WHEN 12 THEN 1e0 WHEN 24 THEN 0.9e0 ELSE 0.75e0 END AS conf, mid, round_even(mid * {_FACTOR}, 0)::BIGINT AS est, round_even(lo * {_FACTOR}, 0)::BIGINT AS low FROM a LEFT JOIN cb USING (k) LEFT JOIN cr USING (k)),
cs AS (SELECT *, CASE WHEN type = '상가' THEN 'unsupported' WHEN share THEN 'share_sale' WHEN mid IS NULL THEN 'no_comps' WHEN est > 2.5e0 * appraisal OR est < 0.35e0 * appraisal THEN 'appraisal_mismatch' ELSE 'same_complex_same_area' END AS scope FROM cj),
confirmed AS (SELECT k, CASE WHEN scope = 'same_complex_same_area' THEN est END AS est, CASE WHEN scope = 'same_complex_same_area' THEN low END AS band_low, basis, CASE WHEN scope = 'same_complex_same_area' THEN conf ELSE 1e0 END AS window_mult, scope FROM cs)"""


@query(f"WITH {_ROWS}, {_BY_NAME} SELECT k::VARCHAR AS case_no, est, matched, scope, band_low, band_high, basis, floor_mult FROM by_name")
def estimated(t):
    return L.estimate(_listings(t), _trades(t)).drop("court", "item_no")


@query(f"WITH {_ROWS}, {_CONFIRMED} SELECT k::VARCHAR AS case_no, est, band_low, basis, window_mult, scope FROM confirmed")
def estimated_confirmed(t):
    return L.estimate_confirmed(_listings(t), _confirmed(t)).drop("court", "item_no", "months")


@query(f"WITH {_ROWS}, {_BY_NAME}, {_CONFIRMED}, o AS (SELECT b.*, c.est AS e, c.band_low AS l, c.basis AS s, c.window_mult AS w, c.scope AS y, CASE WHEN c.est IS NOT NULL THEN 'confirmed' WHEN c.scope = 'appraisal_mismatch' THEN 'blocked' ELSE 'by_name' END AS source FROM by_name b LEFT JOIN confirmed c USING (k)) SELECT k::VARCHAR AS case_no, source, CASE source WHEN 'by_name' THEN est ELSE e END AS est, CASE source WHEN 'by_name' THEN matched ELSE coalesce(s, 0) END AS matched, CASE source WHEN 'by_name' THEN scope ELSE y END AS scope, CASE source WHEN 'by_name' THEN band_low ELSE l END AS band_low, CASE source WHEN 'by_name' THEN band_high ELSE e END AS band_high, CASE source WHEN 'by_name' THEN basis ELSE s END AS basis, CASE source WHEN 'by_name' THEN floor_mult ELSE 1e0 END AS floor_mult, CASE source WHEN 'confirmed' THEN w ELSE 1e0 END AS window_mult FROM o")
def estimates_in_order(t):
    rows = _listings(t)
    return L.in_order(L.estimate_confirmed(rows, _confirmed(t)), L.estimate(rows, _trades(t))).drop("court", "item_no")


@query(f"WITH {_ROWS}, {_BY_NAME} SELECT k::VARCHAR AS case_no, string_agg(ym || ':' || price, ' ' ORDER BY ym DESC, price) AS comps FROM (SELECT *, ((m - 1) // 12)::BIGINT || lpad(((m - 1) % 12 + 1)::VARCHAR, 2, '0') AS ym FROM found QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC, price) <= 240) GROUP BY 1")
def newest_comps(t):
    found = L.comps(L.match_trades(_listings(t), _trades(t)))
    return found.select("case_no", F.array_join(F.transform("comps", lambda x: F.concat_ws(":", x["ym"], x["price"].cast("string"))), " ").alias("comps"))


# a purchase and its sale ------------------------------------------------------------------------------------------------
def _e(x: str) -> str:
    return f"round_even({x}, 0)::BIGINT"


_STAMP = "CASE WHEN bid <= 10000000 THEN 0 WHEN bid <= 30000000 THEN 20000 WHEN bid <= 50000000 THEN 40000 WHEN bid <= 100000000 THEN 70000 WHEN bid <= 1000000000 THEN 150000 ELSE 350000 END"
_FEE = "CASE WHEN sale < 50000000 THEN least({0}, 250000) WHEN sale < 200000000 THEN least({1}, 800000) WHEN sale < 900000000 THEN {2} WHEN sale < 1200000000 THEN {1} WHEN sale < 1500000000 THEN {0} ELSE {3} END".format(*[_e(f"sale * {r}e0") for r in (0.006, 0.005, 0.004, 0.007)])
_INCOME = "CASE " + " ".join(f"WHEN base <= {cap} THEN {tax}" if cap is not None else f"ELSE {tax} END" for cap, tax in [(0, "0"), *[(cap, f"greatest(0, {_e(f'base * {rate}e0')} - {less})") for cap, rate, less in money.INCOME_BRACKETS]])
_SIMULATED = f"""WITH o AS (SELECT o_orderkey, floor(floor(o_totalprice) * 3000 * 0.8e0)::BIGINT AS bid, (floor(o_totalprice) * 3000)::BIGINT AS sale FROM orders),
p AS (SELECT *, CASE WHEN bid <= 600000000 THEN 0.01e0 WHEN bid <= 900000000 THEN round_even(bid * 2 / 300000000e0 - 3, 4) / 100 ELSE 0.03e0 END AS rate FROM o),
q AS (SELECT *, {_e('bid * rate')} + {_e('bid * (rate * 0.5e0 * 0.2e0)')} AS acq, {_STAMP} AS stamp, {_FEE} AS fee, {_e('bid * 0.7e0')} AS loan FROM p),
r AS (SELECT *, {_e('loan * 0.055e0 * 6 / 12')} AS interest, bid + acq + stamp + 500000 + 3000000 AS total FROM q), s AS (SELECT *, greatest(0, sale - bid - acq - stamp - 500000 - fee - 3000000 - interest) AS base FROM r), t AS (SELECT *, {_INCOME} AS own FROM s)
SELECT o_orderkey, bid, acq AS acquisition_tax, total, total - loan AS equity, interest, fee, (own + {_e('own * 0.1e0')})::BIGINT AS tax, (sale - total - interest - fee - own - {_e('own * 0.1e0')})::BIGINT AS net, CASE WHEN sale - 3500000 - fee > 0 THEN true END AS gains, CASE WHEN sale - 3500000 - fee > 0 THEN false END AS beyond FROM t"""


MONEY = ["acquisition_tax", "total", "equity", "interest", "fee", "tax", "net"]


@query(_SIMULATED)
def bid_sim(t):
    kind, area = F.lit("아파트"), F.lit(84.0)
    sale = (F.floor("o_totalprice") * 3000).cast("bigint")
    # a row takes long and is short: rows are dealt out, as few files would leave cores idle
    rows = ranking.dealt(t("orders").select(K, sale.alias("sale"), (sale * 0.8).cast("bigint").alias("bid")), K)
    rows = money.simulated(rows, "", c("bid"), c("sale"), kind, area)
    rows = money.with_break_even(rows, "most", c("sale"), kind, area)
    rows = money.simulated(rows, "next_", c("most") + 1, c("sale"), kind, area)
    return rows.select(K, "bid", *MONEY, (c("most_net") > 0).alias("gains"), (c("next_net") > 0).alias("beyond"))


# scores, and what is served where trades give no price ------------------------------------------------------------------
KIND5, OCCUPANT5 = ["아파트", "오피스텔", "다세대", "토지", "기타"], ["공실", "임차인", "소유자점유", "다수점유", "기타"]
RIGHTS6, PLACE4 = [[], ["지분"], ["가등기"], ["유치권"], ["위반건축물", "지분"], ["기타권리"]], ["서울 가 9층", "경기 나 1층", "부산 다 9층", "강원 라 2층"]


def _candidates(t):
    bid = (F.floor("o_totalprice") * 1000).cast("bigint")
    rights = F.coalesce(*[F.when(c(K) % 6 == i, F.array(*map(F.lit, x)).cast("array<string>")) for i, x in enumerate(RIGHTS6)])
    return t("orders").select(K, C, F.lit("C").alias("court"), c(K).cast("string").alias("case_no"), F.lit("1").alias("item_no"), chosen(C, KIND5).alias("property_type"), chosen(C, PLACE4).alias("address"), F.lit(84.0).alias("area_m2"), bid.alias("min_bid_price"), F.floor(bid * ((c(K) % 5) * 0.09)).cast("bigint").alias("assumed_amount"), rights.alias("special_rights"), (c(C) % 3 == 0).alias("tenant_opposable"), chosen(K, OCCUPANT5).alias("occupant_type"), (c(C) % 7 != 0).alias("rights_verified"), (c(K) % 11 == 0).alias("burden_amount_unknown"))


def _scores(t):
    rows = _candidates(t)
    est = F.when((c(K) % 10 != 3) & (c(K) % 6 >= 2), F.floor(c("min_bid_price") * ((c(K) % 9) * 0.1 + 0.8)).cast("bigint"))
    made = rows.select(*L.KEY, est.alias("est"), (c(K) % 6).alias("matched"), chosen(C, [L.SAME_SAME, "", L.SAME_DONG]).alias("scope"), F.floor(est * 0.9).cast("bigint").alias("band_low"), est.alias("band_high"), (c(C) % 8).alias("basis"), F.lit(1.0).alias("floor_mult"))
    return L.score(rows, made)


def _even(x: str) -> str:
    """One decimal, half to even: a half is what is written with two decimals and a five at the end; all else is rounded as it is written."""
    return f"CASE WHEN regexp_matches(({x})::VARCHAR, '[.][0-9]5$') THEN round(({x}) / 2, 1) * 2 ELSE round(({x})::VARCHAR::DECIMAL(38, 16), 1)::DOUBLE END"


_SCORED = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, (floor(o_totalprice) * 1000)::BIGINT AS bid FROM orders),
a AS (SELECT *, floor(bid * ((k % 5) * 0.09e0))::BIGINT AS assumed, CASE WHEN k % 10 <> 3 AND k % 6 >= 2 THEN floor(bid * ((k % 9) * 0.1e0 + 0.8e0))::BIGINT END AS est, k % 6 AS matched, CASE WHEN bid <= 600000000 THEN 0.01e0 WHEN bid <= 900000000 THEN round_even(bid * 2 / 300000000e0 - 3, 4) / 100 ELSE 0.03e0 END AS rate FROM o),
b AS (SELECT *, floor(est * 0.9e0)::BIGINT AS low, bid + CASE WHEN c % 5 IN (0, 2) THEN {_e('bid * rate')} + {_e('bid * (rate * 0.5e0 * 0.2e0)')} ELSE {_e('bid * 0.04e0')} + {_e('bid * 0.004e0')} + {_e('bid * 0.002e0')} END AS cost, assumed / bid > 0.3e0 OR k % 6 = 3 AS gated,
  greatest(0e0, least(100e0, round_even(100e0 - assumed / bid * 100 - ([0, 20, 25, 30, 35, 10])[(k % 6 + 1)::INTEGER] - CASE WHEN c % 3 = 0 THEN 30 ELSE 0 END - ([0, 10, 15, 25, 15])[(k % 5 + 1)::INTEGER], 1))) AS own,
  greatest(0e0, least(100e0, round_even(([90e0, 75e0, 60e0, 35e0, 30e0])[(c % 5 + 1)::INTEGER] * ([1.10e0, 1.05e0, 1.00e0, 0.85e0])[(c % 4 + 1)::INTEGER] + least(10, 2 * matched), 1))) AS liquidity, CASE WHEN matched >= 3 THEN 1e0 WHEN matched = 2 THEN 0.85e0 WHEN matched = 1 THEN 0.7e0 ELSE 0.6e0 END AS conf FROM a),
g AS (SELECT *, CASE WHEN gated THEN 0e0 ELSE own END AS rights, (est - cost) / est AS gap FROM b),
s AS (SELECT *, GAP AS gap_score FROM g), r AS (SELECT *, {_even('(gap_score * 0.5e0 + rights * 0.3e0 + liquidity * 0.2e0) * conf')} AS raw FROM s),
f AS (SELECT *, CASE WHEN gated AND raw > 25 THEN 25e0 ELSE raw END AS arb, c % 3 <> 2 AND c % 8 >= 5 AS strong FROM r),
scored AS (SELECT *, est - cost AS profit, low - cost - assumed AS profit_low, CASE WHEN est IS NULL THEN CASE WHEN gated THEN '위험' WHEN c % 5 > 1 THEN '미지원유형' ELSE '시세추정불가' END WHEN gated THEN '위험' WHEN gap <= 0 OR low - cost - assumed <= 0 THEN '차익없음' WHEN c % 7 = 0 THEN '권리미확인'
  ELSE CASE WHEN k % 11 = 0 THEN '주의' WHEN arb >= 60 AND NOT strong THEN '관심' WHEN arb >= 80 THEN CASE WHEN matched < 3 THEN '양호' ELSE '차익 유력' END WHEN arb >= 60 THEN '양호' WHEN arb >= 40 THEN '관심' ELSE '주의' END END AS grade, CASE WHEN c % 7 <> 0 OR gated THEN arb END AS arb_score FROM f)"""
_GAP = "CASE WHEN {0} <= 0 THEN 0e0 WHEN {0} <= 0.1e0 THEN round_even(0e0 + ({0} - 0e0) / (0.1e0 - 0e0) * 35e0, 1) WHEN {0} <= 0.2e0 THEN round_even(35e0 + ({0} - 0.1e0) / (0.2e0 - 0.1e0) * 25e0, 1) WHEN {0} <= 0.3e0 THEN round_even(60e0 + ({0} - 0.2e0) / (0.3e0 - 0.2e0) * 20e0, 1) WHEN {0} <= 0.4e0 THEN round_even(80e0 + ({0} - 0.3e0) / (0.4e0 - 0.3e0) * 20e0, 1) WHEN {0} IS NOT NULL THEN 100e0 END".format("gap")


@query(f"WITH {_SCORED.replace('GAP', _GAP)} SELECT k::VARCHAR AS case_no, cost, est, profit AS expected_profit, profit_low, coalesce(gap_score, 0) AS gap_score, rights AS rights_score, liquidity AS liquidity_score, arb_score, grade FROM scored")
def scored(t):
    return _scores(t).select("case_no", "cost", "est", "expected_profit", "profit_low", "gap_score", "rights_score", "liquidity_score", "arb_score", "grade")


_SERVED = f"""WITH {_SCORED.replace('GAP', _GAP)},
p AS (SELECT *, k % 8 <> 0 AS has, CASE WHEN k % 4 = 1 THEN floor(bid * 1.2e0)::BIGINT END AS kb, CASE WHEN k % 5 = 2 THEN floor(bid * 1.1e0)::BIGINT END AS ask, k % 3 AS asks, CASE WHEN k % 7 = 3 THEN floor(bid * 0.8e0)::BIGINT END AS lease, c % 5 = 1 AS office, CASE WHEN c % 4 = 1 THEN 0.92e0 WHEN c % 4 = 3 THEN 0.945e0 ELSE 1e0 END AS mult FROM scored),
v AS (SELECT *, CASE WHEN NOT has THEN NULL WHEN est > 0 THEN 'trades' WHEN kb > 0 THEN 'kb' WHEN ask > 0 THEN 'ask' WHEN lease > 0 THEN 'lease' ELSE 'none' END AS source, floor(ask * CASE WHEN office THEN 0.85e0 ELSE 0.93e0 END)::BIGINT AS al, floor((ask + 10) * CASE WHEN office THEN 0.85e0 ELSE 0.93e0 END)::BIGINT AS ah, floor(lease / CASE WHEN office THEN 0.8e0 ELSE 0.65e0 END)::BIGINT AS lp FROM p),
w AS (SELECT k, c, bid, cost, assumed, gated, rights, liquidity, matched, source, est AS old, profit_low AS old_low, arb_score AS old_arb, grade AS old_grade, floor(CASE source WHEN 'kb' THEN kb WHEN 'ask' THEN (al + ah) // 2 WHEN 'lease' THEN lp END * mult)::BIGINT AS est, floor(CASE source WHEN 'kb' THEN kb WHEN 'ask' THEN al WHEN 'lease' THEN lp END * mult)::BIGINT AS low, CASE source WHEN 'kb' THEN 0.75e0 WHEN 'ask' THEN CASE WHEN asks <= 1 THEN 0.45e0 ELSE 0.55e0 END WHEN 'lease' THEN 0.5e0 END AS conf FROM v),
x AS (SELECT *, (est - cost) / est AS gap FROM w), y AS (SELECT *, {_GAP} AS gap_score FROM x), z AS (SELECT *, {_even('(gap_score * 0.5e0 + rights * 0.3e0 + liquidity * 0.2e0) * conf')} AS raw FROM y), u AS (SELECT *, CASE WHEN gated AND raw > 25 THEN 25e0 ELSE raw END AS arb FROM z)
SELECT k::VARCHAR AS case_no, source AS market_source, coalesce(est, old) AS est, CASE WHEN est IS NULL THEN old_low ELSE low - cost - assumed END AS profit_low, CASE WHEN est IS NULL THEN old_arb WHEN c % 7 <> 0 OR gated THEN arb END AS arb_score,
  CASE WHEN est IS NULL THEN old_grade WHEN gated THEN '위험' WHEN gap <= 0 OR low - cost - assumed <= 0 THEN '차익없음' WHEN c % 7 = 0 THEN '권리미확인' WHEN k % 11 = 0 THEN '주의' WHEN arb >= 80 THEN '차익 유력' WHEN arb >= 60 THEN '양호' WHEN arb >= 40 THEN '관심' ELSE '주의' END AS grade FROM u"""


@query(_SERVED)
def served_prices(t):
    rows, k, bid = _candidates(t), c(K), c("min_bid_price")
    some = lambda cond, x: F.when(cond, F.floor(bid * x).cast("bigint"))
    none = F.lit(None).cast("bigint")
    kb, ask = some(k % 4 == 1, 1.2), some(k % 5 == 2, 1.1)
    prices = rows.where(k % 8 != 0).select(*L.KEY, none.alias("kb_low"), kb.alias("kb_avg"), none.alias("kb_high"), some(k % 7 == 3, 0.8).alias("lease_avg"), ask.alias("ask_min"), (ask + 10).alias("ask_max"), (k % 3).alias("ask_count"))
    return L.market_view(_scores(t), prices).select("case_no", "market_source", "est", "profit_low", "arb_score", "grade")
