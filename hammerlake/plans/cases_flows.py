"""Queries over what flows through the engine: refreshes, migrations, merges, and what is left of a sale (see ``cases`` for how they are made)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammerlake.functions import money, profiles
from hammerlake.operators import migrations
from hammerlake.plans import refresh
from hammerlake.plans.cases import C, K, c, chosen, in_sql
from hammerlake.plans.registry import query
from hammerlake.sources import keyed


# the daily refresh: what a crawl found becomes the next tables -----------------------------------------------------------
_SERVED = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, floor(o_totalprice)::BIGINT * (o_custkey % 3 > 0)::BIGINT AS price FROM orders WHERE o_orderkey % 7 <> 0"
_FOUND = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, floor(o_totalprice)::BIGINT + 1 AS price FROM orders WHERE o_orderkey % 9 <> 0"
_SOLD = "SELECT o_orderkey, '1990-01-01' AS sold_date, 5::BIGINT AS sold_price FROM orders WHERE o_orderkey % 7 = 0"


def _refreshed(t, how):
    order = t("orders").select(K, C, F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.floor("o_totalprice").cast("bigint").alias("price"))
    active = order.where(c(K) % 7 != 0).select(K, "date", (c("price") * (c(C) % 3 > 0).cast("int")).cast("bigint").alias("price"))
    sold = order.where(c(K) % 7 == 0).select(K, F.lit("1990-01-01").alias("sold_date"), F.lit(5).cast("bigint").alias("sold_price"))
    found = order.where(c(K) % 9 != 0).select(K, "date", (c("price") + 1).alias("price"))
    served = {"active": active, "sold": sold, "rights": t("lineitem").select(c("l_orderkey").alias(K), "l_linenumber")}
    return refresh.next_tables(served, found, [K], "date", "price", F.lit("1996-01-01"), how)


@query(f"WITH a AS ({_SERVED}), f AS ({_FOUND}), s AS ({_SOLD}), e AS (SELECT o_orderkey, date AS sold_date, CASE WHEN price > 0 THEN price END AS sold_price FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) AND date < '1996-01-01') SELECT * FROM e UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)")
def refreshed_sold(t):
    return _refreshed(t, "replace")["sold"]


@query(f"WITH a AS ({_SERVED}), f AS ({_FOUND}), s AS ({_SOLD}) SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM f) OR l_orderkey IN (SELECT o_orderkey FROM s) OR l_orderkey IN (SELECT o_orderkey FROM a WHERE date < '1996-01-01') GROUP BY 1")
def refreshed_rights(t):
    return _refreshed(t, "replace")["rights"].groupBy(K).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH a AS ({_SERVED}), f AS ({_FOUND}) SELECT o_orderkey, date, price FROM f UNION ALL SELECT o_orderkey, date, price FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)")
def merged_active(t):
    return _refreshed(t, "merge")["active"]


# rows of the first schema at the newest -----------------------------------------------------------------------------------
STEPS = [
    migrations.Step(2, {"item_no": ("string", "''")}, key=("court", "case_no", "item_no"), by=("profit", "id")),
    migrations.Step(3, {"market_scope": ("string", "''")}),
    migrations.Step(4, {k: ("bigint", "null") for k in ("market_band_low", "market_band_high", "profit_low", "profit_high")}),
    migrations.Step(5, {"market_sample_basis": ("int", "null")}),
    migrations.Step(6, {"market_comps": ("string", "'[]'")}),
    migrations.Step(7, {"rights_verified": ("int", "0")}),
    migrations.Step(8, {"assumed_amount": ("bigint", "0")}),
    migrations.Step(9, {"burden_amount_unknown": ("int", "0")}),
    migrations.Step(10, {"floor_mult": ("double", "1.0")}),
]
_V1 = "SELECT 'C' || o_orderkey % 10 AS court, (o_custkey % 200)::VARCHAR AS case_no, floor(o_totalprice)::BIGINT AS profit, o_orderkey AS id FROM orders"


def _v1(t):
    return t("orders").select(F.concat(F.lit("C"), c(K) % 10).alias("court"), (c(C) % 200).cast("string").alias("case_no"), F.floor("o_totalprice").cast("bigint").alias("profit"), c(K).alias("id"))


@query(f"SELECT court, case_no, max(profit) AS profit, arg_max(id, profit * 10000000 + id) AS id, '' AS item_no, '' AS market_scope, NULL::BIGINT AS market_band_low, NULL::BIGINT AS market_band_high, NULL::BIGINT AS profit_low, NULL::BIGINT AS profit_high, NULL::INTEGER AS market_sample_basis, '[]' AS market_comps, 0 AS rights_verified, 0::BIGINT AS assumed_amount, 0 AS burden_amount_unknown, 1.0::DOUBLE AS floor_mult FROM ({_V1}) GROUP BY 1, 2")
def migrated_rows(t):
    return migrations.migrate(_v1(t), 1, STEPS)


@query(f"""SELECT 2 AS version, '{{"court":"' || court || '","case_no":"' || case_no || '","item_no":""}}' AS key, count(*) AS n FROM ({_V1}) GROUP BY court, case_no HAVING count(*) > 1""")
def key_collisions(t):
    return migrations.collisions(_v1(t), 1, STEPS)


# merges of keyed tables ---------------------------------------------------------------------------------------------------
@query("WITH x AS (SELECT l_partkey, strftime(l_shipdate, '%Y%m') AS ym, floor(l_extendedprice / 1000)::BIGINT AS price, l_returnflag = 'A' AS deleted, l_linenumber, l_orderkey % 2 = 0 AS old FROM lineitem), g AS (SELECT l_partkey, ym, price, bool_or(deleted) AS deleted, max(l_linenumber) AS floor, old FROM x GROUP BY ALL) SELECT l_partkey, ym, price, deleted, floor FROM g WHERE NOT old UNION ALL SELECT l_partkey, ym, price, deleted, floor FROM g AS o WHERE old AND NOT EXISTS (FROM g WHERE NOT g.old AND g.l_partkey = o.l_partkey AND g.ym = o.ym AND g.price = o.price)")
def trades_once(t):
    rows = t("lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyyMM").alias("ym"), F.floor(c("l_extendedprice") / 1000).cast("bigint").alias("price"), (c("l_returnflag") == "A").alias("deleted"), c("l_linenumber").alias("floor"), (c("l_orderkey") % 2 == 0).alias("old"))
    how = keyed.counted_once(["l_partkey", "ym", "price"], "deleted", ["floor"])
    stored = how(rows.where("false").drop("old"), rows.where("old").drop("old"))
    return how(stored, rows.where("not old").drop("old"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, unnest(string_split(l_linestatus || '/' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END, '/')) AS tag FROM lineitem) SELECT l_orderkey, max(l_linenumber) AS at, array_to_string(list_sort(list(DISTINCT tag)), '/') AS tags FROM x WHERE tag <> '' GROUP BY 1")
def kept_tags(t):
    tags = F.concat_ws("/", "l_linestatus", F.when(c("l_linenumber") % 3 == 0, "").otherwise(c("l_returnflag")))
    rows = t("lineitem").select("l_orderkey", c("l_linenumber").alias("at"), tags.alias("tags"))
    return keyed.tags_joined(["l_orderkey"], "tags", "at")(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"))


# profiles by lengths of holding ------------------------------------------------------------------------------------------
KINDS = ["아파트", "오피스텔", "상가", "다세대"]


def _brackets(x: str, rows: list, of) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {cap} THEN {of(*rest)}" if cap is not None else f"ELSE {of(*rest)} END" for cap, *rest in rows)


def _r(x: str) -> str:
    return f"floor({x} + 0.5e0)::BIGINT"


def _income(base: str, more: str = "0e0") -> str:
    inner = _brackets(base, money.INCOME_BRACKETS, lambda rate, less: f"greatest(0, {_r(f'{base} * ({rate}e0 + {more})')} - {less})")
    return f"CASE WHEN {base} <= 0 THEN 0 ELSE {inner} END"


_MATRIX = f"""
WITH l AS (SELECT o_orderkey, (floor(o_totalprice) * 2000)::BIGINT AS bid, (floor(o_totalprice) * (1800 + o_custkey % 9 * 150))::BIGINT AS sale, {in_sql(C, KINDS)} AS kind, ([59.5e0, 84.9e0, 120e0])[(o_orderkey % 3 + 1)::INTEGER] AS area, o_custkey % 4 = 1 AS inside, o_orderdate::DATE + 44 AS paid, o_custkey % 5 = 0 AS undated FROM orders),
p AS (SELECT *, kind IN ('아파트', '다세대') AS h, kind <> '상가' AS sh FROM l, (VALUES ('individual'), ('dealer'), ('corp')) AS a(profile), (VALUES (6), (18), (30)) AS b(months)),
r AS (SELECT *, CASE WHEN NOT h THEN 0 WHEN profile = 'corp' THEN 12 WHEN inside THEN 8 ELSE 0 END AS extra, CASE WHEN bid <= 600000000 THEN 0.01e0 WHEN bid <= 900000000 THEN least(3e0, greatest(1e0, bid * 2 / 300000000e0 - 3)) / 100 ELSE 0.03e0 END AS plain FROM p),
q AS (SELECT *, CASE WHEN NOT h THEN {_r('bid * 0.046e0')} WHEN extra > 0 THEN {_r('bid * (extra / 100e0)')} + {_r('bid * 0.004e0')} + CASE WHEN area > 85 THEN {_r('bid * CASE extra WHEN 8 THEN 0.006e0 ELSE 0.01e0 END')} ELSE 0 END ELSE {_r('bid * plain')} + {_r('bid * (plain * 0.1e0)')} + CASE WHEN area > 85 THEN {_r('bid * 0.002e0')} ELSE 0 END END AS acq,
  {_brackets('bid', money.STAMPS, lambda v: str(v))} AS stamp,
  CASE WHEN h THEN {_brackets('sale + 1', money.HOUSING_FEES, lambda rate, most: _r(f'sale * {rate}e0') if most is None else f"least({_r(f'sale * {rate}e0')}, {most})")} WHEN kind = '오피스텔' AND area <= 85 THEN {_r('sale * 0.005e0')} ELSE {_r('sale * 0.009e0')} END AS fee,
  {_r('bid * 0.7e0')} AS loan, (SELECT count(*) FROM range(1990, 2015) AS y(y) WHERE make_date(y, 6, 1) > paid AND make_date(y, 6, 1) <= paid + to_months(months)) AS junes, sale * 0.7e0 * 0.6e0 AS yb FROM r),
i AS (SELECT *, {_r('loan * 0.055e0 * months / 12')} AS interest, bid + acq + stamp + 500000 + 3000000 AS total, {_brackets('yb', profiles.YEARLY_BRACKETS, lambda least, over, rate: _r(f'{least} + (yb - {over}) * {rate}e0'))} AS yown FROM q),
g AS (SELECT *, CASE WHEN h AND NOT undated THEN junes * (yown + {_r('yb * 0.0014e0')} + {_r('yown * 0.2e0')}) ELSE 0 END AS yearly, sale - total - interest - fee AS wide, sale - bid - acq - stamp - 500000 - fee AS gain, sale - bid - acq - stamp - 500000 AS over_book, sh AND inside AS heavy, CASE WHEN months < 12 THEN CASE WHEN sh THEN 0.7e0 ELSE 0.5e0 END WHEN months < 24 THEN CASE WHEN sh THEN 0.6e0 ELSE 0.4e0 END END AS flat FROM i),
b AS (SELECT *, greatest(0, gain - 2500000) AS base, greatest(0, wide) AS wbase FROM g),
n AS (SELECT *, CASE profile WHEN 'corp' THEN {_r('greatest(0, least(wide, 200000000)) * 0.1e0 + greatest(0, least(wide, 20000000000) - 200000000) * 0.2e0')} + CASE WHEN sh THEN {_r('greatest(0, over_book) * 0.2e0')} ELSE 0 END
  WHEN 'dealer' THEN greatest({_income('wbase')}, CASE WHEN heavy THEN {_income('base', '0.2e0')} ELSE 0 END, CASE WHEN heavy AND flat IS NOT NULL THEN {_r('base * flat')} ELSE 0 END)
  ELSE CASE WHEN gain <= 0 THEN 0 ELSE greatest(CASE WHEN flat IS NOT NULL THEN {_r('base * flat')} ELSE {_income('base')} END, CASE WHEN heavy THEN {_income('base', '0.2e0')} ELSE 0 END) END END AS national FROM b)
SELECT o_orderkey, profile, months, acq AS acquisition_tax, total AS total_in, interest, yearly::BIGINT AS yearly_tax, fee, (national + {_r('national * 0.1e0')})::BIGINT AS tax, (sale - total - interest - yearly - fee - national - {_r('national * 0.1e0')})::BIGINT AS net FROM n
"""


@query(_MATRIX)
def profile_matrix(t):
    bid = (F.floor("o_totalprice") * 2000).cast("bigint")
    sale = (F.floor("o_totalprice") * (c(C) % 9 * 150 + 1800)).cast("bigint")
    area = F.element_at(F.array(F.lit(59.5), F.lit(84.9), F.lit(120.0)), (c(K) % 3 + 1).cast("int"))
    date = F.when(c(C) % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    facts = t("orders").select(K, bid.alias("bid"), sale.alias("sale"), chosen(C, KINDS).alias("kind"), area.alias("area"), (c(C) % 4 == 1).alias("inside"), date.alias("date"))
    found = profiles.matrix(bid=c("bid"), sale=c("sale"), kind=c("kind"), area=c("area"), regulated=c("inside"), sale_date=c("date"), houses=2)
    cell = facts.select(K, F.explode(found).alias("m")).select(K, "m.profile", "m.months", "m.of.*")
    return cell.drop("cash", "roi")


# trades that the other source has already -------------------------------------------------------------------------------
_LINK = "SELECT p_partkey AS l, p_partkey AS r FROM part WHERE p_size % 2 = 0"


@query(f"WITH x AS (SELECT l_partkey AS k, year(l_shipdate) * 12 + month(l_shipdate) AS m, l_linenumber * 10 AS price, l_suppkey % 4 AS floor, l_quantity AS q FROM lineitem), own AS (SELECT k, m, price, floor FROM x WHERE q > 25 AND m < 23970), of AS (SELECT k, max(m) AS own FROM own GROUP BY 1), r AS (SELECT k, m, price, floor, row_number() OVER (PARTITION BY k, m, price, floor) AS nth FROM x JOIN of USING (k) WHERE k IN (SELECT l FROM ({_LINK})) AND m >= greatest(own, (SELECT max(m) - 23 FROM x))), o AS (SELECT *, row_number() OVER (PARTITION BY k, m, price, floor) AS nth FROM own), new AS (SELECT * FROM r ANTI JOIN o USING (k, m, price, floor, nth)), z AS (SELECT k, m, price, bool_or(floor = 0) AS u FROM own GROUP BY ALL) SELECT k AS l_partkey, m, price, floor FROM new LEFT JOIN z USING (k, m, price) WHERE u IS NULL OR (NOT u AND floor <> 0) QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC, price DESC, floor DESC) <= 20")
def trades_topped_up(t):
    from hammerlake.functions import numbers
    from hammerlake.operators import matching

    every = t("lineitem").select("l_partkey", numbers.month_index(c("l_shipdate")).alias("m"), (c("l_linenumber") * 10).alias("price"), (c("l_suppkey") % 4).alias("floor"), "l_quantity")
    links = t("part").where("p_size % 2 = 0").select(c("p_partkey").alias("l_partkey"), c("p_partkey").alias("r"))
    return matching.top_up(links, every.where("l_quantity > 25 and m < 23970"), every.withColumnRenamed("l_partkey", "r"), "l_partkey", "r", "m", "price", "floor", 24)


# stored texts against their source --------------------------------------------------------------------------------------
SAID = [("매각 조건 변경 있음", False), ("보증금 인수 보증금 인수", True), ("", False), ("가나다라마 가나다라마", True), ("짧은 짧은", False)]


@query(f"WITH s AS (SELECT o_orderkey, o_totalprice, o_custkey, {in_sql(K, [x[0] for x in SAID])} AS remark, {in_sql(K, [x[1] for x in SAID])} AS twice FROM orders) SELECT 'remark' AS \"column\", count(*) AS compared, count(*) FILTER (remark <> '') AS testable, count(*) FILTER (o_custkey % 50 = 0 AND remark <> '') AS different, count(*) FILTER (twice) AS doubled, 'wrong' AS verdict FROM s UNION ALL SELECT 'claim', count(*), count(*), 0, 0, 'ok' FROM s UNION ALL SELECT 'note', count(*), 0, 0, 0, 'undecidable' FROM s")
def stored_fidelity(t):
    from hammerlake.operators import stats

    rows = t("orders").select(K, C, chosen(K, [x[0] for x in SAID]).alias("remark"), F.floor("o_totalprice").cast("bigint").alias("claim"), F.lit(" ").alias("note"))
    again = rows.withColumn("remark", F.when((c(C) % 50 == 0) & (c("remark") != ""), F.concat("remark", F.lit("!"))).otherwise(F.replace("remark", F.lit(" "), F.lit("\n "))))
    return stats.fidelity(rows, again, [K], ["remark", "claim", "note"])


# asking prices --------------------------------------------------------------------------------------------------------
ELEMENTS = [('{"price": %d, "label": "3층"}', True, None), ('{"price": %d.7}', True, None), ('{"price": "%d"}', False, "no number as price"), ('{"price": true, "x": %d}', False, "no number as price"), ('%d', False, "not an object in the list"), ('{"price": -%d}', False, "price not above zero")]


def _asks(t):
    from hammerlake.sources import asking

    one = F.format_string("%s", F.replace(chosen("l_linenumber", [x[0] for x in ELEMENTS]), F.lit("%d"), c("l_partkey").cast("string")))
    lists = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("e")))), lambda x: x["e"]), ",").alias("es"))
    body = F.concat(F.lit('{"C'), "l_orderkey", F.lit('": ['), "es", F.lit("]"), F.when(c("l_orderkey") % 5 == 0, "").otherwise("}"))
    return asking.asking_prices(lists.select(body.alias("value")))


_ELEMENT = "([" + ", ".join(repr(x[2]) if x[2] else "NULL" for x in ELEMENTS) + "])[(l_linenumber % 6 + 1)::INTEGER]"


_LISTED = f"SELECT *, CASE WHEN {_ELEMENT} IS NULL AND l_partkey = 0 AND l_linenumber % 6 = 0 THEN 'price not above zero' ELSE {_ELEMENT} END AS reason, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INTEGER - 1 AS nth FROM lineitem WHERE l_orderkey % 5 <> 0"


@query(f"SELECT 'C' || l_orderkey AS case_no, nth::INTEGER AS nth, l_partkey AS price, CASE WHEN l_linenumber % 6 = 0 THEN '3층' ELSE '' END AS label, '' AS observed_at FROM ({_LISTED}) WHERE reason IS NULL")
def asked(t):
    return _asks(t)[0]


@query(f"SELECT 'C' || l_orderkey AS case_no, reason, count(*) AS n FROM ({_LISTED}) WHERE reason IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT NULL, 'not an object', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 5 = 0")
def asks_refused(t):
    return _asks(t)[1].groupBy("case_no", "reason").agg(F.count(F.lit(1)).alias("n"))


# archived answers of services, read again -------------------------------------------------------------------------------
def _tag(name: str, value) -> F.Column:
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


@query("SELECT l_orderkey, l_linenumber, 'sh' AS kind, l_partkey * 10000000 AS price, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey + 0.5e0 ELSE (l_suppkey + 7)::DOUBLE END AS area_m2, strftime(l_shipdate, '%Y%m') AS deal_ym, CASE WHEN l_linenumber % 4 = 0 THEN '단독/다가구' ELSE '다가구' END AS name, (l_suppkey + 7)::DOUBLE AS plot_area_m2, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_linenumber END AS floor FROM lineitem WHERE l_partkey > 0 AND (l_linenumber % 3 <> 0 OR l_suppkey + 0.5 > 0)")
def archived_trades(t):
    from hammerlake.sources import files

    price = F.format_number(c("l_partkey") * 1000, 0)
    size = F.when(c("l_linenumber") % 3 == 0, _tag("totalFloorAr", c("l_suppkey") + 0.5)).otherwise("")
    kind = F.when(c("l_linenumber") % 4 == 0, "<houseType> </houseType>").otherwise("<주택유형>다가구</주택유형>")
    floor = F.when(c("l_linenumber") % 5 == 0, "<층>x</층>").otherwise(_tag("floor", c("l_linenumber")))
    body = F.concat(F.lit("<item>"), F.lit("<dealAmount> "), price, F.lit("</dealAmount>"), _tag("dealYear", F.year("l_shipdate")), _tag("월", F.month("l_shipdate")), size, _tag("대지면적", c("l_suppkey") + 7), kind, floor, F.lit("</item>"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", body.alias("body"))
    return files.other_trades_of(rows, "sh").drop("dong", "subtype", "zoning")


@query("SELECT p_partkey, p_name AS name, '가동 ' || p_partkey AS address, '2001-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS approved, CASE WHEN p_partkey % 3 = 0 THEN '주택' ELSE '' END AS purpose, CASE WHEN p_partkey % 4 = 0 THEN 0e0 ELSE p_size + 0.25e0 END AS area_m2, p_size AS floors_above, 0 AS floors_below, CASE WHEN p_partkey % 5 = 0 THEN 'Y' ELSE '' END AS violation, '' AS violation_text FROM part")
def archived_registers(t):
    from hammerlake.sources import files

    k = c("p_partkey")
    size = F.when(k % 4 == 0, "<totArea>?</totArea>").otherwise(_tag("연면적", c("p_size") + 0.25))
    approved = F.concat(F.lit("2001-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"))
    body = F.concat(F.lit("<item>"), _tag("bldNm", c("p_name")), _tag("대지위치", F.concat(F.lit("가동 "), k)), _tag("useAprDay", approved), F.when(k % 3 == 0, "<mainPurpsCdNm> 주택 </mainPurpsCdNm>").otherwise(""), size, _tag("grndFlrCnt", c("p_size")), F.when(k % 5 == 0, "<위반건축물>Y</위반건축물>").otherwise(""), F.lit("</item>"))
    return files.registers_of(t("part").select("p_partkey", body.alias("body")))


@query("SELECT l_orderkey, strftime(l_shipdate, '%Y%m') || CASE WHEN l_linenumber % 3 = 0 THEN '00' ELSE lpad(day(l_shipdate)::VARCHAR, 2, '0') END AS trade_ymd, l_partkey * 10000 AS price, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber END AS floor, (l_returnflag = 'A')::INTEGER AS deleted FROM lineitem")
def archived_histories(t):
    from hammerlake.sources import files

    one = F.struct(F.year("l_shipdate").cast("string").alias("tradeYear"), F.month("l_shipdate").cast("string").alias("tradeMonth"), F.when(c("l_linenumber") % 3 != 0, F.dayofmonth("l_shipdate").cast("string")).alias("tradeDate"), c("l_partkey").alias("dealPrice"), F.when(c("l_linenumber") % 4 != 0, c("l_linenumber")).alias("floor"), F.when(c("l_returnflag") == "A", "Y").otherwise("N").alias("deleteYn"))
    months = t("lineitem").groupBy("l_orderkey", F.date_format("l_shipdate", "yyyyMM").alias("ym")).agg(F.collect_list(one).alias("realPriceList"))
    bodies = months.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("realPriceList")).alias("realPriceOnMonthList"))).alias("body"))
    return files.price_months(bodies)


@query("SELECT o_orderkey, 'buldNm=동 ' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN ';maejibun=[성명] 지분 2분의 1' WHEN 1 THEN ';mulBigo=채무자 [성명]' ELSE ';telNo=02' END AS kept FROM orders")
def raw_without_persons(t):
    from hammerlake.sources import records

    key = chosen(C, ["maejibun", "mulBigo", "telNo"])
    said = chosen(C, ["홍길동 지분 2분의 1", "채무자 김철수", "02"])
    raw = F.create_map(F.lit("buldNm"), F.concat(F.lit("동 "), c(K)), F.lit("debtorNm"), F.lit("x"), F.lit("jpOwnerTel"), F.lit("y"), key, said)
    pairs = F.array_sort(F.map_entries(records.without_personal(raw)))
    return t("orders").select(K, F.array_join(F.transform(F.filter(pairs, lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("kept"))


# lists that are shown, and lookups behind them ---------------------------------------------------------------------------
@query("SELECT o_orderkey::VARCHAR AS case_no, CASE WHEN o_custkey % 3 > 0 THEN floor(o_totalprice)::BIGINT END AS sold_price FROM orders ORDER BY o_custkey % 3 = 0, strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey::VARCHAR LIMIT 200")
def newest_sales(t):
    from hammerlake.plans import closed

    rows = t("orders").select(F.lit("C").alias("court"), c(K).cast("string").alias("case_no"), F.lit("1").alias("item_no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"), F.when(c(C) % 3 > 0, F.floor("o_totalprice").cast("bigint")).alias("sold_price"))
    return closed.newest(rows).select("case_no", "sold_price")


@query("SELECT o_orderkey, CASE WHEN a = b THEN a END AS complex_no FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey % 3) AS a, max(l_suppkey % 3) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def sold_complexes(t):
    from hammerlake.operators import lookups

    table = t("lineitem").select(c("l_orderkey").alias(K), F.when(c("l_returnflag") == "R", c("l_suppkey") % 3).alias("complex_no"))
    return lookups.only_match(t("orders").select(K), table, [K], "complex_no")


@query("WITH a AS (SELECT l_partkey AS k, arg_max(l_suppkey, epoch(l_shipdate) * 100000000 + l_orderkey * 10 + l_linenumber) AS x, arg_max(l_orderkey, epoch(l_shipdate) * 100000000 + l_orderkey * 10 + l_linenumber) AS y FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 4 > 0 GROUP BY 1), b AS (SELECT l_partkey AS k, arg_max(l_suppkey, epoch(l_shipdate) * 100000000 + l_orderkey * 10 + l_linenumber) AS x, arg_max(l_orderkey, epoch(l_shipdate) * 100000000 + l_orderkey * 10 + l_linenumber) AS y FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey % 4 > 0 GROUP BY 1) SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT WHEN a.k IS NOT NULL THEN a.x ELSE b.x END AS lon, CASE WHEN p_size % 2 = 0 THEN NULL WHEN a.k IS NOT NULL THEN a.y ELSE b.y END AS lat FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey")
def coordinates_filled(t):
    from hammerlake.operators import lookups

    at = F.unix_seconds(c("l_shipdate").cast("timestamp")) * 100_000_000 + c("l_orderkey") * 10 + c("l_linenumber")
    known = t("lineitem").select(c("l_partkey").alias("p_partkey"), F.when(c("l_suppkey") % 4 > 0, c("l_suppkey").cast("bigint")).alias("lon"), c("l_orderkey").alias("lat"), at.alias("at"), "l_returnflag")
    rows = t("part").select("p_partkey", F.when(c("p_size") % 2 == 0, c("p_size").cast("bigint")).alias("lon"), F.lit(None).cast("bigint").alias("lat"))
    return lookups.fill_from_latest(rows, ["p_partkey"], ["lon", "lat"], (known.where("l_returnflag = 'R'"), "at"), (known.where("l_returnflag = 'N'"), "at"))


_HOME = "WITH r AS (SELECT o_custkey % 4 = 0 AS clean, date_diff('day', DATE '1998-01-10', o_orderdate::DATE) AS d, floor(o_totalprice)::BIGINT * 2000 - 100000000 AS profit, o_custkey % 9 * 20000000 AS burden FROM orders WHERE o_orderkey % 5 > 0)"


@query(f"{_HOME}, v AS (SELECT * FROM r WHERE profit - burden > 0) SELECT 'all' AS chip, count(*) AS n FROM v UNION ALL SELECT 'clean', count(*) FILTER (clean) FROM v UNION ALL SELECT 'soon', count(*) FILTER (d BETWEEN 1 AND 7) FROM v UNION ALL SELECT 'high', count(*) FILTER (profit >= 200000000) FROM v")
def home_chips(t):
    from hammerlake.plans import listings

    rows = t("orders").select(F.when(c(K) % 5 > 0, c(K)).alias("est"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"), F.lit("1000").alias("sale_time"), (F.floor("o_totalprice").cast("bigint") * 2000 - 100_000_000).alias("profit_low"), F.lit(None).cast("bigint").alias("expected_profit"), (c(C) % 9 * 20_000_000).alias("burden"), (c(C) % 4 == 0).alias("clean"))
    return listings.chip_counts(rows, F.lit("1998-01-10 20:00:00").cast("timestamp"), "burden")
