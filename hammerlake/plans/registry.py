"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerlake.functions import money, numbers, text
from hammerlake.operators import bands, gates, matching, merging, ranking, stats
from hammerlake.streaming import events as streams

FLAGSHIP = "trimmed_band"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of tables under its name; ``t("orders")`` reads a table."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


c = F.col
DAYS = "date_diff('day', {0}::DATE, {1}::DATE)"
MONTH = "(year({0}) * 12 + month({0}))"
ONE_PRICE = "l_extendedprice / l_quantity"
BAND = "SELECT {k}, count(*) AS basis, min(v) AS lo, median(v) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v) AS a, count(*) OVER (PARTITION BY {k}) AS n FROM ({rows})) WHERE n < 4 OR (a > 1 AND a < n) GROUP BY {k} HAVING count(*) >= 3"


def _unit_prices(t: Callable, *more: str) -> DataFrame:
    return t("lineitem").select("l_partkey", "l_suppkey", (c("l_extendedprice") / c("l_quantity")).alias("v"), numbers.month_index(c("l_shipdate")).alias("m"), *more)


# bands ---------------------------------------------------------------------------------------------------------------
@query(BAND.format(k="l_partkey", rows=f"SELECT l_partkey, {ONE_PRICE} AS v FROM lineitem"))
def trimmed_band(t):
    return bands.trimmed_band(_unit_prices(t), ["l_partkey"], "v")


@query(f"WITH x AS (SELECT l_suppkey, l_extendedprice AS v, {MONTH.format('l_shipdate')} AS m FROM lineitem), y AS (SELECT *, max(m) OVER (PARTITION BY l_suppkey) AS newest FROM x) SELECT l_suppkey, count(*) AS n, min(v) AS lo, max(v) AS hi FROM y WHERE m >= newest - 12 GROUP BY 1")
def recent_window(t):
    rows = t("lineitem").select("l_suppkey", c("l_extendedprice").alias("v"), numbers.month_index(c("l_shipdate")).alias("m"))
    return bands.recent(rows, ["l_suppkey"], "m").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query(
    f"WITH x AS (SELECT l_partkey, {ONE_PRICE} AS v, {MONTH.format('l_shipdate')} AS m FROM lineitem), y AS (SELECT l_partkey, v, w AS months FROM (SELECT *, max(m) OVER (PARTITION BY l_partkey) AS newest FROM x), (VALUES (12), (24), (60)) AS s(w) WHERE m >= newest - w), "
    + f"b AS ({BAND.format(k='l_partkey, months', rows='SELECT * FROM y')}) SELECT l_partkey, months, CASE months WHEN 12 THEN 1.0::DOUBLE WHEN 24 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence, basis, lo, mid FROM b QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY months) = 1"
)
def window_ladder(t):
    return bands.window_ladder(_unit_prices(t), ["l_partkey"], "m", "v")


@query(f"WITH x AS (SELECT l_partkey, l_quantity <= 10 AS low, {ONE_PRICE} AS v FROM lineitem), y AS (SELECT l_partkey, count(*) FILTER (low) AS a, count(*) FILTER (NOT low) AS b, median(v) FILTER (low) AS p, median(v) FILTER (NOT low) AS q FROM x GROUP BY 1) SELECT l_partkey, CASE WHEN a >= 3 AND b >= 3 THEN greatest(0.65::DOUBLE, least(1.0::DOUBLE, p / q)) END AS ratio FROM y")
def ratio_clamp(t):
    return bands.clamped_ratio(_unit_prices(t, "l_quantity"), ["l_partkey"], c("l_quantity") <= 10, "v")


@query(
    f"WITH x AS (SELECT l_suppkey, l_extendedprice AS v, {MONTH.format('l_shipdate')} AS m FROM lineitem), a AS (SELECT DISTINCT l_suppkey, m AS month FROM x), "
    + "y AS (SELECT l_suppkey, month, v FROM a JOIN x USING (l_suppkey) WHERE m > month - 12 AND m <= month) "
    + BAND.format(k="l_suppkey, month", rows="SELECT * FROM y")
)
def rolling_band(t):
    rows = t("lineitem").select("l_suppkey", c("l_extendedprice").alias("v"), numbers.month_index(c("l_shipdate")).alias("month"))
    return bands.rolling_band(rows, ["l_suppkey"], "month", "v")


# joins ---------------------------------------------------------------------------------------------------------------
@query("WITH p AS (SELECT a.p_partkey AS k, CASE WHEN a.p_brand = b.p_brand AND abs(b.p_size - a.p_size) <= 0.03 * a.p_size THEN 1 WHEN a.p_brand = b.p_brand AND abs(b.p_size - a.p_size) <= 0.1 * a.p_size THEN 2 ELSE 3 END AS tier FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey), q AS (SELECT *, min(tier) OVER (PARTITION BY k) AS best FROM p) SELECT k AS p_partkey, best AS tier, count(*) AS n FROM q WHERE tier = best GROUP BY 1, 2")
def tiered_match(t):
    kind = ["p_type", "p_brand", "p_size"]
    return t("part").select("p_partkey", *kind).join(matching.tier_of_nearness(t("part"), *kind, [0.03, 0.1]), kind).select("p_partkey", "tier", "n")


@query("WITH a AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem), b AS (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem), z AS (SELECT l_orderkey, count(*) AS of FROM a GROUP BY 1), s AS (SELECT l_orderkey, l_suppkey, count(*) AS shared FROM a JOIN b USING (l_partkey, l_quantity) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY shared DESC, l_suppkey) AS i, lead(shared) OVER (PARTITION BY l_orderkey ORDER BY shared DESC, l_suppkey) AS nxt FROM s) SELECT l_orderkey, l_suppkey, shared, of FROM r JOIN z USING (l_orderkey) WHERE i = 1 AND shared >= 2 AND shared >= 0.4 * of AND shared >= 1.5 * coalesce(nxt, 0)")
def fingerprint_link(t):
    lines = t("lineitem")
    return matching.fingerprint_link(lines, lines, "l_orderkey", "l_suppkey", ["l_partkey", "l_quantity"], least=2, coverage=0.4, margin=1.5)


@query("SELECT a.p_partkey AS p_partkey, arg_min(b.p_partkey, abs(b.p_size - a.p_size)::BIGINT * 1000000000 + b.p_partkey) AS near_key, min(abs(b.p_size - a.p_size)) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey GROUP BY 1")
def nearest_size(t):
    return matching.nearest(t("part"), "p_brand", "p_size", "p_partkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0)::DOUBLE AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey")
def rights_left_join(t):
    sums = t("orders").where("o_orderstatus = 'O'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), stats.exact_sum(c("o_totalprice")).cast("double").alias("total"))
    return t("customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount >= 0.09) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_tax >= 0.07)")
def orphan_prune(t):
    key = c("l_partkey").alias("p_partkey")
    lines = t("lineitem")
    return merging.prune_orphans(t("part").select("p_partkey"), "p_partkey", lines.where("l_returnflag = 'R' and l_discount >= 0.09D").select(key), lines.where("l_returnflag = 'A' and l_tax >= 0.07D").select(key))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def revived_semi(t):
    back = t("lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return t("orders").where("o_orderstatus = 'O'").select("o_orderkey").join(back, "o_orderkey", "left_semi")


@query(f"WITH x AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), y AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT o_custkey, o_orderpriority FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.o_custkey = x.o_custkey AND y.o_orderpriority = x.o_orderpriority)")
def sold_snapshot(t):
    keys, orders = ["o_custkey", "o_orderpriority"], t("orders")
    return orders.where("o_orderdate < timestamp'1998-01-01'").select(*keys).distinct().join(orders.where("o_orderdate >= timestamp'1998-01-01'").select(*keys).distinct(), keys, "left_anti")


@query("WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.n = b.n AND a.s = b.s THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority")
def snapshot_diff(t):
    keys, early = ["o_custkey", "o_orderpriority"], c("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    side = lambda cond: t("orders").where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s"))
    return merging.diff(side(early), side(~early), keys, ["n", "s"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(t):
    return merging.latest(t("events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey FROM (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) = 1) ORDER BY o_orderpriority, o_orderkey LIMIT 500")
def fan_out_dedup(t):
    # one line of each order is found before the join, so that nothing fans out
    lines = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("one"))
    rows = t("orders").where("o_orderstatus = 'O'").join(lines, "o_orderkey").select("o_orderkey", "o_orderpriority", "one.l_linenumber", "one.l_partkey")
    return ranking.top(rows, [c("o_orderpriority"), c("o_orderkey")], 500)


@query("SELECT nationkey, min(pri) AS pri, max(name) AS name, count(*) AS n FROM (SELECT c_nationkey AS nationkey, c_name AS name, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS pri FROM customer UNION ALL SELECT s_nationkey, s_name, CASE WHEN s_acctbal < 0 THEN 3 ELSE 0 END FROM supplier) GROUP BY 1")
def union_priority(t):
    one = t("customer").select(c("c_nationkey").alias("nationkey"), c("c_name").alias("name"), F.when(c("c_acctbal") < 0, 2).otherwise(1).alias("pri"))
    two = t("supplier").select(c("s_nationkey").alias("nationkey"), c("s_name").alias("name"), F.when(c("s_acctbal") < 0, 3).otherwise(0).alias("pri"))
    return one.unionByName(two).groupBy("nationkey").agg(F.min("pri").alias("pri"), F.max("name").alias("name"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate + INTERVAL 30 DAY)")
def stale_not_exists(t):
    # the newest line tells for all lines of an order
    newest = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("newest"))
    return t("orders").join(newest, "o_orderkey", "left").where("newest is null or newest < o_orderdate + interval 30 day").select("o_orderkey")


# merges --------------------------------------------------------------------------------------------------------------
@query("WITH b AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders), d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'X' END AS o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice + 1 END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'N' END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) SELECT b.o_orderkey, coalesce(nullif(d.o_orderpriority, ''), b.o_orderpriority) AS o_orderpriority, coalesce(nullif(d.o_totalprice, 0), b.o_totalprice) AS o_totalprice, coalesce(d.o_orderstatus, b.o_orderstatus) AS o_orderstatus FROM b LEFT JOIN d USING (o_orderkey)")
def conditional_merge(t):
    base, k = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), c("o_orderkey")
    delta = base.where(k % 2 == 0).select("o_orderkey", F.when(k % 3 == 0, "").otherwise("X").alias("o_orderpriority"), F.when(k % 5 == 0, 0.0).otherwise(c("o_totalprice") + 1).alias("o_totalprice"), F.when(k % 7 != 0, "N").alias("o_orderstatus"))
    return merging.merge_known(base, delta, ["o_orderkey"], ["o_orderpriority", "o_totalprice"], ["o_orderstatus"])


@query("WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::INTEGER % 2 END AS quality FROM documents), l AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) SELECT b.doc_id, coalesce(b.quality, l.q)::INTEGER AS quality FROM b LEFT JOIN l USING (doc_id)")
def fill_empty_only(t):
    base = t("documents").select("doc_id", F.when(c("doc_id") % 2 == 0, c("n_chars") % 2).cast("int").alias("quality"))
    return merging.fill_empty(base, t("labels").select("doc_id", c("quality").cast("int").alias("quality")), ["doc_id"], ["quality"])


@query("SELECT l_partkey, l_quantity, count(*) AS n, bool_or(l_returnflag = 'R') AS cancelled, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2")
def aggregate_then_upsert(t):
    return t("lineitem").groupBy("l_partkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.bool_or(c("l_returnflag") == "R").alias("cancelled"), F.min("l_orderkey").alias("first_order"))


# statistics ----------------------------------------------------------------------------------------------------------
@query("SELECT b::INTEGER AS bucket, count(l_tax) AS n FROM range(10) AS r(b) LEFT JOIN (SELECT l_tax, least(floor(l_tax / 0.008), 9) AS k FROM lineitem) ON b = k GROUP BY 1")
def histogram10(t):
    return stats.histogram(t("lineitem"), c("l_tax"), 0.008, 10)


@query("SELECT b::INTEGER AS bucket, count(l_linenumber) AS n FROM range(4) AS r(b) LEFT JOIN lineitem ON b = least(l_linenumber, 3) GROUP BY 1")
def capped_freq(t):
    return stats.capped_counts(t("lineitem"), c("l_linenumber"), 3)


@query("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean, max(o_totalprice) AS highest, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS done FROM orders GROUP BY 1")
def group_stats(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), stats.exact_avg(c("o_totalprice")).alias("mean"), F.max("o_totalprice").alias("highest"), (F.count_if(c("o_orderstatus") == "F") / F.count(F.lit(1))).alias("done"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def calendar_counts(t):
    return stats.calendar(t("orders"), c("o_orderdate"))


@query("WITH x AS (SELECT least(floor(o_totalprice / 100000), 3)::INTEGER AS bucket, o_orderstatus = 'F' AS hit, o_totalprice FROM orders) SELECT b::INTEGER AS bucket, count(hit) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit)::DOUBLE / nullif(count(hit), 0) AS rate FROM range(4) AS r(b) LEFT JOIN x ON b = bucket GROUP BY 1")
def calibration(t):
    rows = t("orders").select(F.least(F.floor(c("o_totalprice") / 100000), F.lit(3)).cast("int").alias("bucket"), (c("o_orderstatus") == "F").alias("hit"))
    sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    return stats.zero_filled(sums.select("bucket", "n"), "bucket", 4).join(sums.select("bucket", "hits"), "bucket", "left").select("bucket", "n", F.coalesce("hits", F.lit(0)).alias("hits"), F.try_divide("hits", "n").alias("rate"))


@query("SELECT gate, violations, violations = 0 AS ok FROM (SELECT 'order_total_positive' AS gate, count(*) FILTER (NOT o_totalprice > 0) AS violations FROM orders UNION ALL SELECT 'lines_have_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'late_lines', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'one_row_a_key', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'texts_present', CASE WHEN count(*) >= 50 AND count(text) < 0.9 * count(*) THEN count(*) - count(text) ELSE 0 END FROM documents)")
def quality_gates(t):
    orders, lines = t("orders"), t("lineitem")
    keyed = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    checks = {
        "order_total_positive": lambda: gates.violations("order_total_positive", orders.where("not (o_totalprice > 0)")),
        "lines_have_orders": lambda: gates.violations("lines_have_orders", keyed.join(orders.select("o_orderkey"), "o_orderkey", "left_anti")),
        "late_lines": lambda: gates.violations("late_lines", keyed.join(orders, "o_orderkey").where("l_shipdate < o_orderdate")),
        "one_row_a_key": lambda: gates.violations("one_row_a_key", lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
        "texts_present": lambda: gates.share("texts_present", t("documents"), c("text").isNotNull(), 0.9),
    }
    return gates.run(orders.sparkSession, checks)


@query("WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS votes FROM v) SELECT user_id, CASE WHEN count(*) > 1 THEN 'unstable' ELSE min(event_type) END AS event_type, max(votes) AS votes FROM m WHERE n = votes GROUP BY 1")
def majority_vote(t):
    return stats.majority(t("events"), "user_id", "event_type")


@query("SELECT strftime(first, '%Y-%m-%d') AS day, event_type, count(*) OVER (ORDER BY first, event_type)::BIGINT AS known FROM (SELECT event_type, min(ts) AS first FROM events GROUP BY 1)")
def first_seen(t):
    # at most as many rows as there are kinds of events reach the ordered count
    firsts = t("events").groupBy("event_type").agg(F.min("ts").alias("first"))
    from pyspark.sql import Window

    return firsts.select(F.date_format("first", "yyyy-MM-dd").alias("day"), "event_type", F.count(F.lit(1)).over(Window.orderBy("first", "event_type").rowsBetween(Window.unboundedPreceding, 0)).alias("known"))


@query("SELECT key, count(*) AS present, count(*) FILTER (coalesce(json_extract_string(props, '$.' || key), '') <> '') AS filled FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_profile(t):
    return stats.key_profile(t("events"), "props")


@query("SELECT count(*) AS n, max(ts) AS newest, sum(('0x' || substr(md5(event_id || '|' || event_type), 1, 8))::BIGINT)::BIGINT AS checksum FROM events")
def dataset_fingerprint(t):
    return stats.dataset_fingerprint(t("events"), ["event_id", "event_type"], "ts")


@query("WITH s AS (SELECT l_orderkey AS k, sum(l_quantity::DECIMAL(18,2)) AS q, count(*) AS n FROM lineitem WHERE l_linenumber < 7 GROUP BY 1), f AS (SELECT l_orderkey AS k, sum(l_quantity::DECIMAL(18,2)) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'q' AS \"column\", count(*) AS compared, count(*) FILTER (s.q <> f.q) AS different FROM s JOIN f USING (k) UNION ALL SELECT 'n', count(*), count(*) FILTER (s.n <> f.n) FROM s JOIN f USING (k)")
def recomputed_diff(t):
    side = lambda rows: rows.groupBy("l_orderkey").agg(stats.exact_sum(c("l_quantity")).alias("q"), F.count(F.lit(1)).alias("n"))
    return stats.differences(side(t("lineitem").where("l_linenumber < 7")), side(t("lineitem")), ["l_orderkey"], ["q", "n"])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3")
def grouped_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


# orders and windows --------------------------------------------------------------------------------------------------
@query(f"SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, p AS price FROM (SELECT *, l_extendedprice AS p, lag(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS b FROM lineitem) WHERE b IS DISTINCT FROM p")
def price_steps(t):
    rows = t("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", c("l_extendedprice").alias("price"))
    return ranking.steps(rows, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "price")


@query("SELECT c_mktsegment, c_custkey, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS nth FROM customer) WHERE nth <= 5")
def stratified_sample(t):
    return ranking.ranked_within(t("customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", [F.md5(c("c_custkey").cast("string").cast("binary")), c("c_custkey")], 5).select("c_mktsegment", "c_custkey", "nth")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_picks(t):
    sent = t("lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return ranking.top(t("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), c("o_orderkey")], 50, sent, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 60")
def multi_sort(t):
    tier = F.when(c("o_orderstatus") == "O", 0).when(c("o_orderstatus") == "P", 1).otherwise(2)
    return ranking.page(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [tier, F.desc("o_totalprice"), c("o_orderkey")], 2)


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lag(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events) WHERE ts - back < INTERVAL 1 DAY")
def rate_limit(t):
    return ranking.over_rate(t("events"), "user_id", "ts", "event_id", 86400, 3).select("event_id", "user_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(t):
    return streams.tumbling(t("events"), "1 day")


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM y GROUP BY user_id, s")
def sessions(t):
    return streams.sessions(t("events"), "6 hours")


@query("WITH w AS (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT e.event_id, e.user_id FROM events e LEFT JOIN w USING (user_id) WHERE mark IS NULL OR e.ts > mark")
def incremental(t):
    e = t("events")
    return streams.newer(e, e.where("ts < timestamp'2024-01-15'").groupBy("user_id").agg(F.max("ts").alias("mark")), "user_id", "ts").select("event_id", "user_id")


# scoring -------------------------------------------------------------------------------------------------------------
@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 4 AS g FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN g <= 0 THEN 0 WHEN g <= 0.1 THEN round_even(0.0 + (g - 0.0) / (0.1 - 0.0) * 35, 1) WHEN g <= 0.2 THEN round_even(35 + (g - 0.1) / (0.2 - 0.1) * 25, 1) WHEN g <= 0.3 THEN round_even(60 + (g - 0.2) / (0.3 - 0.2) * 20, 1) WHEN g <= 0.4 THEN round_even(80 + (g - 0.3) / (0.4 - 0.3) * 20, 1) ELSE 100 END::DOUBLE AS score FROM x")
def gap_score(t):
    from hammerlake.plans.listings import GAP_KNOTS

    return t("lineitem").select("l_orderkey", "l_linenumber", numbers.interpolate(c("l_discount") * 4, GAP_KNOTS).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '위험' WHEN o_totalprice <= 50000 THEN '차익없음' WHEN o_orderstatus <> 'F' THEN '권리미확인' WHEN s >= 80 THEN CASE WHEN o_custkey % 2 = 0 THEN '주의' ELSE '차익 유력' END WHEN s >= 60 THEN CASE WHEN o_custkey % 2 = 0 THEN '주의' ELSE '양호' END WHEN s >= 40 THEN CASE WHEN o_custkey % 2 = 0 THEN '주의' ELSE '관심' END ELSE '주의' END AS grade FROM (SELECT *, o_totalprice / 4000 AS s FROM orders)")
def grade(t):
    from hammerlake.plans import listings

    g = listings.grade(c("o_totalprice") / 4000, c("o_orderpriority") == "1-URGENT", c("o_orderstatus") == "F", c("o_totalprice") - 50000, F.lit(None), c("o_custkey") % 2 == 0)
    return t("orders").select("o_orderkey", g.alias("grade"))


@query("SELECT p_partkey, coalesce(a, b, p_retailprice) AS price, CASE WHEN a IS NOT NULL THEN 'returned' WHEN b IS NOT NULL THEN 'large' ELSE 'list' END AS source FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) FILTER (l_returnflag = 'R' AND l_discount >= 0.09) AS a, max(l_extendedprice) FILTER (l_quantity >= 49) AS b FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def fallback_price(t):
    best = t("lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(F.max(F.when((c("l_returnflag") == "R") & (c("l_discount") >= 0.09), c("l_extendedprice"))).alias("a"), F.max(F.when(c("l_quantity") >= 49, c("l_extendedprice"))).alias("b"))
    return t("part").join(best, "p_partkey", "left").select("p_partkey", F.coalesce("a", "b", "p_retailprice").alias("price"), F.when(c("a").isNotNull(), "returned").when(c("b").isNotNull(), "large").otherwise("list").alias("source"))


@query("WITH x AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 3000 AS p FROM orders), r AS (SELECT *, CASE WHEN p <= 600000000 THEN 0.01::DOUBLE WHEN p <= 900000000 THEN round_even(p * 2 / 300000000.0::DOUBLE - 3, 4) / 100 ELSE 0.03::DOUBLE END AS rate FROM x) SELECT o_orderkey, (round_even(p * rate, 0)::BIGINT + round_even(p * (rate * 0.5::DOUBLE * 0.2::DOUBLE), 0)::BIGINT + round_even(p * 0.002::DOUBLE, 0)::BIGINT) AS tax FROM r")
def tax(t):
    price = F.floor(c("o_totalprice")).cast("bigint") * 3000
    return t("orders").select("o_orderkey", money.acquisition_tax(price, F.lit("아파트"), F.lit(101.0)).alias("tax"))


# text ----------------------------------------------------------------------------------------------------------------
CLAUSES = {"license": "licen[sc]e", "contact": "@|call", "and": r"\band\b"}


@query("SELECT doc_id, " + ", ".join(f"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.;\\n]+'), lambda x: regexp_matches(lower(x), '{p}') AND NOT regexp_matches(lower(x), '{'|'.join(text.NEGATIONS)}'))) > 0 AS says_{k}" for k, p in CLAUSES.items()) + " FROM documents")
def clause_detect(t):
    return t("documents").select("doc_id", *[text.says(c("text"), p).alias(f"says_{k}") for k, p in CLAUSES.items()])


@query("SELECT doc_id, coalesce(len(list_distinct(a)), 0)::INTEGER AS n, coalesce(list_sum(list_distinct(list_transform(a, lambda x: replace(x, ',', '')::BIGINT))), 0)::BIGINT AS total FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]{1,3}(?:,[0-9]{3})+') AS a FROM documents)")
def amount_extract(t):
    found = t("documents").select("doc_id", text.amounts(c("text")).alias("a"))
    return found.select("doc_id", F.size("a").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'redwid')")
def name_search(t):
    return t("part").where(text.contains_squeezed(c("p_name"), "red wid")).select("p_partkey", "p_name")


@query("SELECT conv_id, turn, role, k::INTEGER AS k, s AS sentence FROM (SELECT conv_id, turn, role, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS k FROM conversations)")
def raw_parse(t):
    return t("conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\. ", -1)).alias("k", "sentence"))


from hammerlake.plans import cases, cases_flagship, cases_flows, cases_more  # noqa: E402, F401  register their queries
