"""Versions, keyed tables, the daily refresh, replays and migrations: what is stored when, and what a crash leaves."""

import os

import pytest
from pyspark.sql import functions as F

from hammerlake.operators import migrations
from hammerlake.plans import refresh
from hammerlake.sources import keyed, versions

ACTIVE = "court string, case_no string, date string, price long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class Died(Exception):
    pass


def die(*_, **__):
    raise Died


@pytest.fixture
def served(spark, tmp_path):
    root = str(tmp_path / "served")
    active = spark.createDataFrame([("A", str(k), "2024-01-05" if k < 4 else "2024-03-05", 10 * k) for k in range(10)], ACTIVE)
    sold = spark.createDataFrame([("A", "old", "2023-01-01", 5), ("A", "back", "2023-01-01", 6)], "court string, case_no string, sold_date string, sold_price long")
    rights = spark.createDataFrame([("A", x) for x in ("0", "1", "5", "old", "none")], "court string, case_no string")
    tables = {"active": active, "sold": sold, "rights": rights}
    versions.publish(spark, root, versions.Version(), {t: [versions.stage(df, root, t)] for t, df in tables.items()})
    return root


def crawl(spark, numbers, extra=()):
    return spark.createDataFrame([("A", str(k), "2024-03-05", 11 * k) for k in numbers] + list(extra), ACTIVE)


def run(spark, root, found, **more):
    return refresh.refresh(spark, root, found, ["court", "case_no"], "date", "price", F.lit("2024-02-01"), **more)


def test_modes():
    assert [refresh.mode(*x) for x in ((0, 10, False), (0, 0, True), (7, 10, False), (8, 10, False), (9, 10, True), (5, 0, False))] == ["keep", "keep", "merge", "replace", "merge", "replace"]


def test_replace(spark, served):
    out = run(spark, served, crawl(spark, range(2, 10), [("A", "back", "2024-03-01", 7)]))
    assert (out.how, out.version) == ("replace", 2)
    assert [r[1] for r in rows(versions.table(spark, served, "active"))] == ["2", "3", "4", "5", "6", "7", "8", "9", "back"]
    # 0 and 1 were to be sold before today; 0 has no price. "back" is offered again
    assert rows(versions.table(spark, served, "sold").na.fill(-1)) == [("A", "0", "2024-01-05", -1), ("A", "1", "2024-01-05", 10), ("A", "old", "2023-01-01", 5)]
    assert [r[1] for r in rows(versions.table(spark, served, "rights"))] == ["0", "1", "5", "old"]


@pytest.mark.parametrize("numbers, partial", [(range(3, 9), False), (range(1, 10), True)])
def test_too_few_or_cut_short_is_merged(spark, served, numbers, partial):
    out = run(spark, served, crawl(spark, numbers, [("A", "new", "2024-03-01", 7)]), partial=partial)
    assert out.how == "merge" and versions.table(spark, served, "active").count() == 11 and versions.table(spark, served, "rights").count() == 5
    assert {r.price for r in versions.table(spark, served, "active").where("case_no = '5'").collect()} == {55}


def test_nothing_found_or_a_failed_gate_keeps_all(spark, served):
    before = {t: rows(versions.table(spark, served, t)) for t in refresh.TABLES}
    assert run(spark, served, crawl(spark, [])).how == "keep"
    gates = lambda t: t["active"].agg(F.lit("no_zero").alias("name"), (F.min("price") > 0).alias("passed"))
    assert run(spark, served, crawl(spark, range(10)), gates=gates).failed == ("no_zero",)
    assert versions.numbers(spark, served) == [1] and before == {t: rows(versions.table(spark, served, t)) for t in refresh.TABLES}
    assert run(spark, served, crawl(spark, range(1, 10)), gates=gates).version == 2


@pytest.mark.parametrize("step", ["stage", "publish", "second stage"])
def test_a_crash_leaves_one_version(spark, served, monkeypatch, step):
    before, real = {t: rows(versions.table(spark, served, t)) for t in refresh.TABLES}, versions.stage
    calls = []

    def second(df, root, name, *more):
        calls.append(name)
        return die() if len(calls) == 2 else real(df, root, name, *more)

    monkeypatch.setattr(versions, step.split()[-1], second if " " in step else die)
    with pytest.raises(Died):
        run(spark, served, crawl(spark, range(1, 10)))
    monkeypatch.undo()
    assert before == {t: rows(versions.table(spark, served, t)) for t in refresh.TABLES}
    assert run(spark, served, crawl(spark, range(1, 10))).version == 2
    assert len(versions.clean(spark, served, keep=1)) >= 3 and versions.table(spark, served, "active").count() == 9


def test_two_writers(spark, served):
    base = versions.load(spark, served)
    versions.publish(spark, served, base, {"x": ["data/x"]})
    with pytest.raises(versions.Conflict):
        versions.publish(spark, served, base, {"x": ["data/y"]})
    assert versions.load(spark, served).tables["x"] == ["data/x"]


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_batch_of_one_row_writes_one_bucket(spark, tmp_path, monkeypatch):
    store = keyed.Keyed(spark, root := str(tmp_path / "raw"), ["uid"], buckets=8)
    assert store.read() is None
    layout = "uid string, body string, fetched string"
    newest = keyed.latest_wins(["uid"], ["fetched"])
    assert store.merge(spark.createDataFrame([(str(k), "a", "1") for k in range(200)], layout), newest) == list(range(8))
    before = files(root)
    one = spark.createDataFrame([("7", "b", "2")], layout)
    assert len(store.merge(one, newest)) == 1 and len(files(root) - before) == 1
    assert store.merge(spark.createDataFrame([("7", "old", "0"), ("x", "c", "1")], layout), newest)
    assert {r.uid: r.body for r in store.read().collect()} == {**{str(k): "a" for k in range(200)}, "7": "b", "x": "c"}
    assert rows(store.point(uid="7")) == [("7", "b", "2")] and keyed.Keyed(spark, root, ["uid"], buckets=99).buckets == 8
    # a crash while buckets are written changes nothing
    seen = rows(store.read())
    monkeypatch.setattr(versions, "publish", die)
    with pytest.raises(Died):
        store.merge(spark.createDataFrame([("7", "z", "9")], layout), newest)
    monkeypatch.undo()
    assert rows(store.read()) == seen and store.merge(one.where("false"), newest) == []
    assert store.delete(spark.createDataFrame([("7",), ("8",), ("gone",)], "uid string")) == (2, 3) and store.read().count() == 199
    assert versions.clean(spark, root, keep=1) and store.read().count() == 199


def test_kinds_of_merges(spark, tmp_path):
    trades = keyed.Keyed(spark, str(tmp_path / "trades"), ["pair", "ymd", "price"], 4)
    layout = "pair string, ymd string, price long, deleted boolean, floor long"
    once = keyed.counted_once(["pair", "ymd", "price"], "deleted", ["floor"])
    trades.merge(spark.createDataFrame([("a", "1", 5, False, 3), ("a", "1", 5, True, 3), ("b", "2", 6, False, 1)], layout), once)
    trades.merge(spark.createDataFrame([("b", "2", 6, True, 1), ("c", "3", 7, False, 2)], layout), once)
    assert rows(trades.read().select("pair", "deleted")) == [("a", True), ("b", True), ("c", False)]
    asks = keyed.Keyed(spark, str(tmp_path / "asks"), ["id"], 4)
    tagged = keyed.tags_joined(["id"], "tags", "at")
    for tags, at in (("new/sunny", 1), (None, 2), ("sunny/wide", 3)):
        asks.merge(spark.createDataFrame([(1, tags, at)], "id long, tags string, at long"), tagged)
    assert rows(asks.read()) == [(1, "new/sunny/wide", 3)]
    homes = keyed.Keyed(spark, str(tmp_path / "homes"), ["id"], 4)
    for name, asked in (("Tower", 10), ("", 11), (None, None)):
        homes.merge(spark.createDataFrame([(1, name, asked)], "id long, name string, asked long"), keyed.known_stays(["id"], ["name"], ["asked"]))
    assert rows(homes.read()) == [(1, "Tower", 11)]


def test_replay(spark, tmp_path):
    raw = spark.createDataFrame([("a", "1,200"), ("b", "7"), ("c", "x")], "id string, body string")
    strict = lambda r: r.select("id", F.col("body").try_cast("long").alias("price"))
    lenient = lambda r: r.select("id", F.regexp_replace("body", ",", "").try_cast("long").alias("price"))
    root, at = str(tmp_path / "t"), lambda parse, name: rows(keyed.replay(raw, parse, name, spark, root, "trades", ["id"]))
    assert at(strict, "1") == [("a", "new"), ("b", "new"), ("c", "new")]
    assert at(strict, "1") == [] and versions.numbers(spark, root) == [1]
    assert at(lenient, "2") == [("a", "changed")] and versions.load(spark, root).properties["trades.parser"] == "2"
    assert rows(versions.table(spark, root, "trades").na.fill(-1)) == [("a", 1200), ("b", 7), ("c", -1)]


def test_migrations(spark):
    steps = [migrations.Step(2, {"item": ("string", "''")}, key=("case_no", "item"), by=("profit",)), migrations.Step(3, {"scope": ("string", "''"), "low": ("int", "null")}), migrations.Step(4, {"factor": ("double", "1.0")}, {"profit": "gain"}, ("note",))]
    v1 = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 3, "z")], "case_no string, profit int, note string")
    assert rows(migrations.migrate(v1, 1, steps).select("case_no", "item", "gain", "scope", "factor")) == [("a", "", 1, "", 1.0), ("b", "", 3, "", 1.0)]
    assert [(r.version, r.key, r.n) for r in migrations.collisions(v1, 1, steps).collect()] == [(2, '{"case_no":"b","item":""}', 2)]
    v3 = migrations.migrate(v1, 1, steps[:2]).withColumn("scope", F.lit("kept"))
    assert {r.scope for r in migrations.migrate(v3, 3, steps).collect()} == {"kept"} and "note" not in migrations.migrate(v3, 3, steps).columns
    assert migrations.migrate(migrations.migrate(v1, 1, steps), 2, steps).columns == migrations.migrate(v1, 1, steps).columns
    with pytest.raises(ValueError):
        migrations.migrate(v1, 1, [steps[0], steps[2]])
