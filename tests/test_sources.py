"""Files, paged services and streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from hammerlake.sources import files, paged, sinks
from hammerlake.streaming import events


def test_trades_from_xml(spark, tmp_path):
    item = "<item><aptNm>가</aptNm><excluUseAr>84.9</excluUseAr><dealAmount> 50,000</dealAmount><dealYear>2026</dealYear><dealMonth>1</dealMonth><umdNm>가동</umdNm><floor>{}</floor><cdealType>{}</cdealType></item>"
    korean = "<item><아파트>나</아파트><전용면적>59.8</전용면적><거래금액>30,000</거래금액><년>2025</년><월>12</월><층>3</층></item><item><아파트>다</아파트><거래금액>1</거래금액></item>"
    (tmp_path / "t.xml").write_text("<response><body><items>" + item.format("x", "O") + item.format("7", "") + korean + "</items></body></response>", encoding="utf-8")
    rows = sorted((r.apt_name, r.price, r.deal_ym, r.floor, r.cancelled) for r in files.trades(spark, str(tmp_path / "t.xml"), "apt").collect())
    assert rows == [("가", 500_000_000, "202601", 0, True), ("가", 500_000_000, "202601", 7, False), ("나", 300_000_000, "202512", 3, False)]


def test_other_kinds_of_trades_and_registers(spark, tmp_path):
    wrap = lambda x: "<response><body><items>" + "".join(f"<item>{i}</item>" for i in x) + "</items></body></response>"
    common = "<dealAmount> 50,000</dealAmount><dealYear>2026</dealYear><dealMonth>3</dealMonth><umdNm>가동</umdNm>"
    files_of = {
        "sh": [common + "<houseType>다가구</houseType><totalFloorAr>120.5</totalFloorAr><plottageAr>90</plottageAr>", common + "<대지면적>80</대지면적>", common],
        "nrg": [common + "<buildingUse>업무</buildingUse><buildingType>집합</buildingType><buildingAr>33</buildingAr><floor>3</floor>"],
        "land": [common + "<jimok>대</jimok><dealArea>55.5</dealArea><landUse>주거</landUse><shareDealingType>지분</shareDealingType>", "<dealAmount>0</dealAmount><dealArea>5</dealArea>"],
    }
    got = {}
    for kind, items in files_of.items():
        (tmp_path / f"{kind}.xml").write_text(wrap(items), encoding="utf-8")
        rows = files.other_trades(spark, str(tmp_path / f"{kind}.xml"), kind)
        got[kind] = sorted((r.price, r.area_m2, r.deal_ym, r.name, r.plot_area_m2, r.subtype, r.zoning, r.floor) for r in rows.collect())
        assert {(r.kind, r.lawd_cd, r.apt_name) for r in files.as_trades(rows, "11110").collect()} == {(kind, "11110", "")}
    m = 500_000_000
    assert got == {"sh": [(m, 80.0, "202603", "단독/다가구", 80.0, "", "", 0), (m, 120.5, "202603", "다가구", 90.0, "다가구", "", 0)], "nrg": [(m, 33.0, "202603", "업무", 0.0, "집합", "", 3)], "land": [(m, 55.5, "202603", "대", 0.0, "지분", "주거", 0)]}
    (tmp_path / "b.xml").write_text(wrap(["<bldNm>가동</bldNm><useAprDay>20000315</useAprDay><totArea>100.5</totArea><grndFlrCnt>x</grndFlrCnt><violYn>1</violYn>"]), encoding="utf-8")
    r = files.registers(spark, str(tmp_path / "b.xml")).first()
    assert (r.name, r.approved, r.area_m2, r.floors_above, r.violation, r.purpose) == ("가동", "20000315", 100.5, 0, "1", "")


def test_json_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"court": "c", "case_no": "1", "area_m2": 1.5}]))
    r = files.listings(spark, str(tmp_path / "l.json")).first()
    assert (r.case_no, r.item_no, r.min_bid_price) == ("1", "", None)
    (tmp_path / "o.json").write_text(json.dumps({"1": {"actual_nakchal": 5}, "note": "x"}))
    assert [tuple(r) for r in files.outcomes(spark, str(tmp_path / "o.json")).collect()] == [("1", 5, None)]
    body = json.dumps({"realPriceOnMonthList": [{"realPriceList": [{"tradeYear": "2026", "tradeMonth": "1", "dealPrice": 5, "deleteYn": "Y"}]}]})
    assert [tuple(r) for r in files.price_months(spark.createDataFrame([(1, body)], "id int, body string")).collect()] == [(1, "20260100", 50_000, 0, 1)]


class Service(BaseHTTPRequestHandler):
    lost = 0

    def do_GET(self):
        q = dict(x.split("=") for x in self.path.partition("?")[2].split("&"))
        rows = [{"id": i, "name": f"n{i}"} for i in range(95) if i >= int(q.get("id_min", 0))]
        size, page = int(q["size"]), int(q["page"])
        body = json.dumps({"totalCnt": len(rows), "rows": rows[(page - 1) * size : page * size - self.lost]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_paged_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paged.register(spark)
    read = lambda **o: spark.read.format("paged").schema("id long, name string").options(url=f"http://127.0.0.1:{server.server_port}/", pushed="id", **o).load()
    assert read().count() == 95 and read(size="10").where("id >= 90").count() == 5
    with pytest.raises(Exception, match="max_pages"):
        read(max_pages="1").count()
    Service.lost = 3
    with pytest.raises(Exception, match="short without a word"):
        read(size="10").count()
    server.shutdown()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 127.0, 37.5), (2, None, 37.5)], "id int, lon double, lat double")
    assert json.loads(sinks.features(rows).first()[0])["geometry"]["coordinates"] == [127.0, 37.5]
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_partitions(rows, str(tmp_path / "p"), ["id"])
    sinks.write_partitions(rows.where("id = 1").withColumn("lat", F.lit(0.0)), str(tmp_path / "p"), ["id"])
    assert {(r.id, r.lat) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, 0.0), (2, 37.5)}


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    run(events.tumbling(stream, "1 day"), "tumbled", "complete")
    want = {tuple(r) for r in events.tumbling(src, "1 day").collect()}
    assert {tuple(r) for r in spark.table("tumbled").collect()} == want
    run(events.limited(stream, 86_400, 2), "limited", "append")
    rows = spark.table("limited").orderBy("user_id", "ts").collect()
    assert len(rows) == src.count()
    kept = {}
    for r in rows:
        kept[r.user_id] = [x for x in kept.get(r.user_id, []) if x > r.ts.timestamp() - 86_400]
        assert r.allowed == (len(kept[r.user_id]) < 2)
        kept[r.user_id] += [r.ts.timestamp()] * r.allowed
