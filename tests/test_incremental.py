"""The source of histories in pages: early stops, budgets, rounds and restarts, with every request counted."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from hammerlake.sources import incremental


@pytest.fixture
def service():
    """Pages of two trades, newest first, by key; ``asked`` counts the requests."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            at = 2 * (int(q["page"]) - 1)
            asked[q["key"], int(q["page"])] += 1
            body = {"rows": trades[q["key"]][at : at + 2]} if q["key"] not in broken else {"error": 1}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    day = lambda n: {"trade_ymd": f"202401{n:02d}", "price": n}
    trades, asked, broken = {k: [day(n) for n in range(20, 20 - 2 * i, -1)] for i, k in enumerate("abcd", 1)}, Counter(), set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", trades, asked, broken, day
    server.shutdown()


def test_scan():
    pages = {1: [{"d": "20240105"}], 2: [{"d": "20240104"}], 3: [{"d": "?"}], 4: [{"d": "20240101"}], 5: [{"d": "20240101"}], 6: [{"d": "20240101"}]}
    asked = []

    def fetch(page):
        asked.append(page)
        return pages.get(page, [])

    def of(mark, most=9, safety=1):
        asked.clear()
        rows, whole = incremental.scan(fetch, "d", mark, most, safety)
        return len(rows), whole, len(asked)

    assert of(None) == (6, True, 7)  # everything, up to the empty page
    assert of(None, most=4) == (4, False, 4)  # cut by the limit: not whole
    assert of("20240104") == (5, True, 5)  # the unreadable date may be new; two idle pages end it
    assert of("20240105", safety=0) == (1, True, 1)
    assert incremental.scan(fetch, "d", "20240105", 9, 0, first=pages[1]) == (pages[1], True)


def run(spark, url, tmp_path, round_, **more):
    """Everything that a stream gives until it has caught up, from its own folder."""
    incremental.register(spark)
    options = {"url": url, "keys": json.dumps(list("abcd")), "round": round_, "budget": 3, "pause": 0.01, **more}
    rows = spark.readStream.format("history").schema("key string, trade_ymd string, price long, exhausted boolean").options(**options).load()
    out, at = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    q = rows.withColumn("round", F.lit(round_)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
    try:
        q.processAllAvailable()
        batches = [p for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    return spark.read.parquet(out).where(F.col("round") == round_), len(batches)


def test_rounds(spark, service, tmp_path):
    url, trades, asked, _, day = service
    found, batches = run(spark, url, tmp_path, "1")
    assert Counter(r.key for r in found.collect()) == {"a": 2, "b": 4, "c": 6, "d": 8} and batches == 2  # three keys, then one
    assert asked == Counter({(k, p): 1 for i, k in enumerate("abcd", 1) for p in range(1, i + 2)})  # the page behind the last is empty
    # a restart in the same round asks for nothing
    asked.clear()
    run(spark, url, tmp_path, "1")
    assert not asked
    # the next round: one new trade of c; two idle pages end a scan, or an empty one
    trades["c"].insert(0, day(25))
    found, _ = run(spark, url, tmp_path, "2")
    assert asked == Counter({("a", 1): 1, ("a", 2): 1, ("b", 1): 1, ("b", 2): 1, ("c", 1): 1, ("c", 2): 1, ("c", 3): 1, ("d", 1): 1, ("d", 2): 1})
    assert {r.price for r in found.where("key = 'c'").collect()} >= {25} and {r.exhausted for r in found.collect()} == {True}
    # nothing new: marks are those of the round before
    asked.clear()
    run(spark, url, tmp_path, "3")
    assert asked[("c", 2)] == 1 and ("c", 3) not in asked and max(asked.values()) == 1


def test_limits_are_told(spark, service, tmp_path):
    url, *_ = service
    found, _ = run(spark, url, tmp_path, "1", max_pages=2)
    assert {(r.key, r.exhausted) for r in found.collect()} == {("a", True), ("b", False), ("c", False), ("d", False)}


def test_a_failed_batch_is_read_again(spark, service, tmp_path):
    url, trades, asked, broken, _ = service
    broken.add("d")
    with pytest.raises(Exception, match="has no rows"):
        run(spark, url, tmp_path, "1", tries=1)
    first = Counter(asked)
    broken.clear()
    found, _ = run(spark, url, tmp_path, "1")
    assert Counter(r.key for r in found.collect()) == {"a": 2, "b": 4, "c": 6, "d": 8}
    assert all(asked[k] == first[k] for k in first if k[0] in "abc")  # what was committed isn't asked for again
