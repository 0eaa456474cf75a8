"""A streaming data source for histories in pages, newest first: only what is new of each key, a few keys in each trigger."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: What a page's rows carry besides their own fields: whether the scan of the key saw all that it had to.
EXHAUSTED = "exhausted"


def newer(rows: list[dict], date: str, mark: str | None) -> bool:
    """Whether a page may hold something that isn't known; a date that can't be read may be new, and without a mark everything is."""
    return mark is None or any(not (isinstance(d := row.get(date), str) and len(d) == 8 and d.isdigit()) or d > mark for row in rows)


def scan(fetch: Callable[[int], list[dict]], date: str, mark: str | None, most: int, safety: int = 1, first: list[dict] | None = None) -> tuple[list[dict], bool]:
    """The rows of pages 1, 2, ... and whether the scan was whole: up to an empty page, or ``safety`` + 1 pages without anything new.

    A scan that is ended by ``most`` pages is not whole. ``first`` is page 1, if it was fetched already.
    """
    out: list[dict] = []
    idle = 0
    for page in range(1, most + 1):
        rows = first if page == 1 and first is not None else fetch(page)
        if not rows:
            return out, True
        out += rows
        idle = 0 if newer(rows, date, mark) else idle + 1
        if idle > safety:
            return out, True
    return out, False


class KeyPart(InputPartition):
    def __init__(self, key: str, mark: str | None, first: list[dict] | None) -> None:
        super().__init__(key)
        self.key, self.mark, self.first = key, mark, first


class HistoryReader(DataSourceStreamReader):
    """Offsets hold the round, how many of its keys were dealt with, and for each key the newest date that was seen.

    A trigger takes the next ``budget`` keys. Their first pages are fetched where the offset is planned, as they tell the
    newest dates, and travel with the partitions; the executors fetch the rest, and stop at what was known before the trigger. A round has
    ended when all keys were dealt with; the next one begins when the stream is started with another ``round``.
    """

    def __init__(self, schema, options: dict) -> None:
        self.names, self.options = schema.names, options
        self.keys = json.loads(options["keys"])
        self.date = options.get("date", "trade_ymd")
        self.firsts: dict[tuple[int, str], list[dict]] = {}
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {"round": "", "at": 0, "marks": "{}", "before": "{}"}

    def latestOffset(self) -> dict:
        # Spark doesn't tell where it stands; after a restart it plans the last batch once more, which does
        start = self.now or self.initialOffset()
        at = start["at"] if start["round"] == self.options["round"] else 0
        due = self.keys[at : at + int(self.options.get("budget", "100"))]
        if not due:
            return start
        marks = json.loads(start["marks"])
        new = dict(marks)
        for k, key in enumerate(due, at):
            if (k, key) not in self.firsts:
                self.firsts[k, key] = self.fetch(key, 1)
            rows = self.firsts[k, key]
            dates = [d for row in rows if isinstance(d := row.get(self.date), str) and len(d) == 8 and d.isdigit()]
            if dates and max(dates) > new.get(key, ""):
                new[key] = max(dates)
        return {"round": self.options["round"], "at": at + len(due), "marks": json.dumps(new), "before": json.dumps({k: marks.get(k) for k in due})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = end
        before = json.loads(end["before"])
        first = end["at"] - len(before)
        return [KeyPart(key, mark, self.firsts.pop((first + k, key), None)) for k, (key, mark) in enumerate(before.items())]

    def fetch(self, key: str, page: int) -> list[dict]:
        """A page of a key's history, tried again with growing pauses; a body of another shape is an error, never no data."""
        url = self.options["url"] + "?" + urllib.parse.urlencode({"key": key, "page": page})
        tries = int(self.options.get("tries", "3"))
        for k in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    body = json.loads(answer.read())
                if not isinstance(body, dict) or not isinstance(body.get("rows"), list):
                    raise ValueError(f"{url}: the answer has no rows")
                return body["rows"]
            except OSError:
                if k + 1 == tries:
                    raise
                time.sleep(float(self.options.get("pause", "0.5")) * 2**k)
        raise AssertionError

    def read(self, partition: KeyPart) -> Iterator[tuple]:
        most, safety = int(self.options.get("max_pages", "25")), int(self.options.get("safety", "1"))
        rows, whole = scan(lambda page: self.fetch(partition.key, page), self.date, partition.mark, most, safety, partition.first)
        for row in rows:
            yield tuple(partition.key if c == "key" else whole if c == EXHAUSTED else row.get(c) for c in self.names)


class HistorySource(DataSource):
    """``spark.readStream.format("history").schema(...)`` with options url, keys (JSON list), round, and date, budget, max_pages, safety, tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def streamReader(self, schema) -> HistoryReader:
        return HistoryReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HistorySource)
