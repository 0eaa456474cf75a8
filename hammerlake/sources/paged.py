"""A data source for paged services: page one tells how many there are, and each further page is a partition."""

from __future__ import annotations

import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual


#: The share of its rows that a page has at least; a service may lose a few between two calls, but no more.
LEAST_SHARE = 0.9


class Page(InputPartition):
    def __init__(self, number: int, rows: int) -> None:
        super().__init__(number)
        self.number, self.rows = number, rows


class PagedReader(DataSourceReader):
    """Equality and range filters on columns in ``pushed`` go to the service as parameters; Spark checks the rest."""

    def __init__(self, schema, options: dict) -> None:
        self.names, self.options, self.params = schema.names, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        pushed = set(filter(None, self.options.get("pushed", "").split(",")))
        for f in filters:
            suffix = {EqualTo: "", GreaterThanOrEqual: "_min", LessThanOrEqual: "_max"}.get(type(f))
            if suffix is not None and len(f.attribute) == 1 and f.attribute[0] in pushed:
                self.params[f.attribute[0] + suffix] = f.value
            yield f  # services filter coarsely, so the exact condition stays

    def fetch(self, number: int) -> dict:
        """A page, tried again with growing pauses; a body that isn't the expected object is an error, never no data."""
        url = self.options["url"] + "?" + urllib.parse.urlencode({**self.params, "page": number, "size": self.options.get("size", "40")})
        tries = int(self.options.get("tries", "3"))
        for k in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    body = json.loads(answer.read())
                if not isinstance(body, dict) or "totalCnt" not in body or not isinstance(body.get("rows"), list):
                    raise ValueError(f"{url}: the answer has no rows")
                return body
            except OSError:
                if k + 1 == tries:
                    raise
                time.sleep(float(self.options.get("pause", "0.5")) * 2**k)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        total, size = int(self.fetch(1)["totalCnt"]), int(self.options.get("size", "40"))
        pages = math.ceil(total / size)
        if pages > (most := int(self.options.get("max_pages", "10000"))):
            raise ValueError(f"{pages} pages are more than max_pages={most}: a part of the rows would be missing")
        return [Page(k, min(size, total - size * (k - 1))) for k in range(1, pages + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = self.fetch(partition.number)["rows"]
        if len(rows) < LEAST_SHARE * partition.rows:
            raise ValueError(f"page {partition.number} has {len(rows)} rows of {partition.rows}: the table would be short without a word")
        for row in rows:
            yield tuple(row.get(c) for c in self.names)


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("url", ...)``; also size, pushed, tries, pause and max_pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
