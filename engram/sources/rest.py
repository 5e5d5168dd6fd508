"""A Python data source for services that give lists page by page: spark.read.format("paged").option("url", ...).load().

url holds {start} and {cursor}. Each start (a label, an account, a month) is a partition of its own that follows its pages
by the cursor that each names. Options: url, starts (comma-separated), items and next (fields of a page), header (Name: value).
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Start(InputPartition):
    name: str


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.starts = options["url"], options.get("starts", "").split(",")
        self.items, self.next = options.get("items", "items"), options.get("next", "next")
        self.header = options.get("header")

    def partitions(self) -> list[Start]:
        return [Start(s.strip()) for s in self.starts]

    def page(self, start: str, cursor: str) -> dict:
        quote = lambda x: urllib.parse.quote(x, safe="")
        request = urllib.request.Request(self.url.format(start=quote(start), cursor=quote(cursor)))
        if self.header:
            name, _, value = self.header.partition(":")
            request.add_header(name.strip(), value.strip())
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)

    def read(self, partition: Start) -> Iterator[tuple[str, str]]:
        cursor, seen = "", set()
        while cursor not in seen:
            seen.add(cursor)
            page = self.page(partition.name, cursor)
            for item in page.get(self.items) or []:
                yield partition.name, json.dumps(item)
            cursor = str(page.get(self.next) or "")
            if not cursor:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "start string, value string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
