"""A paged source as a Spark data source: pages of JSON rows behind a cursor, for batch and streaming reads.

``spark.dataSource.register(PagedSource)``; then ``spark.read.format("paged")`` or ``spark.readStream.format("paged")`` with option ``path`` (shared folder of
page files, read in name order, one JSON object a line). The offset is the name of the last page read, so a restarted stream goes on behind it and new
pages are picked up.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _pages(path: str) -> list[str]:
    return sorted(n for n in os.listdir(path) if n.endswith(".json"))


def _rows(path: str, name: str) -> list[tuple]:
    with open(os.path.join(path, name), encoding="utf-8") as f:
        return [(name, i, line.rstrip("\n")) for i, line in enumerate(f) if line.strip() and json.loads(line) is not None]


class PagePartition(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [PagePartition(n) for n in _pages(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(self.path, partition.name)


class _Stream(DataSourceStreamReader):
    """Pages are listed on the driver and read by the executors, one task a page."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        names = _pages(self.path)
        return {"page": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [PagePartition(n) for n in _pages(self.path) if start["page"] < n <= end["page"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(self.path, partition.name)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page string, pos int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])
