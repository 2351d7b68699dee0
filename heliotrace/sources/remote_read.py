"""Remote read as a data source: ``spark.dataSource.register(RemoteRead)``, then ``spark.read.format("remote_read")``.

Options: ``url``; ``start`` and ``end`` in milliseconds; ``matchers`` as JSON [[name, op, value], ...];
``window`` in milliseconds (an hour by default); ``token``. Each window is a partition, fetched in its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from heliotrace.sources import remote_write
from heliotrace.sources.transfer import read_windows


class Window(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class RemoteRead(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_read"

    def schema(self) -> str:
        return remote_write.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.token = options["url"], options.get("token")
        self.matchers = [tuple(m) for m in json.loads(options.get("matchers", "[]"))]
        self.windows = read_windows(int(options["start"]), int(options["end"]), int(options.get("window", 3_600_000)))

    def partitions(self) -> list[Window]:
        return [Window(a, b) for a, b in self.windows]

    def read(self, partition: Window) -> Iterator[tuple]:
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/x-protobuf", "Content-Encoding": "snappy", "X-Prometheus-Remote-Read-Version": "0.1.0"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urlopen(Request(self.url, remote_write.read_request(partition.start, partition.end, self.matchers), headers, method="POST"), timeout=300) as answer:
            for row in remote_write.read_response(answer.read()):
                yield row["timestamp_nanos"], dict(row["labels"]), row["value"], row["kind"], row["reject_reason"]
