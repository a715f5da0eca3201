"""``spark.read.format("queue_wal")``: WAL files as a table of entries, a partition a file.

The range is given by options, not by pushed filters: Spark keeps what was
pushed with the relation, and a later, wider scan of the same data frame would miss rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class WalFile(InputPartition):
    def __init__(self, queue: str, file_id: int, path: str) -> None:
        self.queue, self.file_id, self.path = queue, file_id, path


class WalReader(DataSourceReader):
    def __init__(self, root: str, queue: str | None, low: int, high: int | None) -> None:
        self.root, self.queue, self.low, self.high = root, queue, low, high

    def partitions(self) -> list[WalFile]:
        """The files, by listing; those that a later file's header shows to end before the range are left out."""
        from queuelake.sources.wal import HEADER_READ, FormatError, WalHeader

        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(".wal") and "/wal" in folder:
                    queue, _, rest = f"{folder}/{name[:-4]}".removeprefix(self.root).rpartition("/wal/")
                    if self.queue in (None, queue):
                        found.append(WalFile(queue, int(rest.replace("/", ""), 16), f"{folder}/{name}"))
        found.sort(key=lambda f: (f.queue, f.file_id))
        kept, following = [], {}
        for f in reversed(found):
            with open(f.path, "rb") as file:
                try:
                    before = WalHeader.decode(file.read(HEADER_READ))[0].entries_before
                except FormatError:
                    continue
            if following.get(f.queue, self.low + 1) > self.low and (self.high is None or before <= self.high):
                kept.append(f)
            following[f.queue] = before
        return kept[::-1] or [WalFile("", 0, "")]

    def read(self, partition: WalFile) -> Iterator[tuple]:
        from queuelake.sources.wal import decode_file

        if not partition.path:
            return
        with open(partition.path, "rb") as file:
            _, entries = decode_file(file.read())
        for i, data in entries:
            if i >= self.low and (self.high is None or i <= self.high):
                yield partition.queue, partition.file_id, i, data


class WalDataSource(DataSource):
    """Options: path, a folder that all executors see; queue, start and end (ids, included) to read a part."""

    @classmethod
    def name(cls) -> str:
        return "queue_wal"

    def schema(self) -> str:
        return "queue string, file_id long, id long, data binary"

    def reader(self, schema) -> WalReader:
        end = self.options.get("end")
        return WalReader(self.options["path"].removeprefix("file:").rstrip("/"), self.options.get("queue"), int(self.options.get("start", "0")), None if end is None else int(end))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalDataSource)
