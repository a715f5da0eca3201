"""Objects of any store that Hadoop reaches (file, s3a, abfs, ...): put, head, get, ranged get, list, delete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelake.model import InvalidRequest


class ObjectStore:
    """A root path and its keys. Data frames of files are written by the executors; single calls run on the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}".rstrip("/"))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: str, data: bytes) -> None:
        """Whole or not at all: written beside, then renamed."""
        path = self._path(key)
        fs, part = self._fs(path), path.suffix(".tmp")
        out = fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        fs.delete(path, False)
        fs.rename(part, path)

    def create(self, key: str, data: bytes, private: bool = False) -> bool:
        """Put an object unless there is one already; whether it was made. ``private``: for its owner alone, where the store knows owners."""
        path, jvm = self._path(key), self.spark.sparkContext._jvm
        fs = self._fs(path)
        if fs.exists(path):
            return False
        part = path.suffix(f".{uuid.uuid4().hex}.tmp")
        out = fs.create(part, False)
        try:
            if private:
                fs.setPermission(part, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
            out.write(bytearray(data))
        finally:
            out.close()
        made = not fs.exists(path) and fs.rename(part, path)
        fs.delete(part, False)
        return bool(made)

    def head(self, key: str) -> int | None:
        """The object's size; None where there is none or it may not be seen."""
        path = self._path(key)
        fs = self._fs(path)
        return fs.getFileStatus(path).getLen() if fs.exists(path) else None

    def get(self, key: str) -> bytes | None:
        return self.get_range(key, 0, None)

    def get_range(self, key: str, start: int, end: int | None) -> bytes | None:
        """Bytes from ``start`` to ``end`` (included; None: to the end)."""
        size = self.head(key)
        if size is None:
            return None
        n = max(0, min(size, size if end is None else end + 1) - start)
        path = self._path(key)
        stream = self._fs(path).open(path)
        try:
            stream.seek(min(start, size))
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def list(self, prefix: str = "") -> tuple[list[str], list[str]]:
        """The keys and the sub-prefixes right under ``prefix``, sorted."""
        path = self._path(prefix)
        fs = self._fs(path)
        if not fs.exists(path):
            return [], []
        found = list(fs.listStatus(path))
        name = lambda s: f"{prefix.rstrip('/')}/{s.getPath().getName()}".lstrip("/")
        return sorted(name(s) for s in found if s.isFile()), sorted(f"{name(s)}/" for s in found if s.isDirectory())

    def delete(self, key: str) -> bool:
        path = self._path(key)
        return bool(self._fs(path).delete(path, True))

    def write_files(self, files: DataFrame) -> DataFrame:
        """Write ``files`` (key, content) from the executors under a root that all of them mount, and return (key, size).

        Each file is written beside its place and renamed, so that a task that is run again does no harm.
        For roots that only Hadoop reaches, write tables, or single objects with ``put``.
        """
        root = self.root.removeprefix("file://").removeprefix("file:")
        if "://" in root:
            raise InvalidRequest(f"executors can't write single files to {root}")

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import os
            import uuid

            for batch in batches:
                for key, content in zip(batch["key"], batch["content"]):
                    path = f"{root}/{key}"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    part = f"{path}.{uuid.uuid4().hex}.tmp"
                    with open(part, "wb") as f:
                        f.write(bytes(content))
                    os.replace(part, path)
                yield pd.DataFrame({"key": batch["key"], "size": [len(c) for c in batch["content"]]})

        return files.select("key", "content").mapInPandas(put, "key string, size long")

    def files(self, extension: str) -> DataFrame:
        """(key, size) of all objects with ``extension``, at any depth; contents aren't read."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(self.root)
        base = self._path("").toUri().getPath().rstrip("/")
        return listed.select(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base}/", "").alias("key"), F.col("length").alias("size"))
