"""WAL segment files: codec, decoder over ``binaryFile`` scans, and writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelake.functions.uintn import VALID_SIZES, in_step, path_to_id
from queuelake.model import DEFAULT_DATA_SIZE, DEFAULT_ID_SIZE, ENTRY_OVERHEAD, WAL_FIXED_HEADER, width_of

HEADER_READ = 128
#: A header's count of entries never takes more bytes than this.
LONGEST_COUNT = 10 << 20


class FormatError(ValueError):
    """Bytes that aren't the format."""


def put_prefixed(value: int) -> bytes:
    size = width_of(value)
    return struct.pack("<Q", size) + value.to_bytes(size, "little")


def get_prefixed(data: bytes, at: int) -> tuple[int, int]:
    """A length-prefixed number and the place after it."""
    if len(data) < at + 8:
        raise FormatError("too short")
    size = struct.unpack_from("<Q", data, at)[0]
    if size > LONGEST_COUNT or len(data) < at + 8 + size:
        raise FormatError("too short")
    return int.from_bytes(data[at + 8 : at + 8 + size], "little"), at + 8 + size


@dataclass(frozen=True)
class WalHeader:
    data_size: int = DEFAULT_DATA_SIZE
    id_size: int = DEFAULT_ID_SIZE
    entries_before: int = 0

    def __post_init__(self) -> None:
        if self.data_size not in VALID_SIZES or self.id_size not in VALID_SIZES:
            raise FormatError("not a width")

    def encode(self) -> bytes:
        return struct.pack("<3Q", 0, self.data_size, self.id_size) + put_prefixed(self.entries_before)

    @classmethod
    def decode(cls, data: bytes) -> tuple[WalHeader, int]:
        if len(data) < WAL_FIXED_HEADER:
            raise FormatError("too short")
        version, data_size, id_size = struct.unpack_from("<3Q", data)
        if version:
            raise FormatError(f"unsupported version {version}")
        before, at = get_prefixed(data, WAL_FIXED_HEADER)
        return cls(data_size, id_size, before), at

    def resized(self, entry_id: int, length: int) -> WalHeader:
        return WalHeader(max(self.data_size, width_of(length)), max(self.id_size, width_of(entry_id)), self.entries_before)

    def can_hold(self, entry_id: int, length: int) -> bool:
        return width_of(entry_id) <= self.id_size and width_of(length) <= self.data_size


def encode_entry(header: WalHeader, entry_id: int, payload: bytes) -> bytes:
    import xxhash

    return b"".join((b"\0" * 8, entry_id.to_bytes(header.id_size, "little"), len(payload).to_bytes(header.data_size, "little"), struct.pack("<Q", xxhash.xxh64_intdigest(payload, 0)), payload))


def encode_file(header: WalHeader, entries: list[tuple[int, bytes]]) -> bytes:
    return header.encode() + b"".join(encode_entry(header, i, d) for i, d in entries)


def decode_entries(data: bytes, header: WalHeader, at: int) -> Iterator[tuple[int, bytes]]:
    """Entries up to the first that is cropped, has a bad checksum or another version: the longest valid prefix."""
    import xxhash

    n, fixed = len(data), ENTRY_OVERHEAD + header.id_size + header.data_size
    while at + fixed <= n:
        id_end = at + 8 + header.id_size
        size_end = id_end + header.data_size
        size = int.from_bytes(data[id_end:size_end], "little")
        start = at + fixed
        if data[at : at + 8] != b"\0" * 8 or start + size > n:
            return
        payload = data[start : start + size]
        if xxhash.xxh64_intdigest(payload, 0) != struct.unpack_from("<Q", data, size_end)[0]:
            return
        yield int.from_bytes(data[at + 8 : id_end], "little"), payload
        at = start + size


def decode_file(data: bytes) -> tuple[WalHeader | None, list[tuple[int, bytes]]]:
    """The header, or None where it is missing or bad, and the valid prefix."""
    try:
        header, at = WalHeader.decode(data)
    except FormatError:
        return None, []
    return header, list(decode_entries(data, header, at))


def read_files(spark: SparkSession, root: str, extension: str = "wal") -> DataFrame:
    """(queue, file_id, path, length, content) of the segment files under ``root``: queue/wal/000.wal and so on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(root)
    parts = F.regexp_extract("path", rf"^(.*)/{extension}/([0-9a-f/]+)\.{extension}$", 1), F.regexp_extract("path", rf"/{extension}/([0-9a-f/]+)\.{extension}$", 1)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    queue = F.regexp_replace(F.regexp_replace(parts[0], "^[a-z0-9]+:/*", "/"), f"^{base}", "")
    return files.select(queue.alias("queue"), path_to_id(parts[1]).alias("file_id"), "path", "length", "content")


def closed_files(files: DataFrame, current: int) -> DataFrame:
    """The files before the one that is being written: what compaction may take."""
    return files.where(F.col("file_id") < current)


def decode(files: DataFrame) -> DataFrame:
    """(queue, file_id, id, data) of the valid prefixes of ``files`` (queue, file_id, content). Unreadable files give no rows."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queue, file_id, content in zip(batch["queue"], batch["file_id"], batch["content"]):
                _, entries = decode_file(bytes(content))
                for k in range(0, len(entries), 10_000):
                    part = entries[k : k + 10_000]
                    yield pd.DataFrame({"queue": queue, "file_id": file_id, "id": [i for i, _ in part], "data": [d for _, d in part]})

    return files.select("queue", "file_id", "content").mapInPandas(of, "queue string, file_id long, id long, data binary")


def index(files: DataFrame, tier: str = "WAL") -> DataFrame:
    """A segment index row for each file, the empty, header-only and corrupt included (state)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for queue, file_id, content in zip(batch["queue"], batch["file_id"], batch["content"]):
                content = bytes(content)
                header, entries = decode_file(content)
                state = "VALID" if entries else "EMPTY" if not content else "CORRUPT" if header is None else "HEADER_ONLY"
                h = header or WalHeader()
                out.append((queue, file_id, tier, h.entries_before, len(entries), entries[0][0] if entries else None, entries[-1][0] if entries else None, len(content), h.id_size, h.data_size, state))
            frame = pd.DataFrame(out, columns=["queue", "file_id", "tier", "entries_before", "num_entries", "first_id", "last_id", "bytes", "id_size", "data_size", "state"])
            yield frame.astype({"first_id": "Int64", "last_id": "Int64"})

    from queuelake.model import SEGMENT

    return files.select("queue", "file_id", "content").mapInPandas(of, SEGMENT)


def headers(files: DataFrame) -> DataFrame:
    """(queue, file_id, data_size, id_size, entries_before) from the first bytes of each file; bad headers give no row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for queue, file_id, content in zip(batch["queue"], batch["file_id"], batch["head"]):
                try:
                    h, _ = WalHeader.decode(bytes(content))
                except FormatError:
                    continue
                out.append((queue, file_id, h.data_size, h.id_size, h.entries_before))
            yield pd.DataFrame(out, columns=["queue", "file_id", "data_size", "id_size", "entries_before"])

    head = files.select("queue", "file_id", F.substring("content", 1, HEADER_READ).alias("head"))
    return head.mapInPandas(of, "queue string, file_id long, data_size int, id_size int, entries_before long")


def read_range(files: DataFrame, start: int, end: int | None = None, step: int = 1) -> DataFrame:
    """The decoded entries of an id range and step."""
    rows = decode(files).where(in_step(F.col("id"), start, step))
    return rows if end is None else rows.where(F.col("id") <= end)


def encode(entries: DataFrame) -> DataFrame:
    """(queue, file_id, content): each segment of ``entries`` (queue, file_id, id, data) as a WAL file.

    A segment's size is bounded by its rotation, so a group is, too.
    """

    def of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        rows = [(int(i), bytes(d)) for i, d in zip(part["id"], part["data"])]
        header = WalHeader(entries_before=rows[0][0])
        for i, d in rows:
            header = header.resized(i, len(d))
        return pd.DataFrame({"queue": [key[0]], "file_id": [key[1]], "content": [encode_file(header, rows)]})

    return entries.select("queue", "file_id", "id", "data").groupBy("queue", "file_id").applyInPandas(of, "queue string, file_id long, content binary")
