"""Schemas, positions and enumerations of the data model."""

from __future__ import annotations

from dataclasses import dataclass

ENTRY = "queue string, id long, data binary"
READ_RESULT = "queue string, id long, data binary, source string"
SEGMENT = "queue string, file_id long, tier string, entries_before long, num_entries long, first_id long, last_id long, bytes long, id_size int, data_size int, state string"

#: Where an entry was read from, in the order of their wire numbers.
SOURCES = ("NONE", "CLOUD", "DISK_STORE", "DISK_WAL", "MEMORY")
#: The order in which tiers answer for one entry: what is in memory first, the cloud last.
TIER_RANK = {"MEMORY": 0, "DISK_STORE": 1, "DISK_WAL": 2, "CLOUD": 3}
#: Fixed values of the file formats.
COMPRESSION = {"NONE": 0, "GZIP": 1, "XZ": 2, "ZSTD": 3}
ENCRYPTION = {"NONE": 0, "AES": 1}
WAL_FIXED_HEADER, ENTRY_OVERHEAD = 24, 16
DEFAULT_ID_SIZE, DEFAULT_DATA_SIZE = 4, 8
MAX_FILE_SIZE = 128 << 20
MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Absolute:
    """Start at entry ``id``."""

    id: int


@dataclass(frozen=True)
class ShiftFromTail:
    """Start ``n`` entries before the last one, but not before 0."""

    n: int


class QueueError(Exception):
    """Base of the engine's errors."""


class QueueNotFound(QueueError):
    pass


class QueueEmpty(QueueError):
    pass


class InvalidRequest(QueueError):
    pass


def width_of(value: int) -> int:
    """The bytes of the least width class that holds ``value``: 1, 2, 4, 8, 16, or as many as it takes."""
    size = max(1, (value.bit_length() + 7) // 8)
    return next((w for w in (1, 2, 4, 8, 16) if size <= w), size)
