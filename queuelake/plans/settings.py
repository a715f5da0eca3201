"""Settings of an engine and of its queues."""

from __future__ import annotations

from dataclasses import dataclass, field

from queuelake.functions.naming import glob_regex
from queuelake.model import COMPRESSION, ENCRYPTION, MAX_FILE_SIZE


@dataclass(frozen=True)
class QueueConfig:
    compression: int = COMPRESSION["ZSTD"]
    encryption: int = ENCRYPTION["AES"]
    fsync: bool = True


@dataclass(frozen=True)
class QueueSettings:
    """Rules of (glob, config); the first that matches the absolute queue path holds, else the default."""

    rules: tuple[tuple[str, QueueConfig], ...] = ()
    default: QueueConfig = QueueConfig()

    def config_of(self, queue: str) -> QueueConfig:
        import re

        return next((config for glob, config in self.rules if re.match(f"(?s){glob_regex(glob)}", queue)), self.default)


@dataclass(frozen=True)
class CloudSettings:
    root: str
    prefix: str = ""


@dataclass(frozen=True)
class Settings:
    max_memory: int = 256 << 20
    max_file_size: int = MAX_FILE_SIZE
    max_disk_per_queue: int | None = None
    queues: QueueSettings = field(default_factory=QueueSettings)
    cloud: CloudSettings | None = None
