"""Queue names: resolution, paths and keys, and the first glob rule that matches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from queuelake.functions.uintn import file_path


def resolve(path: Column, instance_id: str) -> Column:
    """An absolute path stays; a relative one is put under the instance."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"/{instance_id}/"), path))


def resolve_name(path: str, instance_id: str) -> str:
    return path if path.startswith("/") else f"/{instance_id}/{path}"


def _relative(queue: Column) -> Column:
    return F.ltrim(queue, F.lit("/"))


def store_dir(base: str, queue: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), _relative(queue), F.lit("/store"))


def wal_dir(base: str, queue: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), _relative(queue), F.lit("/wal"))


def store_path(base: str, queue: Column, file_id: Column) -> Column:
    return file_path(store_dir(base, queue), file_id, "store")


def wal_path(base: str, queue: Column, file_id: Column) -> Column:
    return file_path(wal_dir(base, queue), file_id, "wal")


def cloud_queue_path(prefix: str, queue: Column) -> Column:
    return F.concat(F.lit(prefix), _relative(queue), F.lit("/"))


def cloud_key(prefix: str, queue: Column, file_id: Column) -> Column:
    return F.concat(cloud_queue_path(prefix, queue), file_path("", file_id, "store"))


def key_derivation_base(queue: Column) -> Column:
    return queue


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` also match a slash, ``**`` as a path part matches any number of parts."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            negated = inner[0] in "!^"
            out += "[" + "^" * negated + inner[negated:].replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def first_rule(queue: Column, patterns: Sequence[str]) -> Column:
    """The place of the first pattern that matches, from 0; null where none does.

    Rules are a setting, so they become one CASE expression: no join.
    """
    found = F.lit(None).cast("int")
    for i in range(len(patterns) - 1, -1, -1):
        found = F.when(queue.rlike("(?s)" + glob_regex(patterns[i])), F.lit(i)).otherwise(found)
    return found
