"""Positional reads: absolute and tail-relative ranges with stride and limit.

A limit is a window of ids, not a count of rows: what retention or corruption
took isn't filled up from behind. So a bounded read is one filter, without a
sort or LIMIT node, and its range reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.functions.uintn import in_step
from queuelake.model import MAX_LONG, Absolute, InvalidRequest, QueueEmpty, QueueNotFound, ShiftFromTail

Position = Absolute | ShiftFromTail


def of_queue(entries: DataFrame, queue: str | None) -> DataFrame:
    return entries if queue is None else entries.where(F.col("queue") == queue)


def last_id(entries: DataFrame, queue: str | None = None) -> int | None:
    """The last id, or None for a queue without entries; only the id column is read."""
    return of_queue(entries, queue).agg(F.max("id")).first()[0]


def last_id_or_raise(entries: DataFrame, queue: str, known: bool) -> int:
    """The last id of a queue; an error tells an empty queue from an unknown one."""
    found = last_id(entries, queue)
    if found is None:
        raise (QueueEmpty if known else QueueNotFound)(queue)
    return found


def first_id(entries: DataFrame, queue: str | None = None) -> int | None:
    return of_queue(entries, queue).agg(F.min("id")).first()[0]


def window_end(start: int, limit: int, step: int) -> int:
    """The last id that ``limit`` steps from ``start`` can reach."""
    return min(MAX_LONG, start + (limit - 1) * max(1, step))


def id_range(entries: DataFrame, start: int, end: int | None = None, step: int = 1) -> DataFrame:
    """Entries from ``start`` to ``end`` (included; None: no end), every ``step``-th id."""
    found = entries.where(F.col("id") >= F.lit(start).cast("long"))
    if end is not None:
        found = found.where(F.col("id") <= F.lit(end).cast("long"))
    return found if step <= 1 else found.where(in_step(F.col("id"), start, step))


def read_absolute(entries: DataFrame, start: int, limit: int, step: int = 1, queue: str | None = None) -> DataFrame:
    """At most ``limit`` entries from ``start`` on; limit 0 means no end."""
    if start < 0 or limit < 0 or step < 0:
        raise InvalidRequest("positions, limits and steps are unsigned")
    step = max(1, step)
    if start > MAX_LONG:
        return of_queue(entries, queue).limit(0)
    return id_range(of_queue(entries, queue), start, window_end(start, limit, step) if limit else None, step)


def tail_start(entries: DataFrame, n: int, queue: str | None = None) -> int | None:
    """The id ``n`` before the last, 0 at least; None for an empty queue."""
    last = last_id(entries, queue)
    return None if last is None else max(last - n, 0)


def read_tail(entries: DataFrame, n: int, limit: int, step: int = 1, queue: str | None = None) -> DataFrame:
    """As ``read_absolute`` from ``n`` before the last entry, in forward order; an empty queue gives no rows.

    The start is found first, by a read of the id column's statistics, so that the read itself has literal bounds.
    """
    if n < 0:
        raise InvalidRequest("positions, limits and steps are unsigned")
    start = tail_start(entries, n, queue)
    return of_queue(entries, queue).limit(0) if start is None else read_absolute(entries, start, limit, step, queue)


def read_queue(entries: DataFrame, queue: str | None, position: Position, limit: int, step: int = 1) -> DataFrame:
    if isinstance(position, Absolute):
        return read_absolute(entries, position.id, limit, step, queue)
    return read_tail(entries, position.n, limit, step, queue)


def last_ids(entries: DataFrame) -> DataFrame:
    """(queue, last_id) of every queue."""
    return entries.groupBy("queue").agg(F.max("id").alias("last_id"))


def read_tails(entries: DataFrame, n: int, limit: int, step: int = 1, lasts: DataFrame | None = None) -> DataFrame:
    """The tail read of every queue at once. ``lasts`` may come from a segment index; a hot queue's rows may be split in the join."""
    lasts = (last_ids(entries) if lasts is None else lasts).select(F.col("queue").alias("__q"), F.greatest(F.col("last_id") - n, F.lit(0)).alias("__start"))
    joined = entries.join(lasts, F.col("queue") == F.col("__q"))
    found = joined.where(F.col("id") >= F.col("__start"))
    if limit:
        found = found.where(F.col("id") <= F.col("__start") + (limit - 1) * max(1, step))
    return found.where(in_step(F.col("id"), F.col("__start"), step)).select(*entries.columns)
