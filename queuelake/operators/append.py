"""Append: dense ids, release in order, rotation into segments, the memory tier's bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelake.model import DEFAULT_DATA_SIZE, DEFAULT_ID_SIZE, ENTRY_OVERHEAD, MAX_FILE_SIZE, WAL_FIXED_HEADER, width_of
from queuelake.plans.scratch import materialise


def assign_ids(batch: DataFrame, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """``batch`` (with queue) with ``id``: last + 1 onwards for each queue, in the order of ``order``; dense.

    Rows are range-partitioned by queue and order, so that a hot queue spans
    many tasks; a place within its partition and the counts of the partitions
    before it make a row's id. ``last`` has (queue, last_id) of queues that go on.
    """
    keys = ["queue", *order]
    placed = materialise(batch.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    counts = placed.groupBy("queue", "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    # Queues times the partitions each spans: small beside the rows.
    before = F.sum("__n").over(Window.partitionBy("queue").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__offset", F.coalesce(before, F.lit(0)))
    if last is None:
        offsets = offsets.withColumn("__base", F.lit(0).cast("long"))
    else:
        known = last.select(F.col("queue"), (F.col("last_id") + 1).alias("__base"))
        offsets = offsets.join(known, "queue", "left").withColumn("__base", F.coalesce("__base", F.lit(0).cast("long")))
    offsets = offsets.select("queue", "__part", (F.col("__base") + F.col("__offset") - F.col("__first")).alias("__shift"))
    return placed.join(offsets, ["queue", "__part"]).withColumn("id", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def ordered_release(arrivals: DataFrame, expected: int) -> DataFrame:
    """The arrivals that follow each other without a gap from ``expected`` on; earlier ones are late copies and never released.

    The first missing id is the least successor that hasn't arrived: an anti-join, not one long window.
    """
    ids = arrivals.where(F.col("id") >= expected)
    arrived = ids.select(F.col("id").alias("__arrived")).distinct()
    successors = ids.select((F.col("id") + 1).alias("__next")).unionByName(arrivals.sparkSession.range(1).select(F.lit(expected).cast("long").alias("__next")))
    missing = successors.join(arrived, F.col("__next") == F.col("__arrived"), "left_anti").agg(F.min("__next")).first()[0]
    return ids.where(F.col("id") < missing).dropDuplicates(["id"])


def entry_bytes(length, id_size: int = DEFAULT_ID_SIZE, data_size: int = DEFAULT_DATA_SIZE):
    """The bytes of an entry in a segment file: its header and its payload."""
    return (length + ENTRY_OVERHEAD + id_size + data_size).cast("long")


class _Fold:
    """Where the current segment of one queue stands."""

    def __init__(self, queue: str, file_id: int, max_size: int, id_size: int, data_size: int) -> None:
        self.queue, self.file_id, self.max_size, self.id_size, self.data_size = queue, file_id, max_size, id_size, data_size
        self.first = self.last = None
        self.n = self.size = self.before = 0

    def open(self, first: int) -> None:
        self.first = self.before = first
        self.n, self.size = 0, WAL_FIXED_HEADER + 8 + width_of(first)

    def row(self) -> tuple:
        return (self.queue, self.file_id, self.before, self.n, self.first, self.last, self.size, self.id_size, self.data_size)

    def take(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
        """Fold rows of one queue in id order; yields each segment that is complete."""
        at, n = 0, len(ids)
        while at < n:
            if self.first is None:
                self.open(int(ids[at]))
            overhead = ENTRY_OVERHEAD + self.id_size + self.data_size
            # A look ahead that doubles until it holds the end of the segment.
            span, stop = 256, None
            taken = self.size
            begin = at
            while stop is None and begin < n:
                part = slice(begin, min(n, begin + span))
                before = taken + np.concatenate([[0], np.cumsum(lengths[part] + overhead)])
                full = before[:-1] + lengths[part] > self.max_size
                wide = (ids[part] >> min(63, 8 * self.id_size) > 0) if self.id_size < 8 else np.zeros(len(full), bool)
                wide = wide | ((lengths[part] >> min(63, 8 * self.data_size) > 0) if self.data_size < 8 else False)
                if self.n == 0 and begin == at:
                    full[0] = False  # a segment that has no entry takes one of any length
                ends = np.flatnonzero(full | wide)
                if len(ends):
                    stop = begin + int(ends[0])
                    taken = int(before[ends[0]])
                else:
                    taken, begin, span = int(before[-1]), part.stop, span * 2
            stop = n if stop is None else stop
            if stop > at:
                self.n, self.last, self.size = self.n + stop - at, int(ids[stop - 1]), taken
            if stop < n:
                if self.n:
                    yield self.row()
                self.file_id += 1  # a file whose fields are too narrow for its first entry stays empty
                self.id_size = max(self.id_size, width_of(int(ids[stop])))
                self.data_size = max(self.data_size, width_of(int(lengths[stop])))
                self.open(int(ids[stop]))
            at = stop


SEGMENT_ROW = "queue string, file_id long, entries_before long, num_entries long, first_id long, last_id long, bytes long, id_size int, data_size int"


def rotate(lengths: DataFrame, max_size: int = MAX_FILE_SIZE, first_file: int = 1, id_size: int = DEFAULT_ID_SIZE, data_size: int = DEFAULT_DATA_SIZE) -> DataFrame:
    """The segments into which entries (queue, id, length) fall, each queue from ``first_file`` on.

    A new segment begins where the current one has an entry and its size with
    the next payload would pass ``max_size``, or where the next id or length
    needs more bytes than the segment's fields have. This is a fold in id
    order, so a queue is one task's work; it streams, holds a few batches and
    no payload, and looks for each segment's end by whole arrays.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, names = None, ["queue", "file_id", "entries_before", "num_entries", "first_id", "last_id", "bytes", "id_size", "data_size"]
        for batch in batches:
            out = []
            for queue, part in batch.groupby("queue", sort=False):
                if state is None or state.queue != queue:
                    if state is not None:
                        out.append(state.row())
                    state = _Fold(queue, first_file, max_size, id_size, data_size)
                out += state.take(part["id"].to_numpy(), part["length"].to_numpy())
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([state.row()], columns=names)

    rows = lengths.select("queue", F.col("id").cast("long").alias("id"), F.col("length").cast("long").alias("length"))
    return rows.repartition("queue").sortWithinPartitions("queue", "id").mapInPandas(fold, SEGMENT_ROW)


def memory_budget(total: int, queues_before: int) -> int:
    """What a queue may hold in memory when it starts."""
    return total // max(1, queues_before)


def memory_bounds(entries: DataFrame, acked: DataFrame, budget: int) -> DataFrame:
    """(queue, usage, evicted, first_id) of the memory tier: over budget, all that is acknowledged goes, else nothing.

    ``entries`` has queue, id, length; ``acked`` has queue, acked_id (durable up to there).
    """
    marks = acked.groupBy("queue").agg(F.max("acked_id").alias("__acked"))
    joined = entries.join(marks, "queue", "left")
    gone = F.coalesce(F.col("id") <= F.col("__acked"), F.lit(False))
    sums = joined.groupBy("queue").agg(
        F.sum("length").cast("long").alias("__all"), F.sum(F.when(gone, F.col("length")).otherwise(0)).cast("long").alias("__gone"), F.count(F.when(gone, 1)).alias("__n"), F.min("id").alias("__first"), F.min(F.when(~gone, F.col("id"))).alias("__rest")
    )
    over = F.col("__all") > budget
    return sums.select(
        "queue", F.when(over, F.col("__all") - F.col("__gone")).otherwise(F.col("__all")).alias("usage"), F.when(over, F.col("__n")).otherwise(0).cast("long").alias("evicted"), F.when(over, F.col("__rest")).otherwise(F.col("__first")).alias("first_id")
    )
