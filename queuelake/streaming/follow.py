"""Continuous queries: replay then live, subscriptions, and release in order as a stateful stream."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from queuelake.functions.uintn import in_step
from queuelake.model import Absolute, ShiftFromTail
from queuelake.operators.reads import Position, last_id, of_queue, read_absolute

#: Gets the entries of one delivery, in id order; False ends the subscription.
Callback = Callable[[DataFrame], bool | None]


def entry_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000, schema: StructType | None = None) -> DataFrame:
    """The entries table as a stream; the limit of files a trigger is the back-pressure. A table without files needs its ``schema``."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow_start(entries: DataFrame, queue: str | None, position: Position) -> tuple[int, int | None]:
    """(first id to deliver, last id now). A follow from the very tail starts with what comes next."""
    last = last_id(entries, queue)
    if isinstance(position, Absolute):
        return position.id, last
    if last is None:
        return 0, None
    return (last + 1 if position.n == 0 else max(last - position.n, 0)), last


class Subscription:
    """A running delivery; ``stop`` is the unsubscription."""

    def __init__(self, query: StreamingQuery | None = None) -> None:
        self.query, self.ended = query, False

    @property
    def id(self) -> str | None:
        return str(self.query.id) if self.query else None

    def end(self) -> None:
        """No further delivery; from inside a batch the query is stopped by another thread."""
        self.ended = True
        if self.query is not None:
            threading.Thread(target=self.query.stop, daemon=True).start()

    def stop(self) -> None:
        self.ended = True
        if self.query is not None:
            self.query.stop()


def follow(spark: SparkSession, path: str, queue: str | None, position: Position, callback: Callback, step: int = 1, checkpoint: str | None = None, trigger: dict | None = None, entries: DataFrame | None = None, schema: StructType | None = None) -> Subscription:
    """Deliver what there is from ``position`` on, then what is appended; each entry once.

    What is appended comes to the table at ``path``. What there is are
    ``entries``, where they aren't in that table alone.

    The last id is read first. History up to it is one batch; the stream takes
    ids beyond it alone, so that no entry is delivered twice and none is lost
    between. After a failure the checkpoint goes on where it was.
    """
    entries = spark.read.parquet(path) if entries is None else entries
    start, last = follow_start(entries, queue, position)
    subscription = Subscription()
    if last is not None and start <= last:
        history = read_absolute(entries, start, 0, step, queue).where(F.col("id") <= last)
        if callback(history.orderBy("id")) is False:
            subscription.ended = True
            return subscription
    beyond = max(start, 0 if last is None else last + 1)
    live = of_queue(entry_stream(spark, path, schema=schema), queue).where(in_step(F.col("id"), start, step) & (F.col("id") >= beyond))

    def deliver(batch: DataFrame, _: int) -> None:
        if not subscription.ended and not batch.isEmpty() and callback(batch.orderBy("id")) is False:
            subscription.end()

    writer = live.writeStream.foreachBatch(deliver).trigger(**(trigger or {"processingTime": "50 milliseconds"}))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    subscription.query = writer.start()
    return subscription


def follow_tail(spark: SparkSession, path: str, queue: str | None, callback: Callback, **options) -> Subscription:
    """What is appended from now on."""
    return follow(spark, path, queue, ShiftFromTail(0), callback, **options)


def fan_out(stream: DataFrame, callbacks: dict[str, Callback], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """One micro-batch to many subscribers; who returns False gets no more."""
    left = dict(callbacks)

    def deliver(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for name, callback in list(left.items()):
            if callback(batch) is False:
                del left[name]
        batch.unpersist()

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def release_in_order(arrivals: DataFrame) -> DataFrame:
    """A stream of (queue, id, data) in any order, as a stream in id order without gaps, from id 0 of each queue.

    A queue's state is the next id and what waits for an earlier one. Copies of released ids are dropped.
    """
    state = "next long, ids array<long>, data array<binary>"

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, ids, data = state.get if state.exists else (0, [], [])
        waiting = dict(zip(ids, data))
        for batch in batches:
            for i, d in zip(batch["id"], batch["data"]):
                if i >= following:
                    waiting.setdefault(int(i), bytes(d))
            out = []
            while following in waiting:
                out.append((key[0], following, waiting.pop(following)))
                following += 1
            yield pd.DataFrame(out, columns=["queue", "id", "data"])
        rest = sorted(waiting)
        state.update((following, rest, [waiting[i] for i in rest]))

    return arrivals.select("queue", "id", "data").groupBy("queue").applyInPandasWithState(release, "queue string, id long, data binary", state, "append", GroupStateTimeout.NoTimeout)


def ack_watermark(batch_ids: DataFrame) -> DataFrame:
    """(queue, acked_id): once a batch is committed, its last id of each queue is durable."""
    return batch_ids.groupBy("queue").agg(F.max("id").alias("acked_id"))
