"""The engine: queues as a Parquet table of entries, with tiers, behind a small API.

Entries live in tables partitioned by queue and file_id: ``wal`` takes
appends, ``store`` what is compacted, the cloud root what is offloaded. All
reads are plans over these tables; the driver keeps each queue's last id, open
segment and the part of it in memory that single writes have put there.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelake.functions.crypto import SEED_FILE, SEED_SIZE, Identity
from queuelake.functions.naming import resolve_name
from queuelake.functions.uintn import width
from queuelake.model import DEFAULT_DATA_SIZE, DEFAULT_ID_SIZE, Absolute, InvalidRequest, QueueEmpty, QueueError, QueueNotFound, ShiftFromTail
from queuelake.operators import append, recovery, segments, tiers
from queuelake.operators.reads import Position, read_queue
from queuelake.plans.scratch import materialise
from queuelake.plans.settings import Settings
from queuelake.sources.objects import ObjectStore
from queuelake.streaming.follow import Callback, Subscription, follow

ROWS = T.StructType([T.StructField("queue", T.StringType()), T.StructField("file_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("length", T.LongType())])
#: Partition columns last, where Spark puts them once a table that was empty has files.
STREAM = T.StructType([ROWS[c] for c in ("id", "data", "length", "queue", "file_id")])
READ = "queue string, id long, data binary, source string"


@dataclass
class WriteResult:
    ids: list[int]
    status: str = "DONE"


@dataclass
class _Queue:
    """What the driver knows of an open queue."""

    fold: append._Fold
    next_id: int
    budget: int
    memory: list[tuple[int, bytes]] = field(default_factory=list)
    acked: int = -1
    lock: threading.Lock = field(default_factory=threading.Lock)


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, seed: bytes | None = None, read_only: bool = False) -> None:
        self.spark, self.root, self.settings, self.read_only = spark, root.rstrip("/"), settings or Settings(), read_only
        self.identity = Identity(seed or self._seed())
        self._queues: dict[str, _Queue] = {}
        self._lock = threading.Lock()
        self._subscriptions: list[Subscription] = []
        if self.settings.max_disk_per_queue is not None:
            tiers.check_max_size(self.settings.max_disk_per_queue, self.settings.max_file_size)

    # Identity and clock

    def _seed(self) -> bytes:
        """The seed kept under the root, on whatever file system that is; the first to come makes it, readable by its owner alone."""
        store = ObjectStore(self.spark, self.root)
        found = store.get(SEED_FILE)
        if found is None:
            store.create(SEED_FILE, os.urandom(SEED_SIZE), private=True)
            found = store.get(SEED_FILE)
        return found

    @property
    def instance_id(self) -> str:
        return self.identity.instance_id

    @property
    def instance_id_bytes(self) -> bytes:
        return self.identity.instance_id_bytes

    def setup(self, version: int = 0) -> tuple[int, str]:
        return version, self.instance_id

    def ping(self, sequence: int = 0) -> tuple[int, int, int]:
        """The sequence, wall-clock and monotonic nanoseconds."""
        return sequence, time.time_ns(), time.monotonic_ns()

    def resolve(self, queue: str) -> str:
        return resolve_name(queue, self.instance_id)

    # Tables

    def path(self, tier: str) -> str:
        return f"{self.settings.cloud.root.rstrip('/')}/{self.settings.cloud.prefix}entries" if tier == "cloud" else f"{self.root}/{tier}"

    def _path_object(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, tier: str) -> DataFrame:
        """Queue names are stored escaped, as partition folders; the columns come back typed."""
        path = self.path(tier)
        target, fs = self._path_object(path)
        if not fs.exists(target):
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(path)

    def _writable(self) -> None:
        if self.read_only:
            raise InvalidRequest("the engine was opened for reading")

    def _write(self, rows: DataFrame, tier: str) -> None:
        self._writable()
        rows.write.mode("append").partitionBy("queue", "file_id").option("compression", "zstd").parquet(self.path(tier))

    def _tiers(self) -> list[tuple[str, str]]:
        return [("store", "DISK_STORE"), ("wal", "DISK_WAL"), *([("cloud", "CLOUD")] if self.settings.cloud else [])]

    def index(self) -> DataFrame:
        """A row for each (queue, file_id, source): the id column and lengths are read, payloads aren't."""
        # The widths a file's header needs: those of its greatest id and length, the default ones at least.
        sizes = (F.greatest(F.lit(DEFAULT_ID_SIZE), width(F.max("id"))).cast("int").alias("id_size"), F.greatest(F.lit(DEFAULT_DATA_SIZE), width(F.max("length"))).cast("int").alias("data_size"))
        parts = [segments.build_index(self.table(t).drop("data"), *sizes).withColumn("source", F.lit(s)) for t, s in self._tiers()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def entries_of(self, queue: str) -> DataFrame:
        """A queue's entries once, from the first tier that has their file.

        Which files a tier answers for comes from the partition folders and is a literal list, so that copies in
        lower tiers aren't opened and no payload is shuffled. The list has a number for each segment of one queue.
        """
        out, seen = None, set()
        for tier, source in self._tiers():
            mine = self.table(tier).where(F.col("queue") == queue)
            files = {r[0] for r in mine.select("file_id").distinct().collect()}
            if files & seen:
                mine = mine.where(F.col("file_id").isin(sorted(files - seen)) if files - seen else F.lit(False))
            seen |= files
            part = mine.select("queue", "id", "data", F.lit(source).alias("source"))
            out = part if out is None else out.unionByName(part)
        return out

    def entries(self) -> DataFrame:
        """Every entry of every queue once, from the first tier that has its file, by a join with the segment index."""
        chosen = tiers.cascade_files(self.index()).select("queue", "file_id", F.col("source").alias("__s"))
        parts = [self.table(t).withColumn("source", F.lit(s)) for t, s in self._tiers()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.join(chosen, ["queue", "file_id"]).where("source = __s")
        return out.select("queue", "id", "data", "source")

    # Queues

    def exists(self, queue: str) -> bool:
        return queue in self._queues or any(not self.table(t).where(F.col("queue") == queue).isEmpty() for t, _ in self._tiers())

    def start_queue(self, queue: str) -> _Queue:
        """Open a queue where its files end."""
        with self._lock:
            if queue not in self._queues:
                found = recovery.recover(self.index().where(F.col("queue") == queue)).first()
                next_file, next_id, id_size, data_size = (found["next_file"], found["next_id"], found["id_size"], found["data_size"]) if found else (1, 0, DEFAULT_ID_SIZE, DEFAULT_DATA_SIZE)
                fold = append._Fold(queue, next_file, self.settings.max_file_size, id_size, data_size)
                self._queues[queue] = _Queue(fold, next_id, append.memory_budget(self.settings.max_memory, len(self._queues)))
            return self._queues[queue]

    def get_last_id(self, queue: str) -> int:
        """The last id; QueueEmpty or QueueNotFound tell why there is none."""
        queue = self.resolve(queue)
        if not self.exists(queue):
            raise QueueNotFound(queue)
        last = self.start_queue(queue).next_id - 1
        if last < 0:
            raise QueueEmpty(queue)
        return last

    # Writing

    def write(self, queue: str, packets: Iterable[bytes]) -> WriteResult:
        """Append packets under contiguous ids; none is a success without ids."""
        packets = list(packets)
        if not packets:
            return WriteResult([])
        try:
            return WriteResult(self.enqueue_batch(queue, packets))
        except QueueError:
            return WriteResult([], "SERVER_ERROR")

    def enqueue(self, queue: str, data: bytes) -> int:
        return self.enqueue_batch(queue, [data])[0]

    def enqueue_batch(self, queue: str, packets: list[bytes]) -> list[int]:
        import numpy as np

        if not packets:
            return []
        queue = self.resolve(queue)
        state = self.start_queue(queue)
        with state.lock:
            ids = list(range(state.next_id, state.next_id + len(packets)))
            files = []
            for i, p in zip(ids, packets):
                for _ in state.fold.take(np.array([i]), np.array([len(p)])):
                    pass
                files.append(state.fold.file_id)
            rows = [(queue, f, i, bytearray(p), len(p)) for f, i, p in zip(files, ids, packets)]
            self._write(self.spark.createDataFrame(rows, ROWS).coalesce(1), "wal")
            state.next_id += len(packets)
            state.memory += list(zip(ids, packets))
            state.acked = ids[-1]
            if sum(len(d) for _, d in state.memory) > state.budget:
                state.memory = [(i, d) for i, d in state.memory if i > state.acked]
        return ids

    def append(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """Append a data frame (queue, data, ...): ids in the order of ``order``, segments by rotation. Returns (queue, id).

        Queue names are absolute here. Ids and lengths are folded into segments; payloads are dealt to their segments by a range join.
        """
        rows = batch.withColumn("length", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long"))
        self._writable()
        known = materialise(recovery.recover(self.index()))
        last = known.where("last_id IS NOT NULL").select("queue", "last_id")
        numbered = materialise(append.assign_ids(rows, order, last))
        folded = append.rotate(numbered.select("queue", "id", "length"), self.settings.max_file_size)
        shifted = folded.join(known.select("queue", "next_file"), "queue", "left").withColumn("file_id", F.col("file_id") + F.coalesce("next_file", F.lit(1)) - 1).drop("next_file")
        placed = segments.lookup(numbered.withColumn("target", F.col("id")), materialise(shifted))
        self._write(placed.select("queue", "file_id", "id", "data", "length").repartition("queue", "file_id"), "wal")
        with self._lock:
            self._queues.clear()
        return numbered.select("queue", "id")

    def append_stream(self, stream: DataFrame, order: list[str], checkpoint: str, trigger: dict | None = None):
        """Append each micro-batch once, also after a failure; the stream is the only writer of its queues.

        A batch leaves two marks: before it is appended, how many ids had been
        given; after it, that it is there. An append is one commit. So a batch
        that has the first mark alone was appended if ids have been given since.
        """

        def given() -> int:
            return recovery.recover(self.index()).agg(F.coalesce(F.sum("next_id"), F.lit(0)).cast("long")).first()[0]

        def put(batch: DataFrame, number: int) -> None:
            marks = ObjectStore(self.spark, f"{checkpoint}/appended")
            if marks.head(f"{number}.done") is not None or batch.isEmpty():
                return
            begun = marks.get(f"{number}.begun")
            if begun is None:
                marks.put(f"{number}.begun", str(given()).encode())
            if begun is None or given() == int(begun):
                self.append(batch, order)
            marks.put(f"{number}.done", b"")

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # Reading

    def _all(self, queue: str) -> DataFrame:
        state = self._queues.get(queue)
        disk = self.entries_of(queue)
        if state is None or not state.memory:
            return disk
        memory = self.spark.createDataFrame([(queue, i, bytearray(d), "MEMORY") for i, d in state.memory], READ)
        return tiers.memory_first(disk, memory, state.memory[0][0])

    def read(self, queue: str, position: Position, limit: int, step: int = 1) -> DataFrame:
        """A bounded read (queue, id, data, source) in id order; an unknown queue is opened and empty.

        The window's rows, no more than ``limit``, are sorted; plans that don't need an order use ``operators.reads``.
        """
        if limit <= 0:
            raise InvalidRequest("a read without limit is a follow")
        queue = self.resolve(queue)
        self.start_queue(queue)
        return read_queue(self._all(queue), None, position, limit, step).orderBy("id")

    def read_from_offset(self, queue: str, offset: int, limit: int, step: int = 1) -> DataFrame:
        return self.read(queue, Absolute(offset), limit, step)

    def read_from_tail(self, queue: str, offset: int, limit: int, step: int = 1) -> DataFrame:
        return self.read(queue, ShiftFromTail(offset), limit, step)

    def follow(self, queue: str, callback: Callback, position: Position = ShiftFromTail(0), step: int = 1, **options) -> Subscription:
        """Replay from ``position``, then deliver what is appended, until ``callback`` returns False.

        History and the last id come from all tiers and memory; what is appended comes through the WAL.
        """
        queue = self.resolve(queue)
        if not self.exists(queue):
            raise QueueNotFound(queue)
        target, fs = self._path_object(self.path("wal"))
        fs.mkdirs(target)
        subscription = follow(self.spark, self.path("wal"), queue, position, callback, step, entries=self._all(queue), schema=STREAM, **options)
        self._subscriptions.append(subscription)
        return subscription

    def subscribe(self, queue: str, callback: Callback, **options) -> Subscription:
        return self.follow(queue, callback, ShiftFromTail(0), **options)

    def unsubscribe(self, subscription: Subscription) -> None:
        subscription.stop()
        self._subscriptions.remove(subscription)

    # Upkeep

    def _remove(self, tier: str, queue: str, file_id: int) -> None:
        self._writable()
        target, fs = self._path_object(self.path(tier))
        name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(queue)
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, f"queue={name}/file_id={file_id}"), True)

    def compact(self, queue: str) -> list[int]:
        """Move a queue's closed WAL files to the store, each rewritten in id order; the open one stays."""
        self._writable()
        queue = self.resolve(queue)
        current = self._queues[queue].fold.file_id if queue in self._queues else None
        wal = self.table("wal").where(F.col("queue") == queue)
        files = [r[0] for r in wal.select("file_id").distinct().orderBy("file_id").collect() if r[0] != current]
        if files:
            kept = {r[0] for r in self.table("store").where(F.col("queue") == queue).select("file_id").distinct().collect()}
            new = [f for f in files if f not in kept]
            if new:
                self._write(wal.where(F.col("file_id").isin(new)).repartition("file_id").sortWithinPartitions("file_id", "id"), "store")
            for f in files:
                self._remove("wal", queue, f)
        return files

    def truncate(self, queue: str) -> None:
        """Drop a queue's WAL."""
        queue = self.resolve(queue)
        for r in self.table("wal").where(F.col("queue") == queue).select("file_id").distinct().collect():
            self._remove("wal", queue, r[0])
        self._queues.pop(queue, None)

    def _files(self, tier: str) -> DataFrame:
        return self.table(tier).groupBy("queue", "file_id").agg(F.sum("length").cast("long").alias("bytes"))

    def offload(self) -> int:
        """Copy store files without a remote copy of the same size to the cloud root; how many."""
        if not self.settings.cloud:
            raise InvalidRequest("no cloud is set")
        local, remote = (self._files(t).withColumnRenamed("bytes", "size") for t in ("store", "cloud"))
        pending = materialise(tiers.offload_pending(local, remote))
        n = pending.count()
        if n:
            rows = self.table("store").join(pending.select("queue", "file_id"), ["queue", "file_id"], "left_semi")
            self._write(rows.select("queue", "file_id", "id", "data", "length").repartition("queue", "file_id"), "cloud")
        return n

    def retain(self, max_size: int | None = None) -> list[tuple[str, int]]:
        """Delete the oldest local files of queues that are over their limit; what was deleted."""
        max_size = max_size if max_size is not None else self.settings.max_disk_per_queue
        if max_size is None:
            return []
        local = self._files("store").withColumn("tier", F.lit("STORE")).unionByName(self._files("wal").withColumn("tier", F.lit("WAL")))
        latest = tiers.latest_offloaded(self._files("cloud")) if self.settings.cloud else None
        plan = tiers.retention_plan(tiers.deletable_copies(local), max_size, latest)
        gone = [(r["queue"], r["file_id"], r["tier"]) for r in plan.orderBy("queue", "file_id").collect()]
        for queue, file_id, tier in gone:
            self._remove(tier.lower(), queue, file_id)
        return [(q, f) for q, f, _ in gone]

    def close(self) -> None:
        for subscription in self._subscriptions:
            subscription.stop()
        self._subscriptions.clear()
        self._queues.clear()
