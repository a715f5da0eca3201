"""The engine's own queries, by name, and the SQL that states their results.

Each runs over whole tables: ``events`` as one queue (id = event_id) or as a
queue for each event type, ``conversations`` as many small queues, and
``documents`` and ``pages`` as large payloads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelake.functions import naming, uintn
from queuelake.functions.crypto import Identity
from queuelake.model import Absolute, ShiftFromTail
from queuelake.operators import append, reads, recovery, segments, tiers
from queuelake.plans.engine import Engine
from queuelake.plans.scratch import materialise, shared_dir
from queuelake.plans.settings import CloudSettings, Settings
from queuelake.sources import store, wal
from queuelake.sources.objects import ObjectStore
from queuelake.streaming import follow as streams

INSTANCE, PREFIX = "0a1b2c", "backup/"
SEGMENT_ROWS = 1000
SEED = bytes(range(32))

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a single queue."""
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", "user_id", "event_type", "props")


def _queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a queue for each type, with dense ids in the order of event_id."""
    events = _table(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("/inst/events/"), "event_type").alias("queue"), "event_id", "user_id", "value", F.octet_length("props").cast("long").alias("length"), "props")
    return append.assign_ids(rows, ["event_id"])


#: The same in SQL.
E = """e AS (SELECT '/inst/events/' || event_type AS queue, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS id,
        event_id, user_id, value, CAST(strlen(props) AS BIGINT) AS length, props FROM events)"""
#: Segments of SEGMENT_ROWS entries.
SEG = "s AS (SELECT *, id // 1000 + 1 AS file_id FROM e)"
INDEX = "i AS (SELECT queue, file_id, min(id) AS first_id, max(id) AS last_id, count(*) AS num_entries, min(id) AS entries_before, CAST(sum(length) AS BIGINT) AS bytes FROM s GROUP BY queue, file_id)"


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queues(spark, sf_dir).withColumn("file_id", F.expr(f"id div {SEGMENT_ROWS} + 1"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.build_index(_segmented(spark, sf_dir))


# Positional reads


@query("SELECT event_id AS id, value FROM events WHERE event_id BETWEEN 100 AND 100 + 5000 - 1")
def read_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_queue(_one_queue(spark, sf_dir), None, Absolute(100), 5000).select("id", "value")


@query("SELECT event_id AS id, value FROM events WHERE event_id BETWEEN 100 AND 100 + (50-1)*7 AND (event_id - 100) % 7 = 0")
def read_absolute_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_queue(_one_queue(spark, sf_dir), None, Absolute(100), 50, 7).select("id", "value")


@query("SELECT event_id AS id, value FROM events WHERE event_id >= 17 AND (event_id - 17) % 13 = 0")
def replay_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a follow replays: no upper end."""
    return reads.read_queue(_one_queue(spark, sf_dir), None, Absolute(17), 0, 13).select("id", "value")


@query("SELECT event_id AS id, value FROM events WHERE event_id BETWEEN 1000000000000 AND 1000000000099")
def read_past_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_queue(_one_queue(spark, sf_dir), None, Absolute(10**12), 100).select("id", "value")


_TAIL = "WITH p AS (SELECT greatest(max(event_id) - {n}, 0) AS st FROM events) SELECT event_id AS id, value FROM events CROSS JOIN p WHERE event_id BETWEEN st AND st + ({limit}-1)*{step} AND (event_id - st) % {step} = 0"


@query(_TAIL.format(n=25, limit=10, step=3))
def read_tail_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_queue(_one_queue(spark, sf_dir), None, ShiftFromTail(25), 10, 3).select("id", "value")


@query(_TAIL.format(n=999999999999, limit=700, step=1))
def read_tail_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_queue(_one_queue(spark, sf_dir), None, ShiftFromTail(999999999999), 700).select("id", "value")


_TAILS = f"WITH {E}, t AS (SELECT queue, greatest(max(id) - {{n}}, 0) AS st FROM e GROUP BY queue) SELECT queue, id, value FROM e JOIN t USING (queue) WHERE id BETWEEN st AND st + ({{limit}}-1)*{{step}} AND (id - st) % {{step}} = 0"


@query(_TAILS.format(n=0, limit=1, step=1))
def last_entry_per_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_tails(_queues(spark, sf_dir), 0, 1).select("queue", "id", "value")


@query(_TAILS.format(n=4, limit=5, step=1))
def tail_per_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_tails(_queues(spark, sf_dir), 4, 5).select("queue", "id", "value")


@query(_TAILS.format(n=500, limit=40, step=11))
def tail_per_queue_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_tails(_queues(spark, sf_dir), 500, 40, 11).select("queue", "id", "value")


@query(f"WITH {E} SELECT queue, min(id) AS first_id, max(id) AS last_id FROM e GROUP BY queue")
def queue_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _queues(spark, sf_dir)
    return entries.groupBy("queue").agg(F.min("id").alias("first_id")).join(reads.last_ids(entries), "queue")


# Append


@query(f"WITH {E} SELECT queue, id, event_id FROM e")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queues(spark, sf_dir).select("queue", "id", "event_id")


@query(f"WITH {E}, n AS (SELECT queue, count(*) AS n FROM e GROUP BY queue) SELECT queue, id + n AS id, event_id FROM e JOIN n USING (queue)")
def append_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events again, after themselves."""
    entries = _queues(spark, sf_dir)
    again = entries.select("queue", "event_id", "value")
    return append.assign_ids(again, ["event_id"], reads.last_ids(entries)).select("queue", "id", "event_id")


@query("""SELECT '/inst/conversations/' || conv_id AS queue, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS id, role, CAST(strlen(text) AS BIGINT) AS length FROM conversations""")
def conversation_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small queues."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("/inst/conversations/"), F.col("conv_id").cast("string")).alias("queue"), "turn", "role", F.octet_length("text").cast("long").alias("length"))
    return append.assign_ids(turns, ["turn"]).select("queue", "id", "role", "length")


@query("""WITH a AS (SELECT event_id AS id FROM events WHERE value < (SELECT max(value) FROM events)),
r AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM a) SELECT id FROM r WHERE g = -1""")
def ordered_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the greatest value are lost on the way; what comes before the first gap is released."""
    events = _one_queue(spark, sf_dir)
    top = events.agg(F.max("value")).first()[0]
    arrivals = events.where(F.col("value") < F.lit(top)).select("id")
    return append.ordered_release(arrivals, 0)


_ROTATE = """WITH RECURSIVE {source},
w AS (SELECT queue, id, length, sum(length + 28) OVER (PARTITION BY queue ORDER BY id) - length - 28 AS before, sum(length + 28) OVER (PARTITION BY queue ORDER BY id) AS after, count(*) OVER (PARTITION BY queue) AS n FROM e),
h AS (SELECT *, CASE WHEN id < 256 THEN 33 WHEN id < 65536 THEN 34 ELSE 36 END AS header FROM w),
seg(queue, file_id, start) AS (
  SELECT queue, CAST(1 AS BIGINT), CAST(min(id) AS BIGINT) FROM h GROUP BY queue
  UNION ALL
  SELECT seg.queue, seg.file_id + 1, min(h.id) FROM seg JOIN h a ON a.queue = seg.queue AND a.id = seg.start
    JOIN h ON h.queue = seg.queue AND h.id > seg.start AND a.header + h.before - a.before + h.length > {size} GROUP BY seg.queue, seg.file_id),
b AS (SELECT queue, file_id, start, coalesce(lead(start) OVER (PARTITION BY queue ORDER BY file_id) - 1, 9223372036854775807) AS stop FROM seg)
SELECT b.queue, b.file_id, min(h.id) AS first_id, max(h.id) AS last_id, count(*) AS num_entries, CAST(max(h.after) - min(h.before) + arg_min(h.header, h.id) AS BIGINT) AS bytes
FROM b JOIN h ON h.queue = b.queue AND h.id BETWEEN b.start AND b.stop GROUP BY b.queue, b.file_id"""
_ROTATED = ("queue", "file_id", "first_id", "last_id", "num_entries", "bytes")


@query(_ROTATE.format(source=E, size=2048))
def segment_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.rotate(_queues(spark, sf_dir), 2048).select(*_ROTATED)


@query(_ROTATE.format(source="e AS (SELECT '/inst/pages' AS queue, page_id AS id, CAST(strlen(html) AS BIGINT) AS length FROM pages)", size=65536))
def segment_rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large payloads."""
    pages = _table(spark, sf_dir, "pages").select(F.lit("/inst/pages").alias("queue"), F.col("page_id").alias("id"), F.octet_length("html").alias("length"))
    return append.rotate(pages, 65536).select(*_ROTATED)


@query(f"WITH {E} SELECT queue, id, length + 28 AS bytes FROM e")
def entry_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queues(spark, sf_dir).select("queue", "id", append.entry_bytes(F.col("length")).alias("bytes"))


@query(f"""WITH {E}, a AS (SELECT queue, max(id) // 2 AS acked_id FROM e GROUP BY queue),
j AS (SELECT e.queue, id, length, id <= acked_id AS gone FROM e JOIN a USING (queue)),
u AS (SELECT queue, sum(length) AS total, sum(CASE WHEN gone THEN length ELSE 0 END) AS freed, count(*) FILTER (WHERE gone) AS n, min(id) AS f, min(id) FILTER (WHERE NOT gone) AS r FROM j GROUP BY queue)
SELECT queue, CAST(CASE WHEN total > 20000 THEN total - freed ELSE total END AS BIGINT) AS usage, CAST(CASE WHEN total > 20000 THEN n ELSE 0 END AS BIGINT) AS evicted, CASE WHEN total > 20000 THEN r ELSE f END AS first_id FROM u""")
def memory_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _queues(spark, sf_dir)
    acked = entries.groupBy("queue").agg(F.expr("max(id) div 2").alias("acked_id"))
    return append.memory_bounds(entries.select("queue", "id", "length"), acked, 20000)


# Segments


@query(f"WITH {E}, {SEG}, {INDEX} SELECT * FROM i")
def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, min(file_id) AS min_file, max(file_id) AS max_file FROM i GROUP BY queue")
def file_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.file_bounds(_index(spark, sf_dir))


@query(f"""WITH {E}, {SEG}, {INDEX}, t AS (SELECT queue, event_id, user_id * 97 - 500 AS target FROM e),
f AS (SELECT queue, min(file_id) AS f0 FROM i GROUP BY queue)
SELECT t.queue, t.event_id, t.target, coalesce(a.file_id, f0) AS file_id FROM t ASOF LEFT JOIN i a ON t.queue = a.queue AND t.target >= a.first_id JOIN f ON f.queue = t.queue""")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets below, inside and beyond every queue's segments."""
    entries = materialise(_segmented(spark, sf_dir).select("queue", "file_id", "id", "event_id", "user_id", "length"))
    targets = entries.select("queue", "event_id", (F.col("user_id") * 97 - 500).alias("target"))
    return segments.lookup(targets, segments.build_index(entries))


@query(f"""WITH {E}, {SEG}, {INDEX}, p AS (SELECT file_id, first_id, last_id FROM i WHERE queue = '/inst/events/view')
SELECT s.file_id, s.id, s.value FROM s JOIN p USING (file_id) WHERE s.queue = '/inst/events/view' AND id BETWEEN 250 AND 250 + 199 * 5 AND (id - 250) % 5 = 0""")
def pruned_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = materialise(_segmented(spark, sf_dir).select("queue", "file_id", "id", "value", "length"))
    return segments.pruned_read(entries, segments.build_index(entries), "/inst/events/view", 250, 250 + 199 * 5, 5).select("file_id", "id", "value")


@query(f"""WITH {E}, {SEG}, x AS (SELECT *, sum(CASE WHEN props = '{{"k": 42}}' THEN 1 ELSE 0 END) OVER (PARTITION BY queue, file_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS bad FROM s)
SELECT queue, file_id, count(*) AS n, max(id) AS last_id FROM x WHERE bad = 0 GROUP BY queue, file_id""")
def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one payload count as damaged."""
    records = _segmented(spark, sf_dir).select("queue", "file_id", F.col("id").alias("ord"), (F.col("props") != '{"k": 42}').alias("ok"))
    return segments.valid_prefix(records).groupBy("queue", "file_id").agg(F.count("*").alias("n"), F.max("ord").alias("last_id"))


# Recovery and tiers


@query(f"""WITH {E}, {SEG}, x AS (SELECT *, sum(CASE WHEN props = '{{"k": 7}}' THEN 1 ELSE 0 END) OVER (PARTITION BY queue, file_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS bad FROM s),
v AS (SELECT queue, file_id, count(*) FILTER (WHERE bad = 0) AS n, max(id) FILTER (WHERE bad = 0) AS last_id FROM x GROUP BY queue, file_id),
g AS (SELECT queue, max(file_id) AS latest, max(file_id) FILTER (WHERE n > 0) AS v, max(last_id) AS last_id FROM v GROUP BY queue)
SELECT queue, CASE WHEN v IS NULL THEN 1 WHEN v = latest THEN latest + 1 ELSE latest END AS next_file, last_id, coalesce(last_id + 1, 0) AS next_id FROM g""")
def recover_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialise(_segmented(spark, sf_dir).select("queue", "file_id", F.col("id").alias("ord"), (F.col("props") != '{"k": 7}').alias("ok")))
    valid = segments.valid_prefix(records).groupBy("queue", "file_id").agg(F.count("*").alias("num_entries"), F.max("ord").alias("last_id"))
    index = records.select("queue", "file_id").distinct().join(valid, ["queue", "file_id"], "left").fillna(0, ["num_entries"]).withColumns({"id_size": F.lit(4), "data_size": F.lit(8)})
    return recovery.recover(index).select("queue", "next_file", "last_id", "next_id")


_TIERS = """l AS (SELECT *, max(id) OVER (PARTITION BY queue) AS last FROM e),
t AS (SELECT queue, id, 'CLOUD' AS source, 3 AS rnk FROM l WHERE id * 10 <= last * 3 UNION ALL SELECT queue, id, 'DISK_STORE', 1 FROM l WHERE id * 10 <= last * 6
  UNION ALL SELECT queue, id, 'DISK_WAL', 2 FROM l WHERE id * 10 >= last * 4 UNION ALL SELECT queue, id, 'MEMORY', 0 FROM l WHERE id * 10 >= last * 8)"""


@query(f"WITH {E}, {_TIERS} SELECT queue, id, source FROM (SELECT *, row_number() OVER (PARTITION BY queue, id ORDER BY rnk) AS rn FROM t) v WHERE rn = 1")
def tier_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiers: the cloud has the oldest 30 %, the store 60 %, the WAL the newest 60 %, memory the newest 20 %."""
    entries = _queues(spark, sf_dir)
    rows = entries.join(reads.last_ids(entries), "queue").select("queue", "id", "last_id")
    at, last = F.col("id") * 10, F.col("last_id")
    held = F.array_compact(F.array(F.when(at <= last * 3, F.lit("CLOUD")), F.when(at <= last * 6, F.lit("DISK_STORE")), F.when(at >= last * 4, F.lit("DISK_WAL")), F.when(at >= last * 8, F.lit("MEMORY"))))
    return tiers.cascade(rows.select("queue", "id", F.explode(held).alias("source")))


_RETAIN = f"""WITH {E}, {SEG}, {INDEX}, o AS (SELECT queue, max(file_id) - 1 AS latest_offloaded FROM i GROUP BY queue),
c AS (SELECT queue, file_id, bytes, sum(bytes) OVER (PARTITION BY queue ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS cum, sum(bytes) OVER (PARTITION BY queue) AS total,
  file_id - row_number() OVER (PARTITION BY queue ORDER BY file_id) AS grp, min(file_id) OVER (PARTITION BY queue) AS f0 FROM i WHERE bytes > 0)
SELECT queue, file_id, bytes FROM c JOIN o USING (queue) WHERE cum - bytes < total - 9000 AND grp = f0 - 1 AND file_id <= latest_offloaded"""


@query(_RETAIN)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    latest = index.groupBy("queue").agg((F.max("file_id") - 1).alias("latest_offloaded"))
    return tiers.retention_plan(index.select("queue", "file_id", "bytes"), 9000, latest)


def _remote(index: DataFrame) -> DataFrame:
    """The remote side has the files smaller than the average; the others are cropped there."""
    mean = index.agg(F.avg("size")).first()[0]
    size = F.col("size")
    return index.select("queue", "file_id", F.when(size < F.lit(mean), size).otherwise(size - 1).alias("size"))


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, bytes AS size FROM i WHERE bytes >= (SELECT avg(bytes) FROM i)")
def offload_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(_index(spark, sf_dir).select("queue", "file_id", F.col("bytes").alias("size")))
    remote = _remote(index)
    return tiers.offload_pending(index, remote)


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, bytes AS size FROM i WHERE bytes < (SELECT avg(bytes) FROM i)")
def offloaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(_index(spark, sf_dir).select("queue", "file_id", F.col("bytes").alias("size")))
    remote = _remote(index)
    return tiers.offloaded(index, remote)


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, max(file_id) AS latest_offloaded FROM i GROUP BY queue")
def latest_offloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.latest_offloaded(_index(spark, sf_dir))


@query(f"WITH {E} SELECT queue, CAST(sum(length + 28) AS BIGINT) AS bytes FROM e GROUP BY queue")
def queue_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _segmented(spark, sf_dir).groupBy("queue", "file_id").agg(F.sum(append.entry_bytes(F.col("length"))).alias("bytes"))
    return tiers.queue_sizes(files)


# Scalar functions

_PATH = "rtrim(regexp_replace(lpad(h, CAST(ceil(length(h) / 3.0) * 3 AS INT), '0'), '(...)', '\\1/', 'g'), '/')"
_HEX = "x AS (SELECT event_id, CASE WHEN {n} = 0 THEN '0' ELSE lower(ltrim(to_hex({n}), '0')) END AS h FROM events)"


@query(f"WITH {_HEX.format(n='event_id * 7919')} SELECT event_id, 'wal/' || {_PATH} || '.wal' AS path, event_id * 7919 AS back FROM x")
def file_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to paths and back."""
    rows = _table(spark, sf_dir, "events").select("event_id", uintn.file_path("wal", F.col("event_id") * 7919, "wal").alias("path"))
    return rows.withColumn("back", uintn.path_to_id(F.substring("path", 5, 1000)))


@query(f"""WITH {_HEX.format(n='event_id')}, y AS (SELECT x.*, '/inst/events/' || event_type AS queue FROM x JOIN events USING (event_id))
SELECT event_id, 'backup/' || ltrim(queue, '/') || '/' || {_PATH} || '.store' AS cloud_key, '/data/' || ltrim(queue, '/') || '/store/' || {_PATH} || '.store' AS store_path, '/data/' || ltrim(queue, '/') || '/wal/' || {_PATH} || '.wal' AS wal_path FROM y""")
def queue_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    queue, n = F.concat(F.lit("/inst/events/"), "event_type"), F.col("event_id")
    return events.select("event_id", naming.cloud_key(PREFIX, queue, n).alias("cloud_key"), naming.store_path("/data", queue, n).alias("store_path"), naming.wal_path("/data", queue, n).alias("wal_path"))


@query("""WITH x AS (SELECT event_id, event_id * 5000011 AS a, user_id * 97 AS b FROM events)
SELECT event_id, CASE WHEN a < 256 THEN 1 WHEN a < 65536 THEN 2 WHEN a < 4294967296 THEN 4 ELSE 8 END AS width, (a + b) // 2 AS middle, a + b AS total, greatest(a, b) - least(a, b) AS gap, a % (b + 1) AS rest,
a + 1 AS more, CASE WHEN a <= 1000 THEN 0.0::DOUBLE WHEN a >= 9000000000 THEN 1.0::DOUBLE ELSE (a - 1000)::DOUBLE / (9000000000 - 1000)::DOUBLE END AS progress, a >= 1000 AND (a - 1000) % 3 = 0 AS in_step,
CASE WHEN a < 256 THEN CASE WHEN a = 0 THEN '0' ELSE lower(ltrim(to_hex(a), '0')) END ELSE CAST(a AS VARCHAR) END AS shown FROM x""")
def uintn_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("event_id") * 5000011, F.col("user_id") * 97
    return _table(spark, sf_dir, "events").select(
        "event_id", uintn.width(a).alias("width"), uintn.middle(a, b).alias("middle"), uintn.add(a, b).alias("total"), uintn.sub(F.greatest(a, b), F.least(a, b)).alias("gap"), uintn.rem(a, b + 1).alias("rest"), uintn.increment(a).alias("more"),
        uintn.progress(a, F.lit(1000), F.lit(9000000000)).alias("progress"), uintn.in_step(a, 1000, 3).alias("in_step"), uintn.display_client(a).alias("shown"),
    )


@query("""WITH x AS (SELECT event_id, CAST(event_id AS HUGEINT) * 10000000000000000000000000 AS a, CAST(user_id AS HUGEINT) * 1000000000000 AS b FROM events)
SELECT event_id, CAST(a + b AS VARCHAR) AS total, CAST((a + b) // 2 AS VARCHAR) AS middle, CAST(greatest(a, b) - least(a, b) AS VARCHAR) AS gap, CAST(a % (b + 7) AS VARCHAR) AS rest,
CASE WHEN a < 256 THEN 1 WHEN a < 65536 THEN 2 WHEN a < 4294967296 THEN 4 WHEN a < 18446744073709551616 THEN 8 ELSE 16 END AS width, CAST(a AS VARCHAR) AS back FROM x""")
def uintn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers beyond 64 bits, and their way through the little-endian codec."""
    zero = lambda c, n: F.when(c == 0, F.lit("0")).otherwise(F.concat(c.cast("string"), F.lit("0" * n)))
    rows = _table(spark, sf_dir, "events").select("event_id", zero(F.col("event_id"), 25).alias("a"), zero(F.col("user_id"), 12).alias("b"))
    high = F.when(F.col("event_id") > 0, F.col("a")).otherwise(F.col("b"))
    low = F.when(F.col("event_id") > 0, F.col("b")).otherwise(F.col("a"))
    return rows.select(
        "event_id", uintn.add_big("a", "b").alias("total"), uintn.middle_big("a", "b").alias("middle"), uintn.sub_big(high, low).alias("gap"), uintn.rem_big("a", uintn.add_big("b", F.lit("7"))).alias("rest"),
        uintn.width_big("a").alias("width"), uintn.from_prefixed(uintn.to_prefixed("a")).alias("back"),
    )


@query(f"""WITH x AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '/shared/' ELSE 'own/' END || event_type || '/' || user_id AS path FROM events),
y AS (SELECT event_id, CASE WHEN starts_with(path, '/') THEN path ELSE '/{INSTANCE}/' || path END AS queue FROM x)
SELECT event_id, queue, CASE WHEN queue LIKE '/shared/error/%' THEN 0 WHEN regexp_full_match(queue, '/.*/(click|view)/[0-9]') THEN 1 WHEN queue LIKE '%/_' THEN 2 WHEN queue LIKE '/{INSTANCE}/%' THEN 3 END AS rule FROM y""")
def config_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative and absolute names, and the first glob rule that matches."""
    path = F.concat(F.when(F.col("user_id") % 2 == 0, F.lit("/shared/")).otherwise(F.lit("own/")), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    rows = _table(spark, sf_dir, "events").select("event_id", naming.resolve(path, INSTANCE).alias("queue"))
    return rows.withColumn("rule", naming.first_rule(F.col("queue"), ["/shared/error/*", "/*/{click,view}/[0-9]", "*/?", f"/{INSTANCE}/**"]))


@query("""SELECT event_type, count(*) AS n, avg(value) AS mean, list_sort(list(value))[CAST(floor(count(*)*50/100) AS INT)+1] AS p50, list_sort(list(value))[CAST(floor(count(*)*95/100) AS INT)+1] AS p95,
list_sort(list(value))[CAST(floor(count(*)*99/100) AS INT)+1] AS p99 FROM events GROUP BY event_type""")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ranks from counts of distinct values: a running count over (type, value), not one list of all values."""
    events = _table(spark, sf_dir, "events")
    counts = events.where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("k"))
    totals = events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    running = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("event_type").orderBy("value")))
    joined = running.join(totals, "event_type")
    at = lambda p: F.min(F.when(F.col("upto") > F.expr(f"n * {p} div 100"), F.col("value"))).alias(f"p{p}")
    return joined.groupBy("event_type", "n", "mean").agg(at(50), at(95), at(99))


# File formats


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entries of a queue for each language, in segments of bounded size."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/inst/docs/"), "lang").alias("queue"), "doc_id", F.col("text").cast("binary").alias("data"))
    rows = append.assign_ids(docs.withColumn("length", F.octet_length("data").cast("long")), ["doc_id"])
    index = materialise(append.rotate(rows, 1 << 20))
    return segments.lookup(rows.withColumn("target", F.col("id")), index).select("queue", "file_id", "id", "data")


_DOCS = "SELECT '/inst/docs/' || lang AS queue, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS id, md5(text) AS digest FROM documents"


@query(_DOCS)
def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to WAL files and back."""
    files = materialise(wal.encode(_payloads(spark, sf_dir)))
    return wal.decode(files).select("queue", "id", F.md5("data").alias("digest"))


@query(_DOCS)
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAL files to signed, compressed, encrypted store files, verified and back."""
    identity = Identity(SEED)
    files = materialise(store.encode(wal.encode(_payloads(spark, sf_dir)), identity))
    return wal.decode(store.extract(files, identity)).select("queue", "id", F.md5("data").alias("digest"))


_CROPPED = f"""WITH {E}, {SEG}, {INDEX}, c AS (SELECT *, CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END AS cut FROM i)"""


def _wal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as WAL files of SEGMENT_ROWS entries; of every second file the last byte is lost, and so its last entry."""
    files = wal.encode(_segmented(spark, sf_dir).withColumn("data", F.col("props").cast("binary")))
    cropped = F.expr("substring(content, 1, length(content) - 1)")
    return materialise(files.withColumn("content", F.when(F.col("file_id") % 2 == 0, cropped).otherwise(F.col("content"))))


@query(f"""{_CROPPED} SELECT queue, file_id, entries_before, num_entries - cut AS num_entries, CASE WHEN num_entries > cut THEN first_id END AS first_id, CASE WHEN num_entries > cut THEN last_id - cut END AS last_id,
CASE WHEN num_entries > cut THEN 'VALID' ELSE 'HEADER_ONLY' END AS state FROM c""")
def wal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that is read from WAL files, some of them cropped."""
    return wal.index(_wal_files(spark, sf_dir)).select("queue", "file_id", "entries_before", "num_entries", "first_id", "last_id", "state")


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, entries_before, 4 AS id_size, 8 AS data_size FROM i")
def wal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.headers(_wal_files(spark, sf_dir)).select("queue", "file_id", "entries_before", "id_size", "data_size")


@query(f"{_CROPPED} SELECT s.queue, s.id, md5(s.props) AS digest FROM s JOIN c USING (queue, file_id) WHERE s.id BETWEEN 40 AND 1900 AND (s.id - 40) % 7 = 0 AND s.id <= c.last_id - c.cut")
def wal_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id range and step over WAL files, valid prefixes alone."""
    return wal.read_range(_wal_files(spark, sf_dir), 40, 1900, 7).select("queue", "id", F.md5("data").alias("digest"))


@query(f"""WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, CASE WHEN file_id <= 2 THEN 0 ELSE first_id END AS first_id, last_id, CASE WHEN file_id >= 2 THEN entries_before ELSE entries_before + 5 END AS entries_before, num_entries FROM i""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and headers of the same files in two tiers: the store has files 1 and 2 with other marks, the WAL those from 2 on."""
    index = _index(spark, sf_dir)
    stored = index.where("file_id <= 2").withColumns({"tier": F.lit("STORE"), "entries_before": F.col("entries_before") + 5, "first_id": F.lit(0).cast("long")})
    found = segments.merged_index(index.where("file_id >= 2").withColumn("tier", F.lit("WAL")).unionByName(stored))
    return found.select("queue", "file_id", "first_id", "last_id", "entries_before", "num_entries")


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, max(file_id) AS file_id FROM i WHERE file_id % 2 = 1 AND file_id <= 6 GROUP BY queue")
def last_valid_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last file up to the sixth that has entries; every second file has none."""
    index = _index(spark, sf_dir)
    return segments.last_valid_file(index.withColumn("num_entries", F.when(F.col("file_id") % 2 == 0, 0).otherwise(F.col("num_entries"))), 6)


@query("WITH a AS (SELECT event_id AS id FROM events WHERE event_id <> 700) SELECT id, CAST(1 AS BIGINT) AS times FROM a WHERE id BETWEEN 20 AND 699")
def late_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release from id 20 of arrivals that come twice, earlier ones too, with one that never comes."""
    ids = _one_queue(spark, sf_dir).select("id").where("id <> 700")
    return append.ordered_release(ids.unionByName(ids), 20).groupBy("id").agg(F.count("*").alias("times"))


@query("SELECT queue, max(id) AS acked_id FROM (SELECT '/inst/events/' || event_type AS queue, event_id AS id FROM events) GROUP BY queue")
def acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a committed batch makes durable of each queue."""
    events = _table(spark, sf_dir, "events")
    return streams.ack_watermark(events.select(F.concat(F.lit("/inst/events/"), "event_type").alias("queue"), F.col("event_id").alias("id")))


@query("""WITH x AS (SELECT event_id, event_id * 5000011 AS a FROM events)
SELECT event_id, greatest(a, 1) - 1 AS less, a = 0 AS is_zero, a < 4294967296 AS fits, a + 7 AS stepped, CASE WHEN event_id % 3 = 0 THEN NULL ELSE a END AS parsed, a % 4294967296 AS checked, CAST(a AS VARCHAR) AS shown, event_id IN (1, 2, 4, 8, 16) AS valid FROM x""")
def uintn_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("event_id") * 5000011
    text = F.when(F.col("event_id") % 3 == 0, F.concat(a.cast("string"), F.lit("x"))).otherwise(a.cast("string"))
    return _table(spark, sf_dir, "events").select(
        "event_id", uintn.decrement(F.greatest(a, F.lit(1))).alias("less"), uintn.is_zero(a).alias("is_zero"), uintn.can_fit(a, 4).alias("fits"), uintn.step_by(a, 7).alias("stepped"), uintn.parse_decimal(text).alias("parsed"),
        uintn.checked(a % 4294967296, 4).alias("checked"), uintn.display(a).alias("shown"), uintn.is_valid_size(F.col("event_id")).alias("valid"),
    )


@query("SELECT event_id AS id, CASE WHEN event_id < 600 THEN 'DISK_WAL' ELSE 'MEMORY' END AS source FROM events")
def memory_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory has the ids from 600 on, and the disk all: what both have comes from memory."""
    ids = _one_queue(spark, sf_dir).select("id")
    memory = ids.where("id >= 600")
    return tiers.memory_first(ids.withColumn("source", F.lit("DISK_WAL")), memory.withColumn("source", F.lit("MEMORY")), reads.first_id(memory))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of files in two tiers: the store has those up to the second, the WAL those from the second on."""
    index = _index(spark, sf_dir).select("queue", "file_id", "bytes")
    return index.where("file_id <= 2").withColumn("tier", F.lit("STORE")).unionByName(index.where("file_id >= 2").withColumn("tier", F.lit("WAL")))


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, CASE WHEN file_id <= 2 THEN 'DISK_STORE' ELSE 'DISK_WAL' END AS source FROM i")
def file_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier that answers for each file."""
    return tiers.cascade_files(_copies(spark, sf_dir).withColumn("source", F.concat(F.lit("DISK_"), "tier")))


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, CASE WHEN file_id <= 2 THEN 'STORE' ELSE 'WAL' END AS tier, bytes FROM i")
def retained_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local copy of each file that retention would delete."""
    return tiers.deletable_copies(_copies(spark, sf_dir)).select("queue", "file_id", "tier", "bytes")


@query(f"WITH {E}, {SEG}, {INDEX} SELECT queue, file_id, num_entries FROM i WHERE file_id < 3")
def closed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compaction may take while the third file is being written."""
    return wal.closed_files(_index(spark, sf_dir), 3).select("queue", "file_id", "num_entries")


@query(f"{_CROPPED} SELECT s.queue, s.file_id, s.id, md5(s.props) AS digest FROM s JOIN c USING (queue, file_id) WHERE s.id <= c.last_id - c.cut")
def wal_files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that executors wrote, found by their paths and read back as far as they are valid."""
    objects = ObjectStore(spark, _scratch(spark))
    key = F.expr("substring(path, 2)")
    named = _wal_files(spark, sf_dir).withColumn("path", naming.wal_path("", F.col("queue"), F.col("file_id")))
    objects.write_files(named.select(key.alias("key"), "content")).write.format("noop").mode("overwrite").save()
    return wal.decode(wal.read_files(spark, objects.root)).select("queue", "file_id", "id", F.md5("data").alias("digest"))


@query("""WITH x AS (SELECT event_id, CAST(event_id AS HUGEINT) * 1000000007 * (user_id + 1) AS a FROM events)
SELECT event_id, printf('%04x', length(to_hex(a))) || lower(to_hex(a)) AS key, CAST(a AS VARCHAR) AS back FROM x""")
def uintn_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that sort as wide numbers do, and hex digits back to numbers."""
    a = (F.col("event_id").cast("decimal(38,0)") * 1000000007 * (F.col("user_id") + 1)).cast("decimal(38,0)").cast("string")
    rows = _table(spark, sf_dir, "events").select("event_id", uintn.key_big(a).alias("key"))
    return rows.select("event_id", "key", uintn.from_hex_big(F.expr("substring(key, 5)")).alias("back"))


# Streams


@query("SELECT '/inst/events' AS queue, event_id AS id, md5(props) AS digest FROM events")
def stream_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream through the stateful release in order."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    arrivals = stream.select(F.lit("/inst/events").alias("queue"), F.col("event_id").alias("id"), F.col("props").cast("binary").alias("data"))
    return _drained(spark, streams.release_in_order(arrivals)).select("queue", "id", F.md5("data").alias("digest"))


@query("SELECT event_id AS id, value FROM events WHERE event_id >= 40 AND (event_id - 40) % 9 = 0")
def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follow with a step, as a stream."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("event_id").alias("id"), "value")
    return _drained(spark, rows.where(uintn.in_step(F.col("id"), 40, 9)))


@query("SELECT event_id AS id, md5(props) AS digest FROM events WHERE event_id >= 40 AND (event_id - 40) % 9 = 0")
def engine_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follow by the engine over a queue whose entries are in the cloud, the store and the WAL, and that grows while it is followed."""
    base = _scratch(spark)
    engine = Engine(spark, f"{base}/data", Settings(max_file_size=1 << 16, cloud=CloudSettings(f"{base}/cloud")), seed=SEED)
    events = _table(spark, sf_dir, "events").select(F.lit("/inst/events").alias("queue"), "event_id", F.col("props").cast("binary").alias("data"))
    engine.append(events.where("event_id < 300"), ["event_id"])
    engine.compact("/inst/events")
    engine.offload()
    engine.append(events.where("event_id BETWEEN 300 AND 599"), ["event_id"])

    def deliver(batch: DataFrame) -> None:
        batch.select("id", F.md5("data").alias("digest")).write.mode("append").parquet(f"{base}/delivered")

    following = engine.follow("/inst/events", deliver, Absolute(40), 9, checkpoint=f"{base}/state")
    engine.append(events.where("event_id >= 600"), ["event_id"])
    following.query.processAllAvailable()
    engine.close()
    return spark.read.schema("id long, digest string").parquet(f"{base}/delivered")


def _scratch(spark: SparkSession) -> str:
    """A folder of the shared one that goes when the application ends."""
    base = f"{shared_dir(spark)}/queuelake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return base


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run ``stream`` over what there is into a table in the shared folder."""
    base = _scratch(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
