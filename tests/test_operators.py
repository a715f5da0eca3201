"""Reads, append, segments, tiers and recovery on the conformance cases, and against plain Python folds."""

import random

import pytest
from pyspark.sql import functions as F

from queuelake.model import Absolute, InvalidRequest, QueueEmpty, QueueNotFound, ShiftFromTail, width_of
from queuelake.operators import append, reads, recovery, segments, tiers


def entries_of(spark, n):
    return spark.range(n).select(F.lit("q").alias("queue"), "id", F.concat(F.lit("entry-"), F.col("id").cast("string")).cast("binary").alias("data"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("n", "position", "limit", "step", "want"),
    [
        (10, Absolute(3), 4, 1, [3, 4, 5, 6]), (10, Absolute(1), 3, 3, [1, 4, 7]), (100, Absolute(0), 4, 20, [0, 20, 40, 60]), (10, Absolute(2), 4, 1, [2, 3, 4, 5]), (9, Absolute(0), 5, 2, [0, 2, 4, 6, 8]),
        (5, Absolute(0), 15, 1, [0, 1, 2, 3, 4]), (10, ShiftFromTail(2), 3, 1, [7, 8, 9]), (10, ShiftFromTail(5), 3, 2, [4, 6, 8]), (5, ShiftFromTail(100), 5, 1, [0, 1, 2, 3, 4]), (10, ShiftFromTail(0), 1, 1, [9]),
        (15, ShiftFromTail(7), 8, 1, list(range(7, 15))), (11, ShiftFromTail(1), 2, 1, [9, 10]), (100, Absolute(0), 1000, 1, list(range(100))), (0, ShiftFromTail(1024), 1024, 1, []), (0, Absolute(0), 1024, 1, []),
        (10, Absolute(50), 3, 1, []), (10, Absolute(2), 0, 3, [2, 5, 8]), (10, Absolute(0), 3, 0, [0, 1, 2]), (10, Absolute(2**70), 1, 1, []), (10, Absolute(1), 2**62, 2**62, [1]),
    ],
)
def test_reads(spark, n, position, limit, step, want):
    assert ids(reads.read_queue(entries_of(spark, n), "q", position, limit, step)) == want


def test_read_bounds_are_pushed_down(spark, tmp_path):
    entries_of(spark, 1000).write.parquet(str(tmp_path / "t"))
    plan = reads.read_absolute(spark.read.parquet(str(tmp_path / "t")), 100, 10, 3).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,100)" in plan and "LessThanOrEqual(id,127)" in plan and "data" not in plan.split("ReadSchema")[1] and "Sort" not in plan and "Exchange" not in plan


def test_lost_ids_are_not_filled_up(spark):
    assert ids(reads.read_absolute(entries_of(spark, 20).where("id NOT IN (5, 6)"), 4, 4)) == [4, 7]


def test_last_id_states(spark):
    assert reads.last_id_or_raise(entries_of(spark, 3), "q", True) == 2
    for known, error in ((True, QueueEmpty), (False, QueueNotFound)):
        with pytest.raises(error):
            reads.last_id_or_raise(entries_of(spark, 0), "q", known)
    with pytest.raises(InvalidRequest):
        reads.read_absolute(entries_of(spark, 1), -1, 1)
    assert reads.first_id(entries_of(spark, 3), "q") == 0 and reads.first_id(entries_of(spark, 3), "other") is None


def test_assign_ids_goes_on_per_queue(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", 100 - i) for i in range(90)], "queue string, seq long")
    last = spark.createDataFrame([("a", 9)], "queue string, last_id long")
    got = {"a": [], "b": []}
    for r in append.assign_ids(rows, ["seq"], last).collect():
        got[r["queue"]].append((r["id"], r["seq"]))
    for queue, base in (("a", 10), ("b", 0)):
        assert [i for i, _ in sorted(got[queue])] == list(range(base, base + len(got[queue]))) and [s for _, s in sorted(got[queue])] == sorted(s for _, s in got[queue])
    assert append.assign_ids(rows.limit(0), ["seq"]).count() == 0


@pytest.mark.parametrize(("arrivals", "expected", "want"), [([3, 2, 1], 1, [1, 2, 3]), ([1, 3, 5, 2], 1, [1, 2, 3]), ([1], 2, []), ([5, 6], 1, []), ([1, 1, 2, 2], 1, [1, 2]), ([], 0, []), ([0, 1, 4], 0, [0, 1])])
def test_ordered_release(spark, arrivals, expected, want):
    assert ids(append.ordered_release(spark.createDataFrame([(i,) for i in arrivals], "id long"), expected)) == want


def plain_fold(lengths, max_size, id_size, data_size):
    """One entry at a time."""
    out, file_id, size, before, written = [], 1, None, 0, []
    for i, n in lengths:
        if size is None:
            size, before = 24 + 8 + width_of(i), i
        narrow = width_of(i) > id_size or width_of(n) > data_size
        if (written and size + n > max_size) or narrow:
            if written:
                out.append((file_id, before, len(written), written[0], written[-1], size, id_size, data_size))
            file_id, id_size, data_size = file_id + 1, max(id_size, width_of(i)), max(data_size, width_of(n))
            size, before, written = 24 + 8 + width_of(i), i, []
        size += 16 + id_size + data_size + n
        written.append(i)
    if written:
        out.append((file_id, before, len(written), written[0], written[-1], size, id_size, data_size))
    return out


@pytest.mark.parametrize(("max_size", "id_size", "data_size", "longest"), [(2048, 4, 8, 200), (500, 1, 1, 300), (100, 4, 8, 400), (100000, 1, 1, 70000), (1, 4, 8, 3)])
def test_rotation_is_the_plain_fold(spark, max_size, id_size, data_size, longest):
    rng = random.Random(max_size)
    rows = {q: [(i, rng.choice((0, rng.randrange(longest), longest))) for i in range(rng.randrange(1, 900))] for q in ("a", "b", "c")}
    df = spark.createDataFrame([(q, i, n) for q, part in rows.items() for i, n in part], "queue string, id long, length long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(tuple(r) for r in append.rotate(df, max_size, 1, id_size, data_size).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((q, *s) for q, part in rows.items() for s in plain_fold(part, max_size, id_size, data_size))


def test_rotation_cases(spark):
    lens = lambda xs: spark.createDataFrame([("q", i, n) for i, n in enumerate(xs)], "queue string, id long, length long")
    by_size = append.rotate(lens([64, 64]), 128).orderBy("file_id").collect()
    assert [(r["file_id"], r["num_entries"], r["entries_before"]) for r in by_size] == [(1, 1, 0), (2, 1, 1)]
    by_width = append.rotate(lens([1, 300]), 10000, data_size=1).orderBy("file_id").collect()
    assert [(r["file_id"], r["num_entries"], r["entries_before"], r["data_size"]) for r in by_width] == [(1, 1, 0, 1), (2, 1, 1, 2)]
    assert append.rotate(lens([]), 128).count() == 0


def test_lookup_against_bisection(spark):
    rng = random.Random(7)
    index, targets = [], []
    for q in ("a", "b", "c"):
        at, file_id = rng.randrange(50), 1
        for _ in range(rng.choice((1, 5, 60))):
            n = rng.choice((0, 1, 3, 500))
            index.append((q, file_id, at, at + n - 1 if n else None, n))
            at, file_id = at + n, file_id + rng.choice((1, 1, 4))
        targets += [(q, rng.randrange(0, at + 100)) for _ in range(300)]
    df = spark.createDataFrame(index, "queue string, file_id long, first_id long, last_id long, num_entries long")
    for r in segments.lookup(spark.createDataFrame(targets, "queue string, target long"), df).collect():
        mine = [(st, f) for q, f, st, _, n in index if q == r["queue"] and n]
        assert r["file_id"] == (max([x for x in mine if x[0] <= r["target"]], default=min(mine))[1] if mine else None)
    assert segments.lookup(spark.createDataFrame(targets, "queue string, target long"), df).count() == sum(any(q == i[0] and i[4] for i in index) for q, _ in targets)


def test_pruning_by_range_and_step(spark):
    index = spark.createDataFrame([("q", f, f * 10, f * 10 + 9, 10) for f in range(10)], "queue string, file_id long, first_id long, last_id long, num_entries long")
    assert segments.files_of_range(index, "q", 15, 34) == [1, 2, 3]
    assert segments.files_of_range(index, "q", 5, None, 30) == [0, 3, 6, 9]
    assert segments.files_of_range(index, "none", 0) == []
    assert segments.last_valid_file(index.withColumn("num_entries", F.when(F.col("file_id") > 6, 0).otherwise(10)), 8).first()["file_id"] == 6


def test_merged_index_prefers_the_wal_header(spark):
    rows = [("q", 1, "WAL", 0, 4, 0, 5), ("q", 1, "STORE", 0, 3, 1, 4), ("q", 2, "STORE", 5, 9, 5, 5)]
    got = segments.merged_index(spark.createDataFrame(rows, "queue string, file_id long, tier string, first_id long, last_id long, entries_before long, num_entries long")).orderBy("file_id").collect()
    assert [tuple(r) for r in got] == [("q", 1, 0, 4, 0, 5), ("q", 2, 5, 9, 5, 5)]


EMPTY, BAD = (None, 0), (None, 0)


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ({1: 9, 2: None}, (2, 9, 10)), ({1: 4, 2: None, 3: None, 4: None}, (4, 4, 5)), ({1: None, 2: None}, (1, None, 0)), ({1: 4, 1_000_000: None}, (1_000_000, 4, 5)), ({1: 9, 2: 19, 5: None}, (5, 19, 20)),
        ({1: 2, 2: None, 3: None}, (3, 2, 3)), ({1: 9, 3: None}, (3, 9, 10)), ({1: 4, 5: None}, (5, 4, 5)), ({1: 9}, (2, 9, 10)), ({3: 30, 7: 70}, (8, 70, 71)),
    ],
)
def test_recovery(spark, files, want):
    rows = [("q", f, 0 if last is None else 1, last, 4, 8) for f, last in files.items()]
    r = recovery.recover(spark.createDataFrame(rows, "queue string, file_id long, num_entries long, last_id long, id_size int, data_size int")).first()
    assert (r["next_file"], r["last_id"], r["next_id"]) == want


def test_cascade_and_memory(spark):
    disk = entries_of(spark, 12).withColumn("source", F.lit("DISK_WAL"))
    store = entries_of(spark, 5).withColumn("source", F.lit("DISK_STORE"))
    cloud = entries_of(spark, 14).withColumn("source", F.lit("CLOUD"))
    got = {r["id"]: r["source"] for r in tiers.cascade(disk.unionByName(store).unionByName(cloud)).collect()}
    assert got == {i: "DISK_STORE" if i < 5 else "DISK_WAL" if i < 12 else "CLOUD" for i in range(14)}
    memory = entries_of(spark, 15).where("id >= 10").withColumn("source", F.lit("MEMORY"))
    both = tiers.memory_first(disk, memory, 10)
    assert {r["id"]: r["source"] for r in both.collect()} == {i: "DISK_WAL" if i < 10 else "MEMORY" for i in range(15)}
    index = spark.createDataFrame([("q", 1, "CLOUD"), ("q", 1, "DISK_WAL"), ("q", 2, "CLOUD")], "queue string, file_id long, source string")
    assert {r["file_id"]: r["source"] for r in tiers.cascade_files(index).collect()} == {1: "DISK_WAL", 2: "CLOUD"}


def plain_retention(files, max_size, latest):
    """Delete the oldest file until enough is freed."""
    excess, out, f = sum(files.values()) - max_size, [], min(files)
    while excess > 0 and f in files and (latest is None or f <= latest):
        out.append(f)
        excess -= files[f]
        f += 1
    return out


def test_retention_is_the_plain_loop(spark):
    rng = random.Random(3)
    for _ in range(6):
        files = {f: rng.randrange(1, 100) for f in range(3, 20) if rng.random() > 0.1}
        latest = rng.choice((None, 8, 30))
        df = spark.createDataFrame([("q", f, b) for f, b in files.items()], "queue string, file_id long, bytes long")
        marks = None if latest is None else spark.createDataFrame([("q", latest)], "queue string, latest_offloaded long")
        for max_size in (0, 200, 5000):
            assert sorted(r["file_id"] for r in tiers.retention_plan(df, max_size, marks).collect()) == plain_retention(files, max_size, latest)
    tiers.check_max_size(30, 10)
    with pytest.raises(InvalidRequest):
        tiers.check_max_size(29, 10)
    copies = spark.createDataFrame([("q", 1, "WAL", 5), ("q", 1, "STORE", 3), ("q", 2, "WAL", 7)], "queue string, file_id long, tier string, bytes long")
    assert {r["file_id"]: (r["tier"], r["bytes"]) for r in tiers.deletable_copies(copies).collect()} == {1: ("STORE", 3), 2: ("WAL", 7)}


def test_memory_bounds(spark):
    rows = spark.createDataFrame([("q", i, 10) for i in range(10)] + [("r", i, 1) for i in range(3)] + [("s", 0, 99)], "queue string, id long, length long")
    acked = spark.createDataFrame([("q", 3), ("q", 6), ("r", 2)], "queue string, acked_id long")
    got = {r["queue"]: tuple(r)[1:] for r in append.memory_bounds(rows, acked, 50).collect()}
    assert got == {"q": (30, 7, 7), "r": (3, 0, 0), "s": (99, 0, 0)}
    assert append.memory_budget(100, 0) == 100 and append.memory_budget(100, 3) == 33
