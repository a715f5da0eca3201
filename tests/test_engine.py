"""The engine end to end, continuous queries, and the registry against DuckDB."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from queuelake import registry
from queuelake.model import Absolute, InvalidRequest, QueueEmpty, QueueNotFound, ShiftFromTail
from queuelake.plans.engine import Engine
from queuelake.plans.settings import CloudSettings, QueueConfig, QueueSettings, Settings
from queuelake.streaming import follow as streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["id"], bytes(r["data"])) for r in df.collect()]


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "data"), Settings(max_file_size=200, cloud=CloudSettings(str(tmp_path / "cloud"))))
    yield made
    made.close()


def test_write_read_reopen(spark, engine, tmp_path):
    assert engine.write("q", []).ids == [] and engine.write("q", [b"entry-0"]).ids == [0]
    assert engine.write("q", [f"entry-{i}".encode() for i in range(1, 20)]).ids == list(range(1, 20))
    assert engine.enqueue("other", b"") == 0 and engine.get_last_id("q") == 19
    assert rows(engine.read_from_offset("q", 3, 4)) == [(i, f"entry-{i}".encode()) for i in (3, 4, 5, 6)]
    assert rows(engine.read_from_tail("q", 5, 3, 2)) == [(i, f"entry-{i}".encode()) for i in (14, 16, 18)]
    assert {r["source"] for r in engine.read("q", Absolute(0), 100).collect()} == {"MEMORY"}
    assert engine.read("q", ShiftFromTail(0), 1).collect()[0]["id"] == 19
    assert engine.index().where(F.col("queue") == engine.resolve("q")).count() > 2
    again = Engine(spark, str(tmp_path / "data"), engine.settings)
    assert again.instance_id == engine.instance_id and again.get_last_id("q") == 19
    assert {r["source"] for r in again.read("q", Absolute(0), 100).collect()} == {"DISK_WAL"}
    assert again.write("q", [b"next"]).ids == [20]
    assert [(i, s) for i, s in ((r["id"], r["source"]) for r in again.read("q", ShiftFromTail(1), 2).collect())] == [(19, "DISK_WAL"), (20, "MEMORY")]


def test_errors_and_session(engine):
    with pytest.raises(QueueNotFound):
        engine.get_last_id("nothing")
    assert engine.read("empty", Absolute(0), 10).count() == 0
    with pytest.raises(QueueEmpty):
        engine.get_last_id("empty")
    with pytest.raises(InvalidRequest):
        engine.read("q", Absolute(0), 0)
    with pytest.raises(QueueNotFound):
        engine.follow("unknown", lambda batch: None)
    assert engine.setup(3) == (3, engine.instance_id) and engine.ping(7)[0] == 7 and len(engine.instance_id_bytes) == 32
    settings = QueueSettings((("*/logs/*", QueueConfig(compression=0)), ("*", QueueConfig(encryption=0))))
    assert settings.config_of("/i/logs/a").compression == 0 and settings.config_of("/i/x").encryption == 0 and QueueSettings().config_of("/x") == QueueConfig()
    with pytest.raises(InvalidRequest):
        Engine(engine.spark, engine.root, Settings(max_disk_per_queue=1))


def test_compaction_offload_retention(spark, engine, tmp_path):
    engine.write("q", [b"x" * 50] * 20)
    before = rows(engine.read("q", Absolute(0), 100))
    engine._queues.clear()
    assert len(engine.compact("q")) > 3
    assert {r["source"] for r in engine.read("q", Absolute(0), 100).collect()} == {"DISK_STORE"} and rows(engine.read("q", Absolute(0), 100)) == before
    n = engine.offload()
    assert n > 3 and engine.offload() == 0
    gone = engine.retain(300)
    assert gone and gone[0][1] == 1
    got = engine.read("q", Absolute(0), 100)
    assert rows(got) == before and {r["source"] for r in got.collect()} == {"DISK_STORE", "CLOUD"}
    every = engine.entries().where(F.col("queue") == engine.resolve("q"))
    assert sorted((r["id"], r["source"]) for r in every.collect()) == sorted((r["id"], r["source"]) for r in got.collect())
    assert engine.write("q", [b"more"]).ids == [20]
    engine.truncate("q")
    assert engine.get_last_id("q") == 19


def test_append_of_data_frames(spark, engine):
    batch = spark.range(100).select(F.concat(F.lit("/i/q"), (F.col("id") % 3).cast("string")).alias("queue"), "id", F.col("id").cast("string").cast("binary").alias("data")).withColumnRenamed("id", "seq")
    engine.append(batch, ["seq"])
    engine.append(batch, ["seq"])
    for k in range(3):
        mine = [str(i).encode() for i in range(100) if i % 3 == k]
        assert rows(engine.read(f"/i/q{k}", Absolute(0), 1000)) == list(enumerate(mine + mine))
    index = engine.index()
    assert index.where("last_id - first_id + 1 <> num_entries").count() == 0 and index.count() > 6


def test_a_stream_appends_once_after_a_crash(spark, engine, tmp_path, monkeypatch):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    batch = spark.range(30).select(F.lit("/i/s").alias("queue"), F.col("id").alias("seq"), F.col("id").cast("string").cast("binary").alias("data"))
    batch.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    from queuelake.sources.objects import ObjectStore

    put = ObjectStore.put

    def crash(self, key, data):
        if key.endswith(".done"):
            raise RuntimeError("crash")
        put(self, key, data)

    monkeypatch.setattr(ObjectStore, "put", crash)
    with pytest.raises(Exception, match="crash"):
        engine.append_stream(stream, ["seq"], checkpoint).awaitTermination()
    assert engine.read("/i/s", Absolute(0), 100).count() == 30
    monkeypatch.setattr(ObjectStore, "put", put)
    engine.append_stream(stream, ["seq"], checkpoint).awaitTermination()
    assert rows(engine.read("/i/s", Absolute(0), 100)) == [(i, str(i).encode()) for i in range(30)]


def test_reopened_engines_know_widths_identity_and_reading_alone(spark, tmp_path):
    root = f"file:{tmp_path}/data"
    engine = Engine(spark, root, Settings(max_file_size=10_000))
    engine.write("q", [b"a"])
    queue = engine.resolve("q")
    spark.createDataFrame([(queue, 5, 1 << 33, bytearray(b"b"), 1)], "queue string, file_id long, id long, data binary, length long").transform(lambda df: engine._write(df, "wal") or df)
    again = Engine(spark, root, read_only=True)
    assert again.instance_id == engine.instance_id and (tmp_path / "data").exists()
    state = again.start_queue(queue)
    assert (state.next_id, state.fold.id_size, state.fold.data_size, state.fold.file_id) == ((1 << 33) + 1, 8, 8, 6)
    assert again.write("q", [b"x"]).status == "SERVER_ERROR" and again.read("q", Absolute(0), 10).count() == 1
    with pytest.raises(InvalidRequest):
        again.compact("q")


def test_follow_replays_then_goes_live(spark, engine, tmp_path):
    engine.write("q", [f"e{i}".encode() for i in range(5)])
    got = []

    def take(batch):
        got.extend(r["id"] for r in batch.collect())
        return len(got) < 5

    subscription = engine.follow("q", take, Absolute(2), checkpoint=str(tmp_path / "c"))
    assert got == [2, 3, 4]
    engine.write("q", [b"e5"])
    engine.write("q", [b"e6"])
    deadline = time.time() + 60
    while not subscription.ended and time.time() < deadline:
        time.sleep(0.2)
    assert got == [2, 3, 4, 5, 6] or got[:5] == [2, 3, 4, 5, 6]
    assert subscription.ended
    engine.unsubscribe(subscription)


def test_follow_with_step_and_from_the_tail(spark, engine):
    engine.write("q", [b"x"] * 10)
    got, live = [], []
    one = engine.follow("q", lambda b: got.extend(r["id"] for r in b.collect()), Absolute(0), step=3)
    two = engine.subscribe("q", lambda b: live.extend(r["id"] for r in b.collect()))
    assert got == [0, 3, 6, 9] and live == []
    engine.write("q", [b"y"] * 3)
    one.query.processAllAvailable()
    two.query.processAllAvailable()
    assert got == [0, 3, 6, 9, 12] and live == [10, 11, 12]


def test_follow_after_compaction_and_offload(spark, engine):
    engine.write("q", [f"entry-{i}".encode() + b"x" * 50 for i in range(20)])
    engine._queues.clear()
    engine.compact("q")
    assert engine.offload() > 3 and engine.retain(300)
    got, tail, live = [], [], []
    follows = [engine.follow("q", lambda b: got.extend(rows(b)), Absolute(0)), engine.follow("q", lambda b: tail.extend(r["id"] for r in b.collect()), ShiftFromTail(12), step=4), engine.subscribe("q", lambda b: live.extend(r["id"] for r in b.collect()))]
    assert got == [(i, f"entry-{i}".encode() + b"x" * 50) for i in range(20)] and tail == [7, 11, 15, 19] and live == []
    assert engine.write("q", [b"y"] * 5).ids == [20, 21, 22, 23, 24]
    for one in follows:
        one.query.processAllAvailable()
    assert [i for i, _ in got] == list(range(25)) and tail == [7, 11, 15, 19, 23] and live == [20, 21, 22, 23, 24]


def test_release_in_order_as_a_stream(spark, tmp_path):
    schema = "queue string, id long, data binary"
    (tmp_path / "in").mkdir()
    stream = streams.release_in_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for k, part in enumerate([[("a", 2), ("a", 1), ("b", 0)], [("a", 0), ("a", 0), ("b", 2)], [("a", 4), ("b", 1), ("a", 1)]]):
        spark.createDataFrame([(q, i, bytearray(f"{q}{i}".encode())) for q, i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        got = sorted((r["queue"], r["id"]) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
        assert got == [[("b", 0)], [("a", 0), ("a", 1), ("a", 2), ("b", 0)], [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]][k]


def test_fan_out_and_streaming_append(spark, engine, tmp_path):
    source = spark.range(30).select(F.lit("/i/s").alias("queue"), "id", F.col("id").cast("string").cast("binary").alias("data")).withColumnRenamed("id", "seq")
    source.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "src"))
    engine.append_stream(stream, ["seq"], str(tmp_path / "c1")).awaitTermination()
    engine.append_stream(stream, ["seq"], str(tmp_path / "c1")).awaitTermination()
    assert [i for i, _ in rows(engine.read("/i/s", Absolute(0), 100))] == list(range(30))
    seen = {"a": 0, "b": 0}

    def counter(name, more):
        def take(batch):
            seen[name] += batch.count()
            return more

        return take

    streams.fan_out(stream, {"a": counter("a", True), "b": counter("b", False)}, str(tmp_path / "c2")).awaitTermination()
    assert seen == {"a": 30, "b": 30}
    assert streams.ack_watermark(source.withColumnRenamed("seq", "id")).first()["acked_id"] == 29


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(text(r[i]) for i in place) for r in want.fetchall())
