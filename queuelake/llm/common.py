"""What the operators share: scratch tables in the shared folder, batch sizes, global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelake.plans.scratch import materialise as save

#: Arrow batches are kept small, because a batch stands several times in the JVM's and in Python's memory.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by rows and by bytes. The session's bounds are lowered, never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def number_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: the row's gapless place, from 0, in the order of ``keys`` (nulls last).

    The rows are range-partitioned and sorted within partitions, written once,
    and each partition's offset is the sum of the counts before it. No task
    sees all rows, and the driver gets one count for each partition only.
    Rows with equal keys get different numbers. ``df`` should be narrow.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = save(ranged.withColumns({"__ql_part": F.spark_partition_id(), "__ql_row": F.monotonically_increasing_id()}))
    counts = {r["__ql_part"]: r["n"] for r in placed.groupBy("__ql_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    spark = session_of(df)
    table = spark.createDataFrame(offsets, "__ql_part int, __ql_offset long")
    row = F.col("__ql_row") - F.shiftleft(F.col("__ql_part").cast("long"), 33) + F.col("__ql_offset")
    # One row for each partition: its size does not grow with the data a partition holds.
    return placed.join(F.broadcast(table), "__ql_part").withColumn(name, row).drop("__ql_part", "__ql_row", "__ql_offset")


def with_groups(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates over their groups of equal ``key`` (never null).

    The aggregates are made by partial aggregation and written first. So the
    join back has a plain shuffle on either side, and adaptive execution can
    split the partition that holds a hot group; over an aggregation in the same
    stage it couldn't.
    """
    groups = save(rows.groupBy(F.col(key).alias("__ql_key")).agg(*(c.alias(name) for name, c in aggregates.items())))
    return rows.join(groups, F.col(key) == F.col("__ql_key")).drop("__ql_key")
