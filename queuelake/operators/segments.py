"""The segment index: built by aggregation, searched by a bucketed range join, used to prune reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.operators.reads import id_range


def build_index(entries: DataFrame, *more: Column) -> DataFrame:
    """A row for each (queue, file_id) of ``entries`` (with length): first_id, last_id, num_entries, entries_before, bytes, and ``more`` aggregates."""
    return entries.groupBy("queue", "file_id").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").cast("long").alias("num_entries"), F.min("id").alias("entries_before"), F.sum("length").cast("long").alias("bytes"), *more
    )


def merged_index(indexes: DataFrame) -> DataFrame:
    """One row for each file over all tiers (with tier): least first id, greatest last id, header fields from the WAL where it has them."""
    from_wal = F.when(F.col("tier") == "WAL", F.col("entries_before"))
    return indexes.groupBy("queue", "file_id").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.coalesce(F.max(from_wal), F.max("entries_before")).alias("entries_before"), F.max("num_entries").alias("num_entries")
    )


def file_bounds(indexes: DataFrame) -> DataFrame:
    """(queue, min_file, max_file) over all tiers: numeric, whatever the paths' order."""
    return indexes.groupBy("queue").agg(F.min("file_id").alias("min_file"), F.max("file_id").alias("max_file"))


def last_valid_file(index: DataFrame, at_most: int) -> DataFrame:
    """For each queue, the greatest file up to ``at_most`` that has entries."""
    return index.where((F.col("num_entries") > 0) & (F.col("file_id") <= at_most)).groupBy("queue").agg(F.max("file_id").alias("file_id"))


def lookup(targets: DataFrame, index: DataFrame) -> DataFrame:
    """``targets`` (queue, target) with the file that holds each: the one with the greatest start at or below it.

    Targets below the first start get the first file, those beyond the end the
    last. Each queue's span is cut into as many buckets as it has segments; a
    segment stands in every bucket that it touches, at most twice as many rows in all, and a target in one: an
    equi-join, where the target's rows of a hot queue spread over its buckets.
    """
    starts = index.where("num_entries > 0").select("queue", "file_id", F.col("first_id").alias("st"))
    spans = starts.groupBy("queue").agg(F.min("st").alias("lo"), F.max("st").alias("hi"), F.count("*").alias("n"))
    spans = spans.withColumn("w", F.greatest(F.lit(1), F.expr("(hi - lo) div n + 1")))
    # The index has a row a segment; a queue's part of it is small.
    following = F.lead("st").over(Window.partitionBy("queue").orderBy("st", "file_id"))
    covers = starts.withColumn("en", following).join(spans.select("queue", "lo", "w"), "queue")
    last_bucket = F.expr("(coalesce(en, st + 1) - 1 - lo) div w")
    covers = covers.where("en IS NULL OR en > st").withColumn("bucket", F.explode(F.sequence(F.expr("(st - lo) div w"), last_bucket)))
    clamped = targets.join(spans.withColumnRenamed("queue", "__q"), F.col("queue") == F.col("__q"))
    clamped = clamped.withColumn("__t", F.least(F.greatest(F.col("target"), F.col("lo")), F.col("hi"))).withColumn("__b", F.expr("(__t - lo) div w"))
    covers = covers.select(F.col("queue").alias("__cq"), "file_id", "st", "en", "bucket")
    found = clamped.join(covers, (F.col("queue") == F.col("__cq")) & (F.col("__b") == F.col("bucket")) & (F.col("__t") >= F.col("st")) & (F.col("en").isNull() | (F.col("__t") < F.col("en"))))
    return found.select(*targets.columns, "file_id")


def files_of_range(index: DataFrame, queue: str, start: int, end: int | None = None, step: int = 1) -> list[int]:
    """The files of ``queue`` that hold an id of the range and step: what a read must open, for a literal IN filter.

    A read's own window bounds this list.
    """
    rows = index.where((F.col("queue") == queue) & (F.col("last_id") >= start))
    if end is not None:
        rows = rows.where(F.col("first_id") <= end)
    if step > 1:
        # The first member of the class at or after the segment's start must not lie beyond its end.
        first = F.greatest(F.col("first_id"), F.lit(start).cast("long"))
        rows = rows.where(first + F.expr(f"pmod({start} - greatest(first_id, {start}), {step})") <= F.col("last_id"))
    return sorted(r["file_id"] for r in rows.select("file_id").collect())


def pruned_read(entries: DataFrame, index: DataFrame, queue: str, start: int, end: int | None = None, step: int = 1) -> DataFrame:
    """A range read that opens the files of the range only, where entries are partitioned by file_id."""
    files = files_of_range(index, queue, start, end, step)
    mine = entries.where((F.col("queue") == queue) & (F.col("file_id").isin(files) if files else F.lit(False)))
    return id_range(mine, start, end, step)


def valid_prefix(records: DataFrame) -> DataFrame:
    """The records (queue, file_id, ord, ok) before each segment's first bad one, by its least bad place: no window."""
    bad = records.where(~F.col("ok")).groupBy("queue", "file_id").agg(F.min("ord").alias("__bad"))
    joined = records.join(bad, ["queue", "file_id"], "left")
    return joined.where(F.col("__bad").isNull() | (F.col("ord") < F.col("__bad"))).drop("__bad")
