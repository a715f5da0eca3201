"""Tiers: which copy of an entry answers, what is offloaded, what retention may delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.model import MAX_FILE_SIZE, TIER_RANK, InvalidRequest


def tier_rank(source: Column) -> Column:
    rank = F.lit(len(TIER_RANK))
    for name, place in TIER_RANK.items():
        rank = F.when(source == name, F.lit(place)).otherwise(rank)
    return rank


def cascade(entries: DataFrame, keys: tuple[str, ...] = ("queue", "id")) -> DataFrame:
    """Of the copies of an entry in several tiers (with source), the one of the first tier: an aggregation with partial sums, no sort."""
    rest = [c for c in entries.columns if c not in keys]
    first = F.min_by(F.struct(*rest), tier_rank(F.col("source")))
    return entries.groupBy(*keys).agg(first.alias("__e")).select(*keys, "__e.*").select(*entries.columns)


def cascade_files(index: DataFrame) -> DataFrame:
    """The tier (column source) that answers for each file: decided on the index, so that a copy that isn't read isn't opened."""
    return index.groupBy("queue", "file_id").agg(F.min_by("source", tier_rank(F.col("source"))).alias("source"))


def memory_first(entries: DataFrame, memory: DataFrame, first_in_memory: int | None) -> DataFrame:
    """Entries below the memory tier's first id from disk, the others from memory."""
    if first_in_memory is None:
        return entries
    return entries.where(F.col("id") < first_in_memory).unionByName(memory.where(F.col("id") >= first_in_memory))


def offload_pending(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local store files (queue, file_id, size) without a remote copy of the same size."""
    return local.join(remote.select("queue", "file_id", "size"), ["queue", "file_id", "size"], "left_anti")


def offloaded(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.join(remote.select("queue", "file_id", "size"), ["queue", "file_id", "size"], "left_semi")


def latest_offloaded(remote: DataFrame) -> DataFrame:
    return remote.groupBy("queue").agg(F.max("file_id").alias("latest_offloaded"))


def queue_sizes(files: DataFrame) -> DataFrame:
    """Bytes of each queue over its WAL and store files."""
    return files.groupBy("queue").agg(F.sum("bytes").cast("long").alias("bytes"))


def check_max_size(max_size: int, max_file_size: int = MAX_FILE_SIZE) -> None:
    """A queue's limit must leave room for three segment files."""
    if max_size < 3 * max_file_size:
        raise InvalidRequest(f"max_size {max_size} must be at least 3 times the file size {max_file_size}")


def retention_plan(files: DataFrame, max_size: int, latest: DataFrame | None = None) -> DataFrame:
    """The files (queue, file_id, bytes) to delete so that each queue fits ``max_size``, oldest first.

    Deletion stops when enough is freed, at the first gap in the ids, and at
    the first file that isn't offloaded. Without ``latest`` (queue,
    latest_offloaded) there is no offloader and every file may go. The windows
    run over file metadata, a row a file.
    """
    by_id = Window.partitionBy("queue").orderBy("file_id")
    whole = Window.partitionBy("queue")
    ranked = files.withColumns({
        "__before": F.sum("bytes").over(by_id.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"),
        "__total": F.sum("bytes").over(whole),
        "__place": F.col("file_id") - F.row_number().over(by_id) + 1,
        "__first": F.min("file_id").over(whole),
    })
    plan = ranked.where((F.col("__before") < F.col("__total") - max_size) & (F.col("__place") == F.col("__first")))
    if latest is not None:
        plan = plan.join(latest, "queue").where(F.col("file_id") <= F.col("latest_offloaded"))
    return plan.select(*files.columns)


def deletable_copies(files: DataFrame) -> DataFrame:
    """Of a file's local copies (tier WAL or STORE), the one that retention deletes: the store copy if there is one."""
    return files.groupBy("queue", "file_id").agg(F.min_by(F.struct("tier", "bytes"), F.when(F.col("tier") == "STORE", 0).otherwise(1)).alias("c")).select("queue", "file_id", "c.tier", "c.bytes")
