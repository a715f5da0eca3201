"""Recovery: where a queue goes on, from its segment index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.model import DEFAULT_DATA_SIZE, DEFAULT_ID_SIZE


def recover(index: DataFrame) -> DataFrame:
    """(queue, next_file, last_id, next_id, id_size, data_size) from all files of all tiers, the empty and corrupt included.

    The last file with entries gives the last id and the header's widths. A
    latest file without entries is written again; one with entries is followed
    by a new file. A queue without any entry starts afresh with file 1 and id 0.
    """
    valid = F.col("num_entries") > 0
    sums = index.groupBy("queue").agg(
        F.max("file_id").alias("latest"), F.max(F.when(valid, F.col("file_id"))).alias("v"),
        F.max_by(F.struct("last_id", "id_size", "data_size"), F.when(valid, F.struct("file_id", "last_id"))).alias("h"),
    )
    none = F.col("v").isNull()
    return sums.select(
        "queue", F.when(none, 1).when(F.col("v") == F.col("latest"), F.col("latest") + 1).otherwise(F.col("latest")).cast("long").alias("next_file"), F.when(~none, F.col("h.last_id")).alias("last_id"),
        F.when(none, 0).otherwise(F.col("h.last_id") + 1).cast("long").alias("next_id"), F.when(none, DEFAULT_ID_SIZE).otherwise(F.col("h.id_size")).cast("int").alias("id_size"), F.when(none, DEFAULT_DATA_SIZE).otherwise(F.col("h.data_size")).cast("int").alias("data_size"),
    )
