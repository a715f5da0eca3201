"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their keys. A keyed Feistel network
permutes the smallest power of two that holds n; numbers that fall outside
0..n-1 walk on along their cycle until they are back inside. The permuted
place p gives shard p mod k and slot p div k, so that the shard and slot of any
row, and the row of any slot, can be computed without looking at other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import number_rows, text_or_empty

SEED = 20240229
ROUNDS = 6


def _mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[np.uint64]:
    with np.errstate(over="ignore"):
        return [np.uint64(k) for k in _mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))]


def _widths(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """One pass over 0..2**bits-1, forwards or back; odd rounds change the high half, even ones the low half."""
    low_bits, high_bits = _widths(n)
    low_mask, high_mask, shift = np.uint64((1 << low_bits) - 1), np.uint64((1 << high_bits) - 1), np.uint64(low_bits)
    low, high = x & low_mask, x >> shift
    steps = list(enumerate(_round_keys(seed)))
    for i, key in reversed(steps) if back else steps:
        if i % 2:
            high = high ^ (_mix64(low ^ key) & high_mask)
        else:
            low = low ^ (_mix64(high ^ key) & low_mask)
    return (high << shift) | low


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permuted places of ``rows`` within 0..n-1 (``back``: the rows at these places)."""
    out = rows.astype(np.uint64)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            out[walking] = _network(out[walking], n, seed, back)
            walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def shard(rows: DataFrame, keys: list[str], shards: int = 16, seed: int = SEED) -> DataFrame:
    """``rows`` with shard, slot and ``row_number``; the law is `rows`: counts at most one apart.

    ``rows`` should be narrow (what addresses a document, not its text); join
    the text by its id, or write each shard's documents in slot order.
    Defined cases: nulls sort last; rows with equal keys get different places;
    an empty table gives an empty result; input columns named as a result
    column are replaced.
    """
    numbered = number_rows(rows, keys, "row_number")
    n = max(1, numbered.count())

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = numbered.withColumn("__ql_place", place("row_number"))
    return placed.withColumns({"shard": (F.col("__ql_place") % shards).cast("int"), "slot": F.expr(f"__ql_place div {shards}")}).drop("__ql_place")


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1) and text_crc32 of each document; a null text is empty."""
    text = text_or_empty()
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """Every document's address: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't `key`)."""
    placed = shard(addressed(docs), ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
