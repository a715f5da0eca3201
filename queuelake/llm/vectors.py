"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto the principal axes of all
vectors, strongest first. A product is accumulated over the leading dimensions,
and the rest of it is at most the product of the two suffixes' norms; where
that cannot reach the threshold, the comparison stops. Vectors within the
threshold are near each other on every axis, so a grid on the first two axes
says which groups of vectors need comparing at all. Groups are cut into
blocks of bounded size, and each pair of blocks is a tile, one row of a table;
tiles emit counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import save, session_of, small_batches
from queuelake.llm.graph import components

THRESHOLD = 0.95
BLOCK, PART = 4096, 1024
STEPS = 4
GRID_AXES = 2
#: Sums over rotated axes may differ from the plain cosine by rounding; what is this near is decided by the plain one.
SLACK = 1e-9


def units(flat: np.ndarray, dims: int) -> np.ndarray:
    """Rows of length one, in double precision."""
    rows = np.asarray(flat, np.float64).reshape(-1, dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain cosines of paired rows, in double precision."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rotated rows of ``a`` and ``b`` whose product the bound doesn't rule out."""
    dims = a.shape[1]
    steps = [dims * i // STEPS for i in range(1, STEPS + 1)]
    least = threshold - SLACK
    low = 0
    i = j = None
    partial = np.zeros((len(a), len(b)))
    for high in steps:
        rest_a, rest_b = (np.sqrt(np.einsum("ij,ij->i", m[:, high:], m[:, high:])) for m in (a, b))
        if i is None:
            partial += a[:, low:high] @ b[:, low:high].T
            alive = partial + np.outer(rest_a, rest_b) >= least
            if not alive.any():
                return np.zeros(0, int), np.zeros(0, int)
            if np.count_nonzero(alive) < 0.1 * alive.size or high == dims:
                i, j = np.nonzero(alive)
                partial = partial[i, j]
        else:
            partial = partial + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
            alive = partial + rest_a[i] * rest_b[j] >= least
            i, j, partial = i[alive], j[alive], partial[alive]
        low = high
    return i, j


def compare_blocks(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, n: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of two blocks of unit rows (or within one): each row's number of linked vectors, and a spanning forest.

    ``n`` has how many vectors each row stands for; rows of ``b`` are numbered after those of ``a``.
    """
    rows = a if b is None else np.vstack([a, b])
    turned = rows @ axes
    first, second = (len(a), 0) if b is None else (len(a), len(a))
    links, parent, edges = np.zeros(len(rows), np.int64), list(range(len(rows))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i0 in range(0, first, PART):
        for j0 in range(second if b is not None else i0, len(rows), PART):
            i, j = survivors(turned[i0 : min(i0 + PART, first)], turned[j0 : j0 + PART], threshold)
            i, j = i + i0, j + j0
            if b is None:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                real = cosines(rows[x], rows[y]) >= threshold
                x, y = x[real], y[real]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                for u, v in zip(x.tolist(), y.tolist()):
                    r, s = root(u), root(v)
                    if r != s:
                        parent[r] = s
                        edges.append((u, v))
    return links, edges


def _second_moment(reps: DataFrame, dims: int) -> np.ndarray:
    """The d x d matrix of mean products over all vectors, summed by its rows: d rows from each task, d rows in the result."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for d, part in batch.groupby(batch["embedding"].map(len)):
                x = units(np.concatenate(part["embedding"].to_numpy()), d)
                total[:d, :d] += x.T @ x
        yield pd.DataFrame([(i, j, total[i, j]) for i in range(dims) for j in range(dims)], columns=["i", "j", "s"])

    out = np.zeros((dims, dims))
    # dims squared rows, whatever the number of vectors.
    for r in reps.select("embedding").mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return (out + out.T) / 2


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    Defined cases: vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do rows without a vec_id
    (kept is false there) and vectors of different lengths; equal vectors
    are compared once and each counts; repeated rows count as vectors.
    """
    spark = session_of(vectors)
    small_batches(spark)
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = vectors.select("vec_id", "embedding").withColumn("usable", usable)
    key = [F.when(F.col("usable"), F.xxhash64(F.lit(k), e)).alias(f"k{k}") for k in (1, 2)]
    keyed = rows.select("vec_id", *key, F.when(F.col("usable"), e).alias("embedding"))
    reps = save(keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    dims = reps.agg(F.max(F.size("embedding"))).first()[0] or 1
    _, axes = np.linalg.eigh(_second_moment(reps, dims))
    axes = np.ascontiguousarray(axes[:, ::-1])
    # A matrix of the vectors' dimensions, whatever their number.
    shared = spark.sparkContext.broadcast(axes)
    # Unit vectors with cosine c are sqrt(2 - 2c) apart, and no farther on any axis.
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)

    @F.pandas_udf("array<int>")
    def cell(embedding: pd.Series) -> pd.Series:
        out = [None] * len(embedding)
        lead = shared.value[:, :GRID_AXES]
        for d, at in embedding.groupby(embedding.map(len)).indices.items():
            grid = np.floor(units(np.concatenate(embedding.to_numpy()[at]), d) @ lead[:d] / width).astype(int)
            for k, g in zip(at, grid.tolist()):
                out[k] = (g + [0, 0])[:GRID_AXES]
        return pd.Series(out)

    placed = reps.select("rep", "n", "embedding", F.size("embedding").alias("d"), cell("embedding").alias("c")).select("rep", "n", "embedding", "d", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))
    placed = save(placed)
    sizes = placed.groupBy("d", "x", "y").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = placed.join(sizes, ["d", "x", "y"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), "blocks"))
    packed = blocked.groupBy("d", "x", "y", "block").agg(F.collect_list(F.struct("rep", "n", "embedding")).alias("v"))
    # A block holds BLOCK vectors on average.
    packed = save(packed.select("d", "x", "y", "block", F.transform("v", lambda v: v["rep"]).alias("rep"), F.transform("v", lambda v: v["n"]).alias("n"), F.flatten(F.transform("v", lambda v: v["embedding"])).alias("flat")))
    names = packed.select("d", "x", "y", "block")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    here = names.withColumn("step", steps).select("d", "x", "y", "block", (F.col("x") + F.col("step.i")).alias("x2"), (F.col("y") + F.col("step.j")).alias("y2"))
    there = names.select(F.col("d").alias("d2"), F.col("x").alias("x3"), F.col("y").alias("y3"), F.col("block").alias("block2"))
    pairs = here.join(there, (F.col("d") == F.col("d2")) & (F.col("x2") == F.col("x3")) & (F.col("y2") == F.col("y3")))
    pairs = pairs.where(F.struct("x", "y", "block") <= F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("block2").alias("block"))).select("d", "x", "y", "block", "x2", "y2", "block2")
    # Dealt by both blocks, so that the tiles of one block go to many tasks.
    left = packed.select("d", "x", "y", "block", F.col("rep").alias("rep1"), F.col("n").alias("n1"), F.col("flat").alias("flat1"))
    right = packed.select("d", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("block").alias("block2"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("flat").alias("flat2"))
    tiles = pairs.join(left, ["d", "x", "y", "block"]).join(right, ["d", "x2", "y2", "block2"])
    same = ((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("block") == F.col("block2"))).alias("same")
    tiles = tiles.select("d", same, "rep1", "n1", "flat1", "rep2", "n2", "flat2")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = shared.value
        for batch in batches:
            for t in batch.itertuples():
                a = units(t.flat1, t.d)
                b = None if t.same else units(t.flat2, t.d)
                names = np.asarray(t.rep1) if t.same else np.concatenate([t.rep1, t.rep2])
                n = np.asarray(t.n1) if t.same else np.concatenate([t.n1, t.n2])
                links, edges = compare_blocks(a, b, basis[: t.d], n, threshold)
                used = np.flatnonzero(links)
                out = pd.DataFrame({"rep": names[used], "links": links[used]})
                out["other"] = pd.array([None] * len(out), dtype="Int64")
                joined = pd.DataFrame({"rep": [names[u] for u, _ in edges], "links": 0, "other": pd.array([names[v] for _, v in edges], dtype="Int64")})
                yield pd.concat([out, joined]).astype({"rep": "int64", "links": "int64"})

    n_tiles = max(1, pairs.count())
    found = save(tiles.repartition(min(n_tiles, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(compare, "rep long, links long, other long"))
    graph = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    graph = graph.withColumnRenamed("node", "rep")
    done = reps.select("k1", "k2", "rep", "n").join(counts, "rep", "left").join(graph, "rep", "left")
    done = done.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "k1", "k2").join(done, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
