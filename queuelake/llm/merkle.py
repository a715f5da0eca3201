"""Document fingerprints: Merkle trees over paragraphs and sections.

A paragraph is a line. Its leaves are segments of about 30 characters, cut
where a rolling hash over the text says so, so that an edit changes the leaves
around it only. A section is a run of paragraphs that ends with an empty one
or with one whose hash says so. A parent's hash is taken over its children's.
A fingerprint is written as

    root ; section ( paragraph [ leaf.length leaf.length ] paragraph [ ... ] ) section ( ... )

without the spaces around marks: roots (32 hex digits) test equality, and
branches (8 hex digits each) that differ locate edits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import session_of, small_batches, text_or_empty

WINDOW, CUT_BITS, LEAST, MOST = 8, 5, 8, 48
SECTION_BITS = 3
BUCKETS_PER_PARTITION = 8
_SECTION, _PARAGRAPH, _LEAF = re.compile(r"([0-9a-f]{8})\(([^)]*)\)"), re.compile(r"([0-9a-f]{8})\[([^\]]*)\]"), re.compile(r"([0-9a-f]{8})\.([0-9]+)")
Node = tuple[str, Any, int]


def segments(text: str) -> list[int]:
    """The ends of the segments of ``text``: after each line break, at the rolling hash's cuts, and MOST characters from the last."""
    n = len(text)
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    breaks = np.flatnonzero(h == 10) + 1
    factor, width = np.uint32(0x9E3779B1), 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            h[width:] = h[width:] + factor * h[:-width]
            factor, width = factor * factor, width * 2
        h *= np.uint32(0x85EBCA6B)
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, last, lines = [], 0, set(breaks.tolist())
    for at in np.union1d(np.union1d(marks, breaks), [n]).tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at in lines or at == n or at - last >= LEAST:
            if at > last:
                out.append(at)
            last = at
    return out


class Fingerprint:
    """A tree: root digest, and sections of paragraphs of leaves. A node is (name, what it holds, length); a leaf holds nothing."""

    def __init__(self, text: str) -> None:
        import xxhash

        digest = xxhash.xxh64_digest
        self.sections: list[Node] = []
        names: list[bytes] = []
        paragraphs: list[Node] = []
        paragraph_names: list[bytes] = []
        leaves: list[Node] = []
        leaf_names: list[bytes] = []

        def close_paragraph() -> None:
            name = digest(b"p" + b"".join(leaf_names))
            paragraphs.append((name[:4].hex(), leaves.copy(), sum(n for _, _, n in leaves)))
            paragraph_names.append(name)
            blank = leaves[-1][2] == 1
            leaves.clear()
            leaf_names.clear()
            if name[0] < 256 >> SECTION_BITS or blank:
                close_section()

        def close_section() -> None:
            names.append(digest(b"s" + b"".join(paragraph_names)))
            self.sections.append((names[-1][:4].hex(), paragraphs.copy(), sum(n for _, _, n in paragraphs)))
            paragraphs.clear()
            paragraph_names.clear()

        last = 0
        for end in segments(text) if text else ():
            leaf_names.append(digest(text[last:end]))
            leaves.append((leaf_names[-1][:4].hex(), (), end - last))
            last = end
            if text[end - 1] == "\n":
                close_paragraph()
        if leaves:
            close_paragraph()
        if paragraphs:
            close_section()
        self.root = hashlib.md5(b"r" + b"".join(names)).hexdigest()

    @classmethod
    def parse(cls, written: str) -> Fingerprint:
        """The tree that ``str`` has written."""
        out = cls("")
        out.root = written[:32]
        for name, inner in _SECTION.findall(written, 33):
            paragraphs = []
            for p, leaves in _PARAGRAPH.findall(inner):
                own = [(h, (), int(n)) for h, n in _LEAF.findall(leaves)]
                paragraphs.append((p, own, sum(n for _, _, n in own)))
            out.sections.append((name, paragraphs, sum(n for _, _, n in paragraphs)))
        return out

    def __len__(self) -> int:
        return sum(n for _, _, n in self.sections)

    def __str__(self) -> str:
        def paragraph(p: Node) -> str:
            return f"{p[0]}[{' '.join(f'{h}.{n}' for h, _, n in p[1])}]"

        return f"{self.root};" + "".join(f"{name}({''.join(map(paragraph, inner))})" for name, inner, _ in self.sections)


def unmatched(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int]]:
    """(start, length) of a's leaves that ``b`` lacks, from the root down.

    Equal roots end the comparison. Sections that both trees have are passed
    over whole; only in the others are paragraphs compared, and only in the
    paragraphs that differ the leaves. Nodes that occur several times are
    matched as often as both trees have them.
    """
    if a.root == b.root:
        return []
    at, mine, others = 0, [], list(b.sections)
    for node in a.sections:
        mine.append((at, node))
        at += node[2]
    for level in range(3):
        have = Counter((name, n) for name, _, n in others)
        rest, gone = [], Counter()
        for start, node in mine:
            if have[node[0], node[2]] > 0:
                have[node[0], node[2]] -= 1
                gone[node[0], node[2]] += 1
            else:
                rest.append((start, node))
        if level == 2:
            return [(start, node[2]) for start, node in rest]
        left = []
        for node in others:
            if gone[node[0], node[2]] > 0:
                gone[node[0], node[2]] -= 1
            else:
                left.append(node)
        others = [inner for node in left for inner in node[1]]
        mine = []
        for start, node in rest:
            for inner in node[1]:
                mine.append((start, inner))
                start += inner[2]
    return []


def likeness(a: Fingerprint | str, b: Fingerprint | str) -> float:
    """The share of the longer text that stands in nodes which both trees have; 1 for equal roots."""
    a, b = (Fingerprint.parse(x) if isinstance(x, str) else x for x in (a, b))
    if a.root == b.root:
        return 1.0
    return (len(a) - sum(n for _, n in unmatched(a, b))) / max(len(a), len(b))


def differing(a: Fingerprint | str, b: Fingerprint | str) -> list[tuple[int, int]]:
    """The spans of a's text that ``b`` lacks."""
    a, b = (Fingerprint.parse(x) if isinstance(x, str) else x for x in (a, b))
    spans: list[tuple[int, int]] = []
    for start, n in unmatched(a, b):
        if spans and spans[-1][1] == start:
            spans[-1] = (spans[-1][0], start + n)
        else:
            spans.append((start, start + n))
    return spans


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much of the start of ``following``, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_following(docs: DataFrame) -> DataFrame:
    """doc_id, text, __ql_hash, bucket, only: documents dealt to buckets that follow each other, each bucket's last row followed by the next bucket's first.

    The order is that of ids, nulls last, then of the texts' hashes. Bucket
    limits are quantiles of the ids. An id that is several quantiles at once,
    or null, has several buckets, parted by the hash. The driver sees the limits
    and each bucket's first row's keys, whose numbers depend on the partitions
    alone. Texts move once.
    """
    spark = session_of(docs)
    n_buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    total, filled = docs.agg(F.count("*"), F.count("doc_id")).first()
    quantiles = [int(q) for q in docs.select("doc_id").dropna().approxQuantile("doc_id", [i / n_buckets for i in range(1, n_buckets)], 0.2 / n_buckets)]
    times = Counter(quantiles)
    limits = sorted(times.keys() | {q + 1 for q, n in times.items() if n > 1})
    parts = [times[q] if times[q] > 1 else 1 for q in limits]
    # The first bucket lies before all limits; null ids come after all others.
    sizes = np.array([1, *parts, max(1, -(-(total - filled) * n_buckets // max(1, total)))], np.int64)
    bases, places = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array(limits, np.int64)

    @F.arrow_udf("long")
    def bucket_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        k = np.searchsorted(places, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right")
        k[pc.is_null(ids).to_numpy(zero_copy_only=False)] = len(sizes) - 1
        share = (hashes.to_numpy(zero_copy_only=False) >> 32) + (1 << 31)
        return pa.array(bases[k] + ((share * sizes[k]) >> 32), pa.int64())

    keys = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("__ql_hash")).withColumn("bucket", bucket_of("doc_id", "__ql_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "__ql_hash"))
    firsts = {r["bucket"]: r["first"] for r in keys.groupBy("bucket").agg(first.alias("first")).collect()}
    order = sorted(firsts)
    # The first row of each bucket also goes to the bucket before it; that of the first bucket to the last.
    table = [(firsts[b]["doc_id"], firsts[b]["__ql_hash"], order[k - 1]) for k, b in enumerate(order)]
    also = spark.createDataFrame(table, "__ql_first long, __ql_first_hash long, __ql_before long")
    rows = rows.withColumn("__ql_hash", F.xxhash64("text")).withColumn("bucket", bucket_of("doc_id", "__ql_hash"))
    rows = rows.join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("__ql_first")) & (F.col("__ql_hash") == F.col("__ql_first_hash")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("only"))
    copy = F.struct(F.col("__ql_before").alias("bucket"), F.lit(True).alias("only"))
    placed = rows.withColumn("place", F.explode(F.when(F.col("__ql_before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return placed.select("doc_id", "text", "__ql_hash", "place.bucket", "place.only")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    Documents follow each other by ascending doc_id, nulls last, rows of one
    id by their texts' hashes; after the last comes the first, so that a single
    document follows itself. A null text is empty; two empty texts have
    likeness 1, an empty and another 0. An empty table gives an empty result;
    other columns are not passed on, and ids come back as they are.
    """
    small_batches(session_of(docs))
    rows = with_following(docs).repartition("bucket").sortWithinPartitions("bucket", "only", F.col("doc_id").asc_nulls_last(), "__ql_hash", "text")

    def walk(batches: Iterator) -> Iterator:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held = None  # (bucket, doc_id, text, fingerprint) of the last row, if it still waits for its next one
        for batch in batches:
            out = []
            for doc_id, text, bucket, only in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "only"))):
                same = held is not None and held[0] == bucket
                if only and not same:
                    continue
                own = Fingerprint(text)
                if same:
                    _, i, t, f = held
                    changed = edited(t, text)
                    g = Fingerprint(changed)
                    out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), str(f), str(g), likeness(f, g), likeness(f, own)))
                held = None if only else (bucket, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(walk, schema)
