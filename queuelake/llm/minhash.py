"""Near-duplicate documents by Order MinHash, verified by banded alignment of the texts' words.

Shingles are five words; the t-th occurrence of a shingle in a text is an
element of its own. A sketch takes the ORDER elements with the least hashes
under one of SKETCHES hash functions. Their order in the text is left to the
alignment: where a text lacks an early occurrence, all later ones of that
shingle stand elsewhere in the other text. Short texts have keys that no text
with 0.8 of their shingles can miss (``prefixes``). Texts that share a sketch or
a key form a bucket; equal buckets count once. Pairs of a bucket are
examined in tiles of one or two blocks of bounded size, without emitting them:
common words are counted as a matrix product, and what could reach the
threshold is aligned. An alignment is a longest common subsequence of the
words, within the diagonal band that the threshold leaves; the similarity is its
length over the number of words in either text less that length, so that one
changed word costs two words and not ten shingles. Whatever has 0.8 of its
shingles in common, in order, has 0.8 of its words. Tiles
emit the links found as stars around the least text of those linked, so that
tiles of the same texts emit the same edges, and components of these edges are
the classes.

Large buckets take two passes. The first compares every block with itself and
with a few members of the bucket, its head, which is linear in the bucket's
size and puts a group of copies into one component, however large it is. The second examines
the pairs that are left where a bucket still has several components: members
of a large component share blocks, and two blocks of the same component are
not compared again. So only texts that share sketches without being
near-duplicates cost time with the square of their bucket.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import save, session_of, small_batches, text_or_empty, with_groups
from queuelake.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
#: Of two texts with the share j of their shingles in common, j**ORDER is the chance that a sketch is shared. At 95 % equal words j is
#: about 0.63, so that one of 32 is shared with a chance of 0.996; where j is 0.8, all but certainly.
ORDER, SKETCHES, SEED = 4, 32, 97
#: Texts of more elements have sketches; a near-duplicate of any other has at most 1 / THRESHOLD times as many. Elements in a key of the exact way.
SHORT, TOGETHER = 16, 3
#: Texts and words in a block, as far as texts aren't longer; a tile holds one or two blocks.
BLOCK, BLOCK_WORDS, HEAD_PART = 256, 150_000, 8
#: Shingles of a text that are aligned before the band's window moves.
ROWS = 1024
COLUMNS = 4096
#: Words whose hashes a task remembers, and their greatest length.
KEPT_WORDS, KEPT_WORD = 50_000, 32
#: Hashes of elements that are compared at once.
AT_ONCE = 1 << 17
#: Up to so many text digests (16 bytes each) or buckets (24 bytes) are broadcast; beyond, a shuffle join finds the same rows.
BROADCAST_ROWS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Texts to their words' hashes and on to shingles' hashes; hashes of words are kept within a task."""

    def __init__(self) -> None:
        import xxhash

        self.digest, self.known = xxhash.xxh64_intdigest, {}
        self.powers = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def _word(self, word: str) -> int:
        found = self.digest(word)
        if len(word) <= KEPT_WORD:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def words(self, text: str) -> np.ndarray:
        """One 64-bit hash for each word (what white space separates), in text order."""
        get, make = self.known.get, self._word
        return np.fromiter([get(w) or make(w) for w in text.split()], np.uint64)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """One hash for each shingle, equal for equal ones; a text of fewer words is one shingle, an empty one has none."""
        if not len(words):
            return words
        with np.errstate(over="ignore"):
            n = max(1, len(words) - WORDS + 1)
            shingles = np.zeros(n, np.uint64)
            for i in range(min(WORDS, len(words))):
                shingles += words[i : i + n] * self.powers[i]
            return _mix(shingles)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """The elements: a shingle's first occurrence is its hash, each later one has a hash of its own."""
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return shingles
    starts = np.flatnonzero(new)
    occurrence = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    elements = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        elements[order] = np.where(occurrence > 0, _mix(ranked + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ranked)
    return elements


def sketches(elements: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the sets of least elements; two texts without elements share all."""
    keys = _mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    adds, factors = keys[:SKETCHES], keys[SKETCHES:] | np.uint64(1)
    out = adds.copy()
    with np.errstate(over="ignore"):
        if len(elements) <= ORDER:  # no text of so few elements but the empty one has sketches
            chosen = np.broadcast_to(np.sort(elements), (SKETCHES, len(elements)))
        else:
            chosen = np.empty((SKETCHES, ORDER), np.uint64)
            few = max(1, AT_ONCE // len(elements))  # functions at a time: a long text needs no more memory than itself some times
            for k in range(0, SKETCHES, few):
                hashed = (elements[None, :] ^ adds[k : k + few, None]) * factors[k : k + few, None]
                places = np.argpartition(hashed, ORDER - 1, axis=1)[:, :ORDER]
                chosen[k : k + few] = np.sort(elements[places], axis=1)
        for i in range(chosen.shape[1]):
            out = _mix(out + chosen[:, i])
    return out.view(np.int64)


def prefixes(elements: np.ndarray) -> np.ndarray:
    """Keys of a short text, of which it shares at least one with every text that reaches the threshold in its shingles.

    Such a text has at least o = THRESHOLD * n of the n elements. Of the common ones, the k least in any fixed
    order are among the n - o + k least of either text, and so every k of these make a key.
    """
    n = len(elements)
    k = min(TOGETHER, n)
    least = np.sort(_mix(elements ^ np.uint64(SEED)))[: n - int(np.ceil(THRESHOLD * n - 1e-9)) + k]
    chosen = np.array(list(combinations(least, k)), np.uint64)
    out = np.full(len(chosen), SEED + SKETCHES, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mix(out + chosen[:, i])
    return out.view(np.int64)


def keys_of(elements: np.ndarray) -> np.ndarray:
    """The keys of a text's buckets; of two texts that reach the threshold in their shingles, both have prefixes or both have sketches."""
    n = len(elements)
    parts = [prefixes(elements)] if 0 < n <= SHORT / THRESHOLD else []
    parts += [sketches(elements)] if n > SHORT or n == 0 else []
    return np.concatenate(parts)


def least_common(n: int, m: int) -> int:
    """The least number of common elements with which texts of n and m elements reach the threshold."""
    return int(np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + m) - 1e-9))


def _chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest chain of common elements that rises in both, inside the band; elements are distinct within a text."""
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(at_a - at_b) <= band
    rising = at_b[inside][np.argsort(at_a[inside])].tolist()
    tails: list[int] = []
    for j in rising:
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
    return len(tails)


def _subsequence(a: list[int], b: list[int], band: int) -> int:
    """The longest common subsequence in the band, with a bit for each place of ``b``: a clear bit is a place where its length grows.

    No place beyond the window has matched yet, and none before it matches again, so the window's bits are enough.
    """
    places: dict[int, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    length = low = high = bits = 0
    for at in range(0, len(a), ROWS):
        passed = min(max(0, at - band), high) - low
        if passed > 0:
            length += passed - (bits & ((1 << passed) - 1)).bit_count()
            bits >>= passed
            low += passed
        until = min(len(b), at + ROWS + band)
        if until > high:
            bits |= ((1 << (until - high)) - 1) << (high - low)
            high = until
        full = (1 << (high - low)) - 1
        masks: dict[int, int] = {}
        for x in a[at : at + ROWS]:
            mine = places.get(x)
            if mine is None:
                continue
            mask = masks.get(x)
            if mask is None:
                mask = 0
                first, last = bisect_left(mine, low), bisect_left(mine, high)
                if last - first > 8:
                    set_bits = np.zeros(high - low, bool)
                    set_bits[np.array(mine[first:last]) - low] = True
                    mask = int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")
                else:
                    for j in mine[first:last]:
                        mask |= 1 << (j - low)
                if last - first > 1:
                    masks[x] = mask
            matched = bits & mask
            if matched:
                bits = ((bits + matched) | (bits ^ matched)) & full
    return length + high - low - bits.bit_count()


def alignment(a: np.ndarray, b: np.ndarray) -> int:
    """The longest common subsequence of two texts' shingles, as far as it reaches the threshold; less than that may be less than it is."""
    need = least_common(len(a), len(b))
    # A chain of ``need`` leaves at most this many elements beside it, so it stays this near to the diagonal.
    band = max(len(a), len(b)) - need
    if band < 0 or min(len(a), len(b)) < need:
        return 0
    x, y = labelled(a), labelled(b)
    n = _chain(x, y, band)
    # Without repeated shingles the chain is the answer; else it is one common subsequence among others.
    if n >= need or x is a and y is b:
        return n
    # What the texts begin and end with alike belongs to a longest common subsequence.
    least = min(len(a), len(b))
    differs = np.flatnonzero(a[:least] != b[:least])
    head = int(differs[0]) if len(differs) else least
    differs = np.flatnonzero(a[len(a) - least + head :][::-1] != b[len(b) - least + head :][::-1])
    tail = int(differs[0]) if len(differs) else least - head
    return head + tail + _subsequence(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), band)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts reach the threshold; texts without elements equal each other only."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    n = alignment(a, b)
    return n >= THRESHOLD * (len(a) + len(b) - n)


def _common(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``rows`` has in common with each of ``columns``; in slices of the elements that occur twice at least."""
    texts = rows + columns
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    elements, inverse, counts = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    use = counts[inverse] > 1
    owner, place = owner[use], shared[inverse[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        i, j = np.searchsorted(place, (low, low + COLUMNS))
        part = np.zeros((len(texts), COLUMNS), np.float32)
        part[owner[i:j], place[i:j] - low] = 1
        out += part[: len(rows)] @ part[len(rows) :].T
    return out


def tile_edges(blocks: list[int], known: list[bytes], words: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """The links in a tile, all pairs of one block or the pairs across two, as stars: (c, the least component of those that links join to c).

    Texts of one component (``known``) are joined from the start. Tiles that hold the same texts give the same edges, in whatever order they have them.
    """
    first_of: dict[bytes, int] = {}
    parent = [first_of.setdefault(c, i) for i, c in enumerate(known)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = min(blocks)
    one = [i for i, b in enumerate(blocks) if b == first]
    two = [i for i, b in enumerate(blocks) if b != first]
    inside = not two
    two = two or one
    elements = [labelled(t) for t in words]
    common = _common([elements[i] for i in one], [elements[i] for i in two])
    n, m = (np.array([len(elements[i]) for i in part], np.float64) for part in (one, two))
    could = common >= np.ceil(THRESHOLD / (1 + THRESHOLD) * (n[:, None] + m[None, :]) - 1e-9)
    for x, y in zip(*np.nonzero(could)):
        if inside and x >= y:
            continue
        i, j = one[x], two[y]
        a, b = root(i), root(j)
        if a != b and linked(words[i], words[j]):
            parent[a] = b
    least: dict[int, bytes] = {}
    for i, c in enumerate(known):
        least[root(i)] = min(c, least.get(root(i), c))
    return sorted({(c, least[root(i)]) for i, c in enumerate(known)} - {(c, c) for c in known})


def digested(docs: DataFrame) -> DataFrame:
    """``docs`` with __ql_node: the digest that equal texts share. A null text is empty."""
    return docs.withColumn("__ql_node", F.unhex(F.md5(text_or_empty())))


def _compared(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b) between components (``known``) that the tiles (tile, node, block, known) find."""

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        tile, blocks, known, words = None, [], [], []

        def edges() -> Iterator[pa.RecordBatch]:
            found = tile_edges(blocks, known, words) if len(words) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], schema=schema)

        for batch in batches:
            for t, block, component, text in zip(*(batch.column(c).to_pylist() for c in ("tile", "block", "known", "text"))):
                if t != tile:
                    yield from edges()
                    tile, blocks, known, words = t, [], [], []
                blocks.append(block)
                known.append(component)
                words.append(hasher.words(text))
        yield from edges()

    needed = tiles.select("node").distinct()
    small = needed.count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(needed) if small else needed, "node", "left_semi").dropDuplicates(["node"])
    rows = tiles.join(wanted, "node").select("tile", "block", "known", "text").repartition("tile").sortWithinPartitions("tile")
    return save(rows.mapInArrow(compare, "a binary, b binary"))


def _blocks(texts: str | Column, words: str | Column) -> Column:
    """Into how many blocks so many texts of so many words go."""
    texts, words = (F.col(c) if isinstance(c, str) else c for c in (texts, words))
    return F.ceil(F.greatest(texts / BLOCK, words / BLOCK_WORDS, F.lit(1))).cast("long")


def _first_tiles(inside: DataFrame) -> DataFrame:
    """Every block, with its bucket's head: about BLOCK / HEAD_PART members that join every tile of their bucket."""
    block = F.pmod(F.xxhash64("node"), "blocks")
    is_head = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks") * HEAD_PART) == 0)
    placed = inside.withColumn("tile", F.explode(F.when(is_head, F.expr("sequence(0L, blocks - 1)")).otherwise(F.array(block))))
    return placed.select(F.xxhash64("key", "tile").alias("tile"), "node", F.lit(0).cast("long").alias("block"), F.col("node").alias("known"))


def _second_tiles(inside: DataFrame, found: DataFrame) -> DataFrame:
    """Of buckets with more than one block and several components: all pairs of blocks but those of one component."""
    found = found.withColumnRenamed("node", "__n")
    members = inside.where("blocks > 1").join(found, F.col("node") == F.col("__n"), "left").select("key", "node", "words", F.coalesce("component", "node").alias("known"))
    members = save(members)
    mixed = members.groupBy("key").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x <> y").select("key")
    sizes = members.join(mixed, "key", "left_semi").groupBy("key", "known").agg(F.count("*").alias("c"), F.sum("words").alias("w"))
    # Components that fill a block have blocks of their own; the others share blocks.
    sizes = sizes.withColumn("own", F.when(_blocks("c", "w") > 1, F.col("known")).otherwise(F.lit(b"")))
    totals = sizes.groupBy("key", "own").agg(_blocks(F.sum("c"), F.sum("w")).alias("blocks"))
    # Saved, so that the join below has a plain shuffle on either side, which can be split where a key is hot.
    sizes = save(sizes.join(totals, ["key", "own"]).select("key", "known", "own", "blocks"))
    placed = save(members.join(sizes, ["key", "known"]).withColumn("block", F.xxhash64("own", F.pmod(F.xxhash64("node"), "blocks"))))
    blocks = placed.select("key", "own", "block").distinct()
    other = blocks.select("key", F.col("own").alias("own2"), F.col("block").alias("block2"))
    # A row for each two blocks, not for texts.
    pairs = blocks.join(other, "key").where("block <= block2 AND (own = X'' OR own <> own2)")
    pairs = save(pairs.select("key", "block", "block2", F.xxhash64("key", "block", "block2").alias("tile")))
    ends = pairs.select("key", "block", "tile").unionByName(pairs.select("key", F.col("block2").alias("block"), "tile")).distinct()
    return placed.join(ends, ["key", "block"]).select("tile", "node", "block", "known")


def classes(docs: DataFrame) -> DataFrame:
    """(node, component) of the texts that have a near-duplicate of another text; node as by ``digested``."""
    small_batches(session_of(docs))
    texts = digested(docs.select("text")).select(F.col("__ql_node").alias("node"), text_or_empty().alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            words = [hasher.words(t) for t in batch.column("text").to_pylist()]
            keys = [keys_of(labelled(hasher.shingles(w))) for w in words]
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "words": pa.array(map(len, words), pa.int64()), "keys": lists})

    sketched = save(texts.mapInArrow(sketch, "node binary, words long, keys array<long>"))
    members = save(sketched.dropDuplicates(["node"]).select("node", "words", F.explode("keys").alias("key")))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("set")).where("n > 1")
    # Buckets with the same members are one.
    buckets = save(buckets.groupBy("n", "w", "set").agg(F.min("key").alias("key")).select("key", "n", "w"))
    shared = F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets
    inside = save(members.join(shared, "key").select("key", "node", "words", _blocks("n", "w").alias("blocks")))
    edges = _compared(_first_tiles(inside), texts)
    found = save(components(edges))
    if inside.where("blocks > 1").isEmpty():
        return found
    more = _compared(save(_second_tiles(inside, found)), texts)
    # The second pass adds its edges to the stars of the first.
    return components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id (the class's least doc_id) and kept for each row of ``docs``.

    Defined cases: equal texts, and so all empty and null ones, are one class;
    texts of under five words link with those of the same words only; null ids are
    never a class's id unless it has no other; of a class, the least id with
    the least digest is kept, and rows that repeat both are one document.
    """
    rows = save(digested(docs.select("doc_id", "text")).select("doc_id", "__ql_node"))
    found = classes(docs).withColumnRenamed("node", "__ql_n")
    placed = save(rows.join(found, F.col("__ql_node") == F.col("__ql_n"), "left").select("doc_id", F.col("__ql_node").alias("node"), F.coalesce("component", "__ql_node").alias("component")))
    joined = with_groups(placed, "component", first=F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "node")))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return joined.select("doc_id", "node", F.col("first.doc_id").alias("class_id"), kept.alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates, the one that ``mark`` keeps.

    Rows that repeat its id and text are one document. Columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    marked = save(mark(docs).where("kept").groupBy("doc_id", "node").agg(F.count("*").alias("n")))
    kept = marked.select(F.col("doc_id").alias("__ql_id"), F.col("node").alias("__ql_kept"))
    rows = digested(docs)
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__ql_id"]) & (rows["__ql_node"] == kept["__ql_kept"]), "left_semi")
    if not marked.where("n > 1").isEmpty():  # rows that repeat an id and a text
        out = out.dropDuplicates(["doc_id", "__ql_node"])
    return out.select(*docs.columns)
