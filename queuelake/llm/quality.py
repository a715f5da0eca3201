"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so that all pairwise interactions of a document's features cost time linear in
their number. Features: words hashed to BUCKETS (value: share of the document's
words), the words' shapes hashed likewise, and structure statistics and the
document's own counts (characters, words, lines), each as one of a few bins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import session_of, small_batches, text_or_empty

BUCKETS = 1 << 13
SHAPES = 1 << 10
BINS = 12
STATISTICS = ("distinct", "top_word", "upper", "punctuation", "digit", "mean_length", "long_word", "n_chars", "n_words", "n_lines")
FEATURES = BUCKETS + SHAPES + BINS * len(STATISTICS)
FACTORS = 8
#: At most so many labelled rows are learnt from: those whose ids' hashes are smallest. What is fitted stops changing long before.
TRAIN_ROWS = 3000
EPOCHS, MINI, RATE, DECAY, SEED = 12, 8, 0.08, 2e-4, 11
KEEP = 0.3
#: What a task remembers of words; others are hashed anew.
KEPT_WORDS, KEPT_WORD = 50_000, 32
#: Features that are scored together.
TOGETHER = 100_000
_PUNCTUATION = re.compile(r"[^\w\s]")
_DIGIT, _UPPER = re.compile(r"[0-9]"), re.compile(r"[^\W\d_a-z]")


def _shape(word: str) -> str:
    """A letter pattern with runs collapsed: Thre*** is Aa*, REAT!! is A!."""
    out = ""
    for c in word:
        k = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out.endswith(k):
            out += k
    return out


class Featuriser:
    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        found = (zlib.crc32(word.encode()) % BUCKETS, BUCKETS + zlib.crc32(_shape(word).encode()) % SHAPES)
        if len(word) <= KEPT_WORD:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The indices and values of a whole text's features, empty texts included."""
        counts = Counter(text.split())
        n, size = sum(counts.values()), len(text)
        known, make = self.known.get, self._word
        pairs = np.array([known(w) or make(w) for w in counts], dtype=np.int64).reshape(-1, 2)
        share = np.fromiter(counts.values(), float, len(counts)) / max(1, n)
        lengths = np.fromiter(map(len, counts), float, len(counts))
        index, value = np.unique(pairs.ravel(), return_inverse=True)
        value = np.bincount(value, np.repeat(share, 2), len(index)) if len(index) else np.zeros(0)
        upper = sum(map(str.isupper, counts)) / max(1, len(counts))
        punctuation, digit = len(_PUNCTUATION.findall(text)) / max(1, size), len(_DIGIT.findall(text)) / max(1, size)
        statistics = (
            len(counts) / max(1, n), share.max(initial=0.0), upper, min(1.0, 4 * punctuation), min(1.0, 4 * digit),
            min(1.0, float(share @ lengths) / 24), float(share[lengths > 20].sum()),
            np.log2(1 + size) / 24, np.log2(1 + n) / 20, np.log2(1 + text.count("\n")) / 16,
        )
        bins = [BUCKETS + SHAPES + BINS * i + min(BINS - 1, int(s * BINS)) for i, s in enumerate(statistics)]
        return np.concatenate([index, bins]), np.concatenate([np.sqrt(value), np.full(len(bins), 0.5)])


Model = tuple[float, np.ndarray, np.ndarray]
Features = tuple[np.ndarray, np.ndarray]


def margins(model: Model, rows: list[Features]) -> np.ndarray:
    """The rows' margins by the sum-of-squares identity, all at once; each row has features."""
    w0, w, v = model
    index, value = (np.concatenate(part) for part in zip(*rows))
    starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
    xv = v[index] * value[:, None]
    squares = np.square(np.add.reduceat(xv, starts)).sum(1) - np.add.reduceat(np.square(xv).sum(1), starts)
    return w0 + np.add.reduceat(w[index] * value, starts) + 0.5 * squares


def probabilities(model: Model, rows: Iterable[Features]) -> list[float]:
    """The rows' scores, made together for TOGETHER features at a time."""
    out: list[float] = []
    held: list[Features] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= TOGETHER:
            out += (1 / (1 + np.exp(-np.clip(margins(model, held), -30, 30)))).tolist()
            held, size = [], 0
    return out + ((1 / (1 + np.exp(-np.clip(margins(model, held), -30, 30)))).tolist() if held else [])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """AdaGrad on log loss over batches of MINI rows, in a fixed order; without rows every score is one half."""
    rng = np.random.default_rng(SEED)
    w0, w, v = 0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS))
    if not rows:
        return w0, w, v * 0
    g0, gw, gv = 1e-3, np.full(FEATURES, 1e-3), np.full((FEATURES, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), MINI):
            batch = [rows[k] for k in order[at : at + MINI]]
            index, value = (np.concatenate(part) for part in ([r[1] for r in batch], [r[2] for r in batch]))
            sizes = np.array([len(r[1]) for r in batch])
            starts, owner = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(batch)), sizes)
            x = value[:, None]
            xv = v[index] * x
            sums = np.add.reduceat(xv, starts)
            margin = w0 + np.add.reduceat(w[index] * value, starts) + 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(xv).sum(1), starts))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - [r[0] for r in batch]
            # Gradients of one feature are summed over the batch.
            touched, place = np.unique(index, return_inverse=True)
            by = np.argsort(place, kind="stable")
            first = np.searchsorted(place[by], np.arange(len(touched)))
            of = error[owner]
            dw = np.add.reduceat((of * value)[by], first) + DECAY * w[touched]
            dv = np.add.reduceat((of[:, None] * x * (sums[owner] - xv))[by], first) + DECAY * v[touched]
            d0 = error.sum()
            g0 += d0 * d0
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w0 -= RATE * d0 / np.sqrt(g0)
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
    return w0, w, v


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled ids that aren't held out, chosen by hash; features are made on the executors.

    Several labels of one id count as their mean; null labels and ids don't count.
    """
    spark = session_of(docs)
    small_batches(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    # At most ``rows`` pairs of numbers.
    wanted = spark.createDataFrame([(r["doc_id"], float(r["label"] >= 0.5)) for r in chosen], "doc_id long, label double")
    # One row for each id: repeated documents don't count more.
    labelled = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(batches: Iterator) -> Iterator:
        make = Featuriser()
        for batch in batches:
            made = [make(t) for t in batch.column("text").to_pylist()]
            columns = {"i": pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()), "x": pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label")} | columns)

    found = labelled.mapInArrow(features, "doc_id long, label double, i binary, x binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    return fit([(r["label"], np.frombuffer(r["i"], "<i4").astype(int), np.frombuffer(r["x"], "<f4").astype(float)) for r in found])


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1). Null texts are scored as empty ones; a column of that name is replaced."""
    spark = session_of(docs)
    small_batches(spark)
    # A fixed number of weights, whatever the input's size.
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make, weights = Featuriser(), shared.value
        for batch in texts:
            yield pa.array(probabilities(weights, map(make, batch.to_pylist())), pa.float64())
    return docs.withColumn(name, scores(text_or_empty()))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Defined cases: null texts are scored as empty ones; equal texts have equal
    scores; a null id counts as an empty one in held_out; repeated rows are
    scored alike; without usable labels every score is one half; an empty table
    gives an empty result; other columns are neither read nor passed on.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; columns, repeated rows and null texts stay as they are. An empty table stays empty."""
    return score(docs, train(docs, labels), "__ql_score").where(F.col("__ql_score") >= KEEP).select(*docs.columns)
