"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a 60-bit hash of its id and text. A source's share is met
by taking each document a whole number of times, and once more where its hash
is at or below the source's threshold. The threshold is found on histograms:
words are summed by source and by the hash's first 12 bits, the bucket in
which the budget runs out is found on running sums, and only that bucket's
rows are summed again by their next 12 bits, until one hash is left. Nothing
is sorted but histograms of at most 4096 rows a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.llm.common import number_rows, save, text_or_empty

#: What separates words: space, and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
REPEATS = 2
BITS, LEVEL = 60, 12
#: Up to so many sources, the thresholds are broadcast (about 40 bytes each); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """The number of words in ``text``.

    Turning every word into one letter and dropping the rest leaves a string as long as the count.
    """
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text: the same on every run, whatever the rows' order."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__ql_size`` (words) and ``__ql_hash``."""
    text = text_or_empty()
    return docs.withColumns({"__ql_size": word_count(text), "__ql_hash": document_hash(F.col("doc_id"), text)})


def source_plan(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """A row for each source: source, source_size, weight, target.

    Sources are ranked by code point, null last, and take the weights in turn.
    A target is the lesser of the cap and weight times a level; the level at
    which the targets sum to the budget is found by rounds of sums over the
    source table, in which a capped source stays capped.
    """
    sizes = slim.groupBy("source").agg(F.sum("__ql_size").alias("source_size"))
    ranked = number_rows(sizes, ["source"], "__ql_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__ql_rank") % len(weights) + 1).cast("int"))
    ranked = save(ranked.withColumn("weight", weight).drop("__ql_rank"))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left, free, level, capped = budget * (total or 0), all_weights or 0.0, 0.0, -1
    while free and left > 0:
        level = left / free
        is_capped = F.col("source_size") * float(REPEATS) <= F.col("weight") * F.lit(level)
        n, taken, weight_sum = ranked.where(is_capped).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if n == capped:
            break
        capped, left, free = n, budget * total - REPEATS * (taken or 0), all_weights - (weight_sum or 0.0)
    target = F.least(F.col("source_size") * float(REPEATS), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


def thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``__ql_times`` and ``__ql_upto``: how often all documents are taken, and the hash up to which once more.

    ``slim`` has source, __ql_size and __ql_hash. A group of rows with one and
    the same hash (repeated rows) is taken or left as a whole.
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(REPEATS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = save(plan.withColumn("__ql_times", whole).withColumn("__ql_left", F.col("target") - F.col("__ql_times") * F.col("source_size")))
    found, rows = [], slim.select("source", "__ql_size", "__ql_hash")
    # __ql_before: words below the bucket under refinement; __ql_prefix: the hash bits that name it.
    edge = plan.where("__ql_left > 0").select("source", "__ql_left", F.lit(0).cast("long").alias("__ql_before"), F.lit(0).cast("long").alias("__ql_prefix"))
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        prefix = F.shiftright("__ql_hash", shift)
        sums = rows.groupBy("source", prefix.alias("__ql_bucket")).agg(F.sum("__ql_size").alias("__ql_sum"), F.min("__ql_hash").alias("__ql_low"), F.max("__ql_hash").alias("__ql_high"))
        here = edge.select(F.col("source").alias("__ql_source"), "__ql_left", "__ql_before")
        running = sums.withColumn("__ql_cum", F.sum("__ql_sum").over(Window.partitionBy("source").orderBy("__ql_bucket")))
        running = running.join(here, F.col("source").eqNullSafe(F.col("__ql_source"))).withColumn("__ql_cum", F.col("__ql_cum") + F.col("__ql_before"))
        # The first bucket whose running sum reaches the budget; targets are below the source's size here, so there is one.
        place = F.row_number().over(Window.partitionBy("source").orderBy("__ql_bucket"))
        first = running.where("__ql_cum >= __ql_left").withColumn("__ql_place", place).where("__ql_place = 1")
        edge = save(first.select("source", "__ql_left", (F.col("__ql_cum") - F.col("__ql_sum")).alias("__ql_before"), F.col("__ql_bucket").alias("__ql_prefix"), "__ql_cum", "__ql_low", "__ql_high"))
        # One hash is left in the bucket: take it if that comes nearer to the budget.
        upto = F.when(F.col("__ql_cum") - F.col("__ql_left") < F.col("__ql_left") - F.col("__ql_before"), F.col("__ql_high")).otherwise(F.col("__ql_low") - 1)
        found.append(edge.where("__ql_low = __ql_high").select("source", upto.alias("__ql_upto")))
        edge = edge.where("__ql_low < __ql_high").select("source", "__ql_left", "__ql_before", "__ql_prefix")
        if shift == 0 or edge.isEmpty():
            break
        inside = edge.select(F.col("source").alias("__ql_source"), F.col("__ql_prefix"))
        rows = save(rows.join(inside, F.col("source").eqNullSafe(F.col("__ql_source")) & (prefix == F.col("__ql_prefix"))).select("source", "__ql_size", "__ql_hash"))
    upto = found[0]
    for more in found[1:]:
        upto = upto.unionByName(more)
    upto = upto.select(F.col("source").alias("__ql_source"), "__ql_upto")
    joined = plan.join(upto, F.col("source").eqNullSafe(F.col("__ql_source")), "left")
    return save(joined.select("source", "source_size", "target", "__ql_times", F.coalesce("__ql_upto", F.lit(-1)).alias("__ql_upto")))


def apply_thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, __ql_size and __ql_hash) with __ql_ss, __ql_target and __ql_copies."""
    small = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnsRenamed({"source": "__ql_source", "source_size": "__ql_ss", "target": "__ql_target"})
    joined = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("__ql_source")))
    return joined.withColumn("__ql_copies", F.col("__ql_times") + (F.col("__ql_hash") <= F.col("__ql_upto")).cast("long"))


def mix_columns(joined: DataFrame) -> DataFrame:
    """The result's columns from the internal ones."""
    out = {"size": F.col("__ql_size"), "source_size": F.col("__ql_ss"), "target": F.col("__ql_target"), "taken": F.col("__ql_size") * F.col("__ql_copies")}
    joined = joined.withColumns(out)
    return joined.select(*[c for c in joined.columns if not c.startswith("__ql_")])


def _joined(docs: DataFrame, weights: tuple[float, ...], budget: float) -> DataFrame:
    rows = keyed(docs)
    slim = save(rows.select("source", "__ql_size", "__ql_hash"))
    return apply_thresholds(rows, thresholds(slim, source_plan(slim, weights, budget)))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """All of ``docs``, with size, source_size, target and taken (words; 0, 1 or 2 times the size).

    Defined cases: a null text has size 0; a null source is a source of its
    own, ranked last; repeated rows are taken alike; an empty table gives an
    empty result; input columns named as a result column are replaced.
    """
    return mix_columns(_joined(docs, weights, budget))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    return _joined(docs, weights, budget).where("__ql_copies > 0").withColumn("__ql_copies", F.explode(F.expr("sequence(1, __ql_copies)"))).select(*docs.columns)
