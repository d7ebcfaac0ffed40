"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target number of words. A document's place is a hash of its id and text; a source takes documents in the
order of that hash until its budget is met. The threshold is found without sorting: words are summed by source and the
leading bits of the hash, and only the bucket in which the budget ends is looked at again with the next bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.llm.shared import SPACES, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS, STEP_BITS = 60, 12


def word_count(column: str = "text") -> Column:
    """Number of runs of characters other than blanks and the control characters 9 to 13; null text has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def place(seed: str) -> Column:
    """60 bits of a hash of seed, doc_id and text. Repeated rows share their place and are taken or left together."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Per source: source_key, source, source_size, target.

    Targets share `share` of all words by weight (weights repeat over the sources in code point order, null last), but stop at
    `most` times the source's words; the excess goes to the others by weight. In the order of cap per weight the capped sources
    come first, so running sums settle it in one pass over the short source table.
    """
    sums = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("cap_ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumns({
        "cap": F.col("source_size") * float(most), "cap_ratio": F.col("source_size") * float(most) / F.col("weight"),
        "budget": F.sum("source_size").over(everything) * share, "all_weight": F.sum("weight").over(everything)})
    capped = weighted.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "spent": F.coalesce(F.sum("weight").over(before), F.lit(0.0))}).withColumn(
        "capped", F.col("cap") * (F.col("all_weight") - F.col("spent")) <= (F.col("budget") - F.col("caps")) * F.col("weight"))
    rest = (F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return capped.select("source_key", "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * rest).alias("target"))


def _narrow(sizes: DataFrame, states: DataFrame, used: int) -> DataFrame:
    """One step: states (source_key, budget, prefix, below, cut) of open sources, with `used` bits of prefix known, get the next bits.

    below: words before the prefix; cut: the last hash that is taken, set as soon as the bucket has a single hash.
    """
    shift = HASH_BITS - used - STEP_BITS
    open_ = states.filter("cut IS NULL").drop("cut")
    inside = sizes.join(open_, "source_key").filter(F.shiftright("hash", HASH_BITS - used) == F.col("prefix"))
    counts = inside.groupBy("source_key", "budget", "below", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
    along = Window.partitionBy("source_key").orderBy("bucket")
    summed = counts.withColumn("upto", F.col("below") + F.sum("words").over(along))
    over = summed.filter(F.col("upto") > F.col("budget")).groupBy("source_key").agg(F.min_by(F.struct("bucket", "words", "upto", "first", "last"), "bucket").alias("b"))
    found = open_.join(over, "source_key", "left")
    before = F.col("b.upto") - F.col("b.words")
    nearer = F.col("b.upto") - F.col("budget") < F.col("budget") - before
    cut = F.when(F.col("b").isNull(), F.lit((1 << HASH_BITS) - 1)).when(
        F.col("b.first") == F.col("b.last"), F.when(nearer, F.col("b.last")).otherwise(F.col("b.first") - 1))
    return states.filter("cut IS NOT NULL").unionByName(
        found.select("source_key", "budget", F.col("b.bucket").alias("prefix"), before.alias("below"), cut.alias("cut")))


def _limits(docs: DataFrame, weights: Sequence[int], share: float, most: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The documents without their texts, and per source: source_key, source_size, target, whole, budget, cut."""
    sizes = written(docs.select("doc_id", "source", _source_key().alias("source_key"), word_count().alias("size"), place(seed).alias("hash")), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets").withColumn(
        "whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)))
    states = targets.select(
        "source_key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("cut"))
    for used in range(0, HASH_BITS, STEP_BITS):
        states = written(_narrow(sizes, states, used), "thresholds")
        if states.filter("cut IS NULL").isEmpty():
            break
    # written, so that its size is known: Spark broadcasts it where that allows, and then shuffles no texts
    return sizes, written(targets.drop("source").join(states.select("source_key", "budget", "cut"), "source_key"), "limits")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def _times(most: int) -> Column:
    extra = F.when((F.col("budget") > 0) & (F.col("hash") <= F.col("cut")), 1).otherwise(0)
    return F.least(F.col("whole") + extra, F.lit(most)).cast("int")


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, times (0 to `most`), taken (words).

    A target of k times the source's words and a rest takes every document k times, and those up to the threshold once more.
    The document at the threshold is taken if that brings the source nearer to its target, so a source misses its target by at
    most half of one document (or of one set of repeated rows). Null text has size 0; null sources are one source, the last. An
    empty table gives an empty result; other columns are ignored.
    """
    sizes, limits = _limits(docs, weights, share, most, seed)
    return sizes.join(limits, "source_key").withColumn("times", _times(most)).select(
        "doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as many times as the mixture takes it; all columns stay.

    Texts are joined with the short table of source limits alone; a document's place is computed again.
    """
    _, limits = _limits(docs, weights, share, most, seed)
    limits = limits.select(F.col("source_key").alias("__key"), "whole", "budget", "cut").withColumnsRenamed({"whole": "__whole", "budget": "__budget", "cut": "__cut"})
    extra = F.when((F.col("__budget") > 0) & (F.col("__hash") <= F.col("__cut")), 1).otherwise(0)
    chosen = docs.withColumns({"__hash": place(seed), "__source": _source_key()}).join(limits, F.col("__source") == F.col("__key"))
    times = F.least(F.col("__whole") + extra, F.lit(most)).cast("int")
    return chosen.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)
