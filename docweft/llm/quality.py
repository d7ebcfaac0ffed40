"""Quality classifier by importance resampling.

Two generative models over hashed word and word-pair features, one of target texts (labelled good, not toxic) and one of all raw
texts, give each document the log ratio of its probabilities. The ratio itself grows with a document's length, so the draw weighs a
document by exp(SHARPNESS * mean log ratio of its features): without replacement, by Gumbel top-k, the k largest sums of the exponent and
Gumbel noise. The noise is a hash of the document, so reruns agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.shared import numbered, small_batches, text_key, text_or_empty, written

BUCKET_BITS = 16
#: Most bitmaps (4 KB each, of 32,768 neighbouring doc_ids) that are broadcast to tell target documents; beyond that they are joined.
MOST_BITMAPS = 4_096
#: k is set so that this share of the target documents set aside from fitting is drawn.
KEEP_TARGET = 0.995
#: Log ratios are means over a document's features times this; it sets how much the Gumbel noise may change the order.
SHARPNESS = 200.0
#: Feature counts of the target model are smoothed towards the raw model by so many features.
SMOOTHING = 50_000.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE_MOST = 100_000


class _Features:
    """Buckets of a text's words and word pairs; a bounded cache holds the hashes of words seen."""

    def __init__(self, bits: int):
        self.shift, self.cache = np.uint64(64 - bits), {}

    def __call__(self, text: str) -> Iterator[np.ndarray]:
        """The whole text in stretches of about a million characters, cut between words; pairs over a cut count too."""
        cache, last = self.cache, None
        for words in _word_stretches(text):
            if len(cache) > _CACHE_MOST:
                cache.clear()
            hashes = [] if last is None else [last]
            for word in words:
                value = cache.get(word)
                if value is None:
                    digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    value = cache[word] = int.from_bytes(digest, "little")
                hashes.append(value)
            own = np.array(hashes, dtype=np.uint64)
            pairs = (own[:-1] * _PAIR + own[1:]) * _MIX
            yield (np.concatenate([own[last is not None :] * _MIX, pairs]) >> self.shift).astype(np.int64)
            last = hashes[-1] if hashes else None


def _word_stretches(text: str, most: int = 200_000) -> Iterator[list[str]]:
    words: list[str] = []
    if len(text) < most:
        words = _TOKEN.findall(text.lower())
        if words:
            yield words
        return
    for found in _TOKEN.finditer(text.lower()):
        words.append(found[0])
        if len(words) == most:
            yield words
            words = []
    if words:
        yield words


def _fits(key: str) -> Column:
    return F.xxhash64(F.lit("target"), key) % 2 == 0


def target_sample(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled good and not toxic, by hash half of them to fit the target model, half to set the threshold."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.select(F.col("doc_id").alias("__target"), _fits("doc_id").alias("__fit"))


def marked_targets(docs: DataFrame, labels: DataFrame, most: int = MOST_BITMAPS) -> DataFrame:
    """docs with `__fit`: true for target documents to fit by, false for those set aside, null for others.

    Target ids that lie close enough together are broadcast as bitmaps, however many they are, so that no text is shuffled; ids too far
    apart for that are joined as Spark sees fit. Both are exact.
    """
    targets = target_sample(labels)
    if dict(targets.dtypes)["__target"] == dict(docs.dtypes)["doc_id"] == "bigint":
        bucket, at = F.shiftright("__target", 15).alias("__bucket"), F.col("__target").bitwiseAND(F.lit(32_767))
        maps = written(targets.groupBy(bucket).agg(F.bitmap_construct_agg(at).alias("__bits")), "targets")
        if maps.count() <= most:
            met = docs.withColumn("__bucket", F.shiftright("doc_id", 15)).join(F.broadcast(maps), "__bucket", "left")
            low = F.col("doc_id").bitwiseAND(F.lit(32_767))
            byte = F.conv(F.hex(F.substring("__bits", F.shiftright(low, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            there = F.coalesce(F.getbit(byte, low.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
            return met.withColumn("__fit", F.when(there, _fits("doc_id"))).drop("__bits", "__bucket")
    return docs.join(targets, F.col("doc_id") == F.col("__target"), "left").drop("__target")


def fit_ratio(docs: DataFrame, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target / raw) per bucket. docs: text and fits (true for target texts); raw is all rows.

    Tasks count into two arrays of 2^bits; Spark sums them, and the driver gets 2^bits rows.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, raw, target = _Features(bits), np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for text, fits in zip(batch["text"], batch["fits"]):
                for there in features(text):
                    counts = np.bincount(there, minlength=1 << bits) if len(there) > 1 << bits else None
                    for total in (raw, target)[: 1 + bool(fits)]:
                        if counts is None:
                            np.add.at(total, there, 1)
                        else:
                            total += counts
        there = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": there.astype(np.int32), "raw": raw[there], "target": target[there]})

    cells = docs.select("text", "fits").mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(1 << bits, 0.5), np.zeros(1 << bits)
    for bucket, n, of_target in cells:
        raw[bucket] += n
        target[bucket] = of_target
    share = raw / raw.sum()
    return np.log((target + smoothing * share) / (target.sum() + smoothing)) - np.log(share)


def scored(docs: DataFrame, ratio: np.ndarray, bits: int = BUCKET_BITS) -> DataFrame:
    """docs with log_ratio (of the whole text) and n_features; a text without words has 0 and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, weights = _Features(bits), shared.value
        for batch in texts:
            sums, sizes = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int64)
            for row, text in enumerate(batch):
                for there in features(text):
                    sums[row] += weights[there].sum()
                    sizes[row] += len(there)
            yield pd.DataFrame({"log_ratio": sums, "n_features": sizes})

    score_udf = F.pandas_udf(score, "log_ratio double, n_features long")
    rest = [c for c in docs.columns if c != "text"]
    return docs.withColumn("__s", score_udf(text_or_empty())).select(*rest, "__s.log_ratio", "__s.n_features")


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise from a hash of seed, doc_id and text."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_k(rows: DataFrame, k: int, key: str = "key", most: int = 10_000) -> DataFrame:
    """rows (a written table with doc_id, text_key and a double key) with kept: true for exactly k rows of largest key.

    Counts over 1,024 equal stretches of the key find the stretch in which the k-th row lies; the search goes on inside until it
    holds `most` rows or one key. Only those rows are ordered, by (key, doc_id, text_key), in ranges, so that one key may have any number.
    """
    lo, hi, above = *rows.agg(F.min(key), F.max(key)).first(), 0
    if lo is None:
        return rows.withColumn("kept", F.lit(False))
    value = F.col(key)
    while True:
        inside = rows.filter((value >= lo) & (value <= hi))
        width = (hi - lo) / 1024
        if width == 0 or lo + width == lo:
            break
        stretch = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(1023))
        counts = inside.groupBy(stretch.alias("s")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).orderBy(F.desc("s")).collect()
        if sum(r["n"] for r in counts) <= most:
            break
        for r in counts:
            if above + r["n"] >= k:
                lo, hi = r["a"], r["b"]
                break
            above += r["n"]
        else:
            return rows.withColumn("kept", F.lit(True))
    order = numbered(written(inside.withColumns({"__group": F.lit(""), "__falling": -value}), "edge"), "__group", ["__falling", "doc_id", "text_key"])
    edge = order.withColumn("kept", F.col("idx") < k - above).select(*rows.columns, "kept")
    return rows.filter(value > hi).withColumn("kept", F.lit(True)).unionByName(edge).unionByName(rows.filter(value < lo).withColumn("kept", F.lit(False)))


def importance_resampled(docs: DataFrame, labels: DataFrame, keep_target: float = KEEP_TARGET, k: int | None = None, seed: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, log_ratio, n_features, key, kept, text_key.

    key is SHARPNESS times the mean log ratio of the document's features, plus Gumbel noise; the k largest keys are drawn. Without
    k, k is the number of documents at or above the key that the share keep_target of the target documents set aside from
    fitting reach, so good documents stay whatever share of the table they are. Null text counts as empty; a text without words
    has a mean of 0. Equal rows get equal keys and are cut by no order but that of repeated rows. Without labelled targets
    every document is kept. An empty table gives an empty result; other columns are ignored.
    """
    marked = marked_targets(docs.select("doc_id", text_or_empty().alias("text")), labels)
    mean = F.col("log_ratio") / F.greatest("n_features", F.lit(1))
    with small_batches(docs.sparkSession):
        ratio = fit_ratio(marked.withColumn("fits", F.coalesce("__fit", F.lit(False))))
        rows = scored(marked.withColumn("text_key", text_key()), ratio)
        rows = written(rows.withColumn("key", mean * SHARPNESS + gumbel(seed)), "scored")
    if k is None:
        aside = rows.filter("__fit = false").agg(F.percentile_approx("key", 1 - keep_target, 100_000).alias("q")).first()["q"]
        if aside is None:
            return rows.drop("__fit").withColumn("kept", F.lit(True))
        k = rows.filter(F.col("key") >= aside).count()
    return top_k(rows.drop("__fit"), k)
