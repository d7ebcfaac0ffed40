"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language inside the tasks, a bounded number of languages at a time, and sums them by Spark. The
log-probability matrix is broadcast, SLICE languages at a time, so its size is bounded however many languages there are; batches of texts are scored
in numpy as one sparse matrix: the rows of the matrix that their n-grams name are gathered and summed up to each text's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.shared import heavy_keys, join_split, small_batches, written

_OTHER = re.compile(r"[\W\d_]+")
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Languages in one broadcast matrix (128 x 65,536 float32 numbers are 34 MB), and in one task's counts. More are scored slice by slice.
SLICE = 128
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash, one per position.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Texts are gone through in pieces of so many characters; pieces overlap, so that no n-gram is lost.
_PIECE = 1 << 20


def _grams(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a lower-cased text, its runs of non-letters read as one blank each."""
    words = f" {_OTHER.sub(' ', text.lower()).strip()} "
    for start in range(0, len(words), _PIECE):
        codes = np.frombuffer(words[start : start + _PIECE + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        own = min(_PIECE, len(words) - start)
        for n in ORDERS:
            count = min(own, len(codes) - n + 1)
            if count <= 0:
                continue
            mixed = np.full(count, n, dtype=np.uint64)
            for i in range(n):
                mixed += codes[i : i + count] * _FACTORS[i]
            mixed ^= mixed >> np.uint64(29)
            yield ((mixed * _FACTORS[3]) >> np.uint64(64 - bits)).astype(np.int64)


def counted(labelled: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Written: lang, bucket, n of all rows of labelled (text, lang); rows without lang are left out."""
    buckets = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for lang, n in sums.items():
                there = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": there.astype(np.int32), "n": n[there]})
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if lang not in sums:
                    if len(sums) >= SLICE:
                        yield from flushed()
                    sums[lang] = np.zeros(buckets, dtype=np.int64)
                for grams in _grams(text or "", bits):
                    if len(grams) < buckets:
                        np.add.at(sums[lang], grams, 1)
                    else:
                        sums[lang] += np.bincount(grams, minlength=buckets)
            if len(sums) == 0:
                yield pd.DataFrame({"lang": pd.Series(dtype=object), "bucket": pd.Series(dtype=np.int32), "n": pd.Series(dtype=np.int64)})
        yield from flushed()

    cells = labelled.filter("lang IS NOT NULL").select("text", "lang").mapInPandas(count, "lang string, bucket int, n long")
    return written(cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")


def log_matrix(cells: DataFrame, languages: list[str], bits: int = BUCKET_BITS) -> np.ndarray:
    """float32 log P(bucket | language), a row per language; languages weigh alike whatever their share of the rows."""
    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "buckets": [rows["bucket"].to_numpy("<i4").tobytes()], "counts": [rows["n"].to_numpy("<i8").tobytes()]})

    matrix = np.ones((len(languages), 1 << bits))
    place = {lang: i for i, lang in enumerate(languages)}
    own = cells.filter(F.col("lang").isin(languages)) if languages else cells.filter("false")
    for row in own.groupBy("lang").applyInPandas(packed, "lang string, buckets binary, counts binary").toLocalIterator():
        matrix[place[row["lang"]], np.frombuffer(row["buckets"], dtype="<i4")] += np.frombuffer(row["counts"], dtype="<i8")
    return np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def train(labelled: DataFrame, bits: int = BUCKET_BITS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their whole log_matrix, for models of few languages."""
    cells = counted(labelled, bits)
    languages = [row["lang"] for row in cells.select("lang").distinct().orderBy("lang").collect()]
    return languages, log_matrix(cells, languages, bits)


def log_sums(texts: Iterable[str | None], weights: np.ndarray, bits: int = BUCKET_BITS, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For each text its log-likelihoods (a column per language) and number of n-grams; none for null and texts without a letter.

    n-grams of many texts are laid end to end, and the matrix rows they name, at most about `most` numbers at a time, are summed between the texts' ends.
    """
    texts, most = list(texts), max(1 << 12, most // max(1, weights.shape[1]))
    sums, totals = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), dtype=np.int64)
    held, owners, size = [], [], 0

    def add() -> None:
        if not held:
            return
        grams = np.concatenate(held)
        ends = np.cumsum([len(h) for h in held])
        found = np.add.reduceat(weights[grams], np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)
        np.add.at(sums, owners, found)
        np.add.at(totals, owners, [len(h) for h in held])
        held.clear()
        owners.clear()

    for row, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            continue
        for grams in _grams(text, bits):
            held.append(grams)
            owners.append(row)
            size += len(grams)
            if size >= most:
                add()
                size = 0
    add()
    return sums, totals


def _tempered(sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return sums / np.sqrt(np.maximum(1.0, totals))[:, None]


def predicted(docs: DataFrame, languages: list[str], matrix: np.ndarray, bits: int = BUCKET_BITS) -> DataFrame:
    """docs (any columns, among them text) with lang_pred and score.

    score is the posterior probability of the predicted language under equal priors, after dividing the log-likelihoods by the
    square root of the number of n-grams, since neighbouring n-grams are far from independent. Null texts, texts without a letter,
    and any text when nothing was learned get `und` and 0. Ties go to the first language in order.
    """
    scored = docs.select(*docs.columns, _slice_scores(docs, languages, matrix, bits).alias("__s"))
    sure = F.col("__s.relative")
    return scored.select(*docs.columns, F.col("__s.lang").alias("lang_pred"), F.when(F.col("__s.lang") == UNKNOWN, 0.0).otherwise(1.0 / sure).alias("score"))


def _slice_scores(docs: DataFrame, languages: list[str], matrix: np.ndarray, bits: int) -> Column:
    """Struct per text: the best language of the slice, its tempered log-likelihood, and the sum of the others' relative to it."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))
    names = np.array([*languages, UNKNOWN], dtype=object)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            if not languages:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(batch), "top": np.nan, "relative": np.nan})
                continue
            sums, totals = log_sums(batch, shared.value, bits)
            logs = _tempered(sums, totals)
            best = np.where(totals > 0, logs.argmax(axis=1), len(languages))
            top = logs.max(axis=1)
            yield pd.DataFrame({"lang": names[best], "top": np.where(totals > 0, top, np.nan), "relative": np.exp(logs - top[:, None]).sum(axis=1)})

    return F.pandas_udf(predict, "lang string, top double, relative double")(F.col("text"))


def _predicted_by_slices(docs: DataFrame, cells: DataFrame, languages: list[str], bits: int = BUCKET_BITS) -> DataFrame:
    """predicted() for any number of languages: texts are scored against one slice after another, equal texts once, and the best of all is taken."""
    digest = F.sha1(F.coalesce("text", F.lit(""))).alias("__digest")
    scores = []
    for at in range(0, len(languages), SLICE):
        own = languages[at : at + SLICE]
        score = docs.select(digest, _slice_scores(docs, own, log_matrix(cells, own, bits), bits).alias("s"))
        one = score.groupBy("__digest").agg(F.first("s").alias("s")).filter(F.col("s.lang") != UNKNOWN)
        scores.append(written(one.select("__digest", F.struct("s.top", F.lit(-at).alias("first"), "s.lang", "s.relative").alias("s")), "slice"))
    every = scores[0]
    for more in scores[1:]:
        every = every.unionByName(more)
    gathered = every.groupBy("__digest").agg(F.collect_list("s").alias("all")).withColumn("best", F.array_max("all"))
    total = F.aggregate("all", F.lit(0.0), lambda sum_, s: sum_ + s["relative"] * F.exp(s["top"] - F.col("best.top")))
    known = written(gathered.select("__digest", F.col("best.lang").alias("lang_pred"), (1.0 / total).alias("score")), "known")
    rows = written(docs.select(*[c for c in docs.columns if c != "text"], digest), "rows")
    met = join_split(rows, known, "__digest", heavy_keys(rows, "__digest", rows.count()), "left")
    return met.drop("__digest").fillna({"lang_pred": UNKNOWN, "score": 0.0}, subset=["lang_pred", "score"])


def held_out(column: str = "doc_id") -> Column:
    """A null doc_id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == 2


def identified(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Learns from the rows that are not held out; repeated rows count.

    With more than SLICE languages texts are scored against one slice of them after another; results do not depend on it.
    """
    keyed = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    with small_batches(docs.sparkSession):
        cells = counted(keyed.filter("NOT held_out"))
        names = written(cells.select("lang").distinct().orderBy("lang"), "languages")
        languages = sorted(row["lang"] for row in names.toLocalIterator())
        rest = keyed.select("doc_id", "held_out", "text")
        if len(languages) <= SLICE:
            return predicted(rest, languages, log_matrix(cells, languages)).drop("text")
        return _predicted_by_slices(rest, cells, languages)
