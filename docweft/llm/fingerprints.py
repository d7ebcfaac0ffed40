"""Context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text into chunks wherever its low bits are zero; each chunk gives one of 64 symbols. The
fingerprint is `k:symbols at 2^k:symbols at 2^(k+1)`, where 2^k is the mean chunk length, the smallest that needs at most 64
symbols. Two fingerprints compare by edit distance where they share a chunk length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docweft.llm.shared import buckets_for, small_batches, text_or_empty, written

WINDOW = 7
MOST_SYMBOLS = 64
#: Longer runs of one symbol are cut to this, so that a repeated line does not use up the symbols.
MOST_RUN = 3
SYMBOLS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
#: Random numbers for the 256 bytes, by a fixed seed.
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 32, 256, dtype=np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a mixed 32-bit hash of it and the six before it."""
    own = _BYTES[data]
    rolled = own.copy()
    for back in range(1, min(WINDOW, len(data))):
        rolled[back:] += own[:-back] << np.uint32(3 * back)
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    rolled ^= rolled >> np.uint32(13)
    return rolled


def _symbols(rolled: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    cuts = np.flatnonzero((rolled & np.uint32((1 << k) - 1)) == 0)
    if not len(cuts) or cuts[-1] != len(rolled) - 1:
        cuts = np.append(cuts, len(rolled) - 1)
    chunks = np.diff(sums[cuts], prepend=np.uint64(0))
    found = (chunks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    if len(found) > MOST_RUN:
        same = found[MOST_RUN:] == found[:-MOST_RUN]
        for i in range(1, MOST_RUN):
            same &= found[MOST_RUN:] == found[i : i - MOST_RUN]
        found = found[np.concatenate([np.ones(MOST_RUN, dtype=bool), ~same])]
    return found


def fingerprint(text: str) -> str:
    """The fingerprint of the whole text; the empty text has `0::`. Equal texts have equal fingerprints."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return "0::"
    rolled = _rolling(data)
    sums = np.cumsum(rolled, dtype=np.uint64)
    k = max(0, math.ceil(math.log2(len(data) / MOST_SYMBOLS)))
    found = _symbols(rolled, sums, k)
    if len(found) > MOST_SYMBOLS:
        while len(found) > MOST_SYMBOLS and k < 31:
            k += 1
            found = _symbols(rolled, sums, k)
    else:
        while k and len(finer := _symbols(rolled, sums, k - 1)) <= MOST_SYMBOLS:
            k, found = k - 1, finer
    return f"{k}:{''.join(SYMBOLS[found])}:{''.join(SYMBOLS[_symbols(rolled, sums, k + 1)])}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with one bit per symbol of a (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, symbol in enumerate(a):
        at[symbol] = at.get(symbol, 0) | 1 << i
    every = (1 << len(a)) - 1
    top, up, down, distance = 1 << len(a) - 1, every, 0, len(a)
    for symbol in b:
        equal = at.get(symbol, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        grows, falls = down | ~(horizontal | up) & every, up & horizontal
        distance += bool(grows & top) - bool(falls & top)
        grows, falls = grows << 1 | 1, falls << 1
        up, down = (falls | ~(vertical | grows)) & every, grows & vertical & every
    return distance


def _likeness(a: str, b: str) -> float:
    """1 - distance / longer length, and 0 without a common piece: three symbols, fewer for short ones. Chance alone gives 0.2."""
    least = min(3, 1 + min(len(a), len(b)) // 6)
    pieces = {a[i : i + least] for i in range(len(a) - least + 1)}
    if not any(b[i : i + least] in pieces for i in range(len(b) - least + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1. Equal fingerprints have 1; chunk lengths that differ by more than a factor of two cannot be compared and have 0."""
    if one == other:
        return 1.0
    (k, fine, coarse), (m, fine_too, coarse_too) = one.split(":"), other.split(":")
    apart = int(k) - int(m)
    if apart == 0:
        return max(_likeness(fine, fine_too), _likeness(coarse, coarse_too))
    return _likeness(fine, coarse_too) if apart == 1 else _likeness(coarse, fine_too) if apart == -1 else 0.0


def fingerprinted(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the fingerprint of each whole text; null counts as empty."""
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(fingerprint)

    return docs.withColumn("fingerprint", F.pandas_udf(make, "string")(text_or_empty(column)))


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, part: rows in descending doc_id (null last), those of one id by a hash of the text, dealt to ranges of about equal size.

    Part is the range's number. Ranges are cut at quantiles that Spark finds and cut through repeated rows too.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = rows.withColumns({"__hash": F.xxhash64("text"), "__at": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("doc_id"), F.col("__hash"), F.col("__at")]
    dealt = keyed.repartitionByRange(buckets_for(docs.sparkSession, docs.count(), 20_000), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))


def edited_fingerprints(docs: DataFrame, share: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // share code points replaced by the first as many of the next text (all, if it is
    shorter) in descending doc_id, null last and rows of one id by a hash of the text; after the last comes the first. Null text counts as
    empty. A single row is its own next. Texts are shuffled once, into ranges of doc_id that are gone through in order; a range's
    first row is carried over to the last row of the range before.
    """
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = part = None  # doc_id, text, fingerprint of the row that waits for the next one
        for batch in batches:
            out = []
            for doc_id, text, part in zip(batch["doc_id"], batch["text"], batch["part"]):
                own = fingerprint(text)
                if held is None:
                    out.append((doc_id, *[None] * 6, part, text, False))
                else:
                    out.append((*_compared(*held, text, own, share), part, None, None))
                held = doc_id, text, own
            yield _framed(out)
        if held:
            yield _framed([(held[0], *[None] * 6, part, held[1], True)])

    with small_batches(docs.sparkSession):
        made = written(_in_order(docs).mapInPandas(compare, f"{_DDL}, part int, text string, last boolean"), "fingerprints")
    inside = made.filter("last IS NULL").drop("part", "text", "last")
    heads = made.filter("last = false").select(F.col("part").alias("to"), F.col("text").alias("after"))
    tails = made.filter("last").select("doc_id", "part", "text")
    return inside.unionByName(_over_the_edges(tails, heads, share))


def _over_the_edges(tails: DataFrame, heads: DataFrame, share: int) -> DataFrame:
    """The rows of edited_fingerprints for the last row of each range; the range after the last is the first."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["doc_id"], batch["text"], batch["after"])
            yield _framed([(*_compared(doc_id, text, fingerprint(text), after, fingerprint(after), share), None, None, None) for doc_id, text, after in rows])[_COLUMNS]

    # two columns of integers, one row for each range
    order = Window.orderBy("to")
    ranges = heads.select("to").withColumn("part", F.lag("to").over(order))
    last = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = ranges.select("to", F.coalesce("part", last).alias("part"))
    return tails.join(follows, "part").join(heads, "to").select("doc_id", "text", "after").mapInPandas(compare, _DDL)


def _framed(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[*_COLUMNS, "part", "text", "last"])
    return frame.astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": float, "near_next": float, "part": "Int32", "last": "boolean"})


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _DDL.split(", ")]


def _compared(doc_id: int | None, text: str, own: str, after: str, after_own: str, share: int) -> tuple:
    cut = len(text) // share
    edited = text[: len(text) - cut] + after[:cut]
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, after_own)
