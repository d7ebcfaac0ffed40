"""Near-duplicate detection by improved consistent weighted sampling (ICWS) over TF-IDF weighted word shingles.

1. One pass counts in how many documents the shingles of each hash bucket occur; that gives the idf part of the weights.
2. A second pass draws each text's weighted samples, cuts them into bands, and keeps short signatures. Texts of equal words are
   one node from here on.
3. Nodes that share a band are a bucket. Each meets one node of its bucket (a star); pairs whose signatures agree well enough are
   verified by exact weighted Jaccard similarity.
4. Where a bucket still holds several classes, the nodes outside its largest class meet all others there, in blocks of bounded
   size; a block verifies likely pairs until they are united and gives only the links that unite classes. A pair is looked at in
   the first of the bands it shares, not in each.
5. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docweft.llm.graph import smallest_connected
from docweft.llm.shared import heavy_keys, join_split, keep_rows, small_batches, text_key, text_or_empty, written

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 two texts share a band with probability 1 - (1 - 0.8^4)^20 = 0.99998.
BANDS, ROWS = 20, 4
#: Pairs are verified if this share of their samples agrees; at a similarity of 0.8 that fails for 4 in 10,000, of 0.85 never.
LIKELY = 0.65
_LEFT, _RIGHT = 128, 512
IDF_BITS = 16
#: Shingles in this share of the rows or less are all equally rare. The counts of a bucket's other shingles, its usual load, are taken off
#: first, so that the weight of a shingle depends on its share of the rows alone, however many rows there are.
RAREST = 1 / 256
IDF_LEVELS, TF_LEVELS = 8, 8
_SAMPLES = BANDS * ROWS
_CHUNK = 1024
_BYTE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Tell apart the numbers drawn from one hash.
_SECOND, _THIRD = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)
#: Bytes of a text hashed at a time, cut at blanks; tables of powers and temporary arrays stay so short. No hash depends on it.
_STRETCH = 1 << 17


#: The longest powers asked for so far; shorter ones are their beginnings.
_longest: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """_BYTE^j and its inverse for j < size, or for more j."""
    if not _longest or len(_longest[0][0]) < size:
        up, down = np.full(size, _BYTE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _longest[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _longest[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text; words are runs of bytes above 32."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found, start = [], 0
    while start < len(data):
        end = min(len(data), start + _STRETCH)
        while end < len(data) and data[end] > 32:  # cut at the next blank, looked for a stretch at a time
            blanks = np.flatnonzero(data[end : end + _STRETCH] <= 32)
            end = end + int(blanks[0]) if len(blanks) else min(len(data), end + _STRETCH)
        piece = data[start:end]
        inside = piece > 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        up, down = _powers(1 << max(10, (len(piece)).bit_length()))
        sums = np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], dtype=np.uint64)
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        found.append(_mixed((sums[last - 1] - before) * down[first]))
        start = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def content_hash(words: np.ndarray) -> int:
    """A hash of the word sequence: the sum of words[j] * _BYTE^j and their number, mixed; as a signed 64-bit number."""
    up, total = _powers(_STRETCH)[0], len(words)
    for at in range(0, len(words), _STRETCH):
        part = words[at : at + _STRETCH]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BYTE), at, 1 << 64)
    return int(_mixed(np.array([total % (1 << 64)], dtype=np.uint64))[0].astype(np.int64))


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `width` words; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        total = total * _BYTE + words[i : i + count]
    return _mixed(total)


def _weights() -> np.ndarray:
    """Weight of each level (idf level times TF_LEVELS plus tf level): 1 to 1.5 for rarity, times 1 + log2(tf) / 2.

    Shingles of a large group of near copies are common, so rarity may not count for much, or an edit would count for more in a
    large group than in a small one.
    """
    idf, tf = np.divmod(np.arange(IDF_LEVELS * TF_LEVELS), TF_LEVELS)
    return (1 + idf / (IDF_LEVELS - 1) / 2) * (1 + tf / 2)


@cache
def _factors() -> np.ndarray:
    """An odd multiplier for each sample."""
    return np.random.default_rng(20240202).integers(0, 1 << 63, _SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def leveled(found: np.ndarray, idf_level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, sorted, and the weight level of each."""
    own, times = np.unique(found, return_counts=True)
    tf = np.minimum(np.frexp(times)[1] - 1, TF_LEVELS - 1)
    return own, idf_level[own >> np.uint64(64 - IDF_BITS)].astype(np.int64) * TF_LEVELS + tf


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers between 0 and 1, both excluded."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def weighted_samples(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """One ICWS sample per hash: the shingle and step t of the smallest ln a, hashed.

    ICWS draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) for each shingle and sample; for a weight w, t = floor(ln w / r + b),
    ln y = r (t - b) and ln a = ln c - ln y - r. With v the shingle's weight where it occurs once, that is the same law as three
    Exp(1) numbers p, q, s taken from a hash of shingle and sample: c = p + q, r = ln(c / p) + s, and b such that ln y = ln v - s at v.
    Then a = p / v at v, and at w = v m it is exp(-r k) p / v with k = floor((ln m + s) / r) steps more. So among shingles that
    occur once and have one v the smallest hash wins, and of others only those that can still win, p exp(-s) < a v m, are worked out.
    """
    factors, weights, h = _factors(), _weights(), _mixed(own)
    least, best = np.full(_SAMPLES, np.inf), np.zeros(_SAMPLES, dtype=np.uint64)
    idf, tf = np.divmod(levels, TF_LEVELS)
    once = np.flatnonzero(tf == 0)
    once = once[np.argsort(idf[once].astype(np.uint8), kind="stable")]
    low = np.full((IDF_LEVELS, _SAMPLES), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(once), _CHUNK):
        part = idf[once[at : at + _CHUNK]]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        smallest = np.minimum.reduceat(h[once[at : at + _CHUNK], None] * factors, first, axis=0)
        low[part[first]] = np.minimum(low[part[first]], smallest)
    there = np.unique(idf[once])
    if len(there):
        a = -np.log1p(-_unit(low[there])) / weights[there * TF_LEVELS, None]
        at = a.argmin(axis=0)
        least, best = a.min(axis=0), low[there[at], np.arange(_SAMPLES)]
    again, start, size = np.flatnonzero(tf), 0, 64
    while start < len(again):
        some = again[start : start + size]
        start, size = start + size, min(4 * size, _CHUNK)
        hashed = h[some, None] * factors
        p, s = _unit(hashed), _unit(_mixed(hashed ^ _SECOND))  # -ln(1 - p) is never less than p
        i, j = np.nonzero(p * s < least * weights[levels[some], None])
        if not len(i):
            continue
        p, s, q, own_hash = -np.log1p(-p[i, j]), -np.log(s[i, j]), -np.log(_unit(_mixed(hashed[i, j] ^ _THIRD))), hashed[i, j]
        r = np.log1p(q / p) + s
        k = np.floor((np.log(1 + tf[some[i]] / 2) + s) / r)
        a = p / weights[idf[some[i]] * TF_LEVELS] * np.exp(-r * k)
        order = np.lexsort((a, j))
        order = order[np.diff(j[order], prepend=-1) > 0]  # the smallest a of each sample
        order = order[a[order] < least[j[order]]]
        least[j[order]] = a[order]
        best[j[order]] = own_hash[order] + k[order].astype(np.uint64) * _BYTE
    return best


def idf_levels(docs: DataFrame) -> np.ndarray:
    """The level of each hash bucket of shingles, from document counts over all rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(1 << IDF_BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, np.unique(shingles(word_hashes(text))) >> np.uint64(64 - IDF_BITS), 1)
                rows += 1
        there = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(there, -1).astype(np.int32), "n": np.append(total[there], rows)})

    cells = docs.select(text_or_empty().alias("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts, rows = np.zeros(1 << IDF_BITS), 1
    for bucket, n in cells:
        if bucket < 0:
            rows = max(1, n)
        else:
            counts[bucket] = n
    return levels_by_share(counts, rows)


def levels_by_share(counts: np.ndarray, rows: int) -> np.ndarray:
    """Levels from the number of rows that each bucket's shingles occur in: 0 for all rows, the highest for the share RAREST or less."""
    usual = np.median(counts)
    share = np.clip((counts - usual) / rows, RAREST, 1)
    return np.rint(np.log(share) / np.log(RAREST) * (IDF_LEVELS - 1)).astype(np.uint8)


def signed_rows(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """Written: row, doc_id, text_key, content (hash of the word sequence), signature (16 bits a sample), bands (none without words), also as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        idf = shared.value
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _BYTE
        for batch in batches:
            contents, signatures, bands = [], [], []
            for text in batch:
                words = word_hashes(text)
                contents.append(content_hash(words))
                if not len(words):
                    signatures.append(b"")
                    bands.append(np.zeros(0, dtype=np.int64))
                    continue
                best = weighted_samples(*leveled(shingles(words), idf))
                signatures.append((_mixed(best) >> np.uint64(48)).astype("<u2").tobytes())
                mixed = salt.copy()
                for part in best.reshape(BANDS, ROWS).T:
                    mixed = _mixed(mixed ^ part)
                bands.append(mixed.astype(np.int64))
            yield pd.DataFrame({"content": contents, "signature": signatures, "bands": bands, "all_bands": [b.astype("<i8").tobytes() for b in bands]})

    sign_udf = F.pandas_udf(sign, "content long, signature binary, bands array<long>, all_bands binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key().alias("text_key"), sign_udf(text_or_empty()).alias("s"))
    return written(rows.select("row", "doc_id", "text_key", "s.*"), "signatures")


def _sets(docs: DataFrame, nodes: DataFrame, levels: np.ndarray) -> DataFrame:
    """row, set: the shingles of the nodes' texts as sorted 64-bit numbers, the level in the lowest six bits."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def collect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                own, level = leveled(shingles(word_hashes(text)), shared.value)
                out.append(((own & ~np.uint64(63)) | level.astype(np.uint64)).astype("<u8").tobytes())
            yield pd.Series(out)

    keyed = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"), text_key().alias("key"))
    # a merge join at every size: texts are shuffled once, in proportion to the input, however many nodes there are
    met = keyed.hint("merge").join(nodes.select("row", "doc_id", "text_key"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
    return met.select("row", F.pandas_udf(collect, "binary")("text").alias("set")).groupBy("row").agg(F.first("set").alias("set"))


def weighted_jaccard(one: bytes, other: bytes) -> float:
    weights = _weights()
    a, b = np.frombuffer(one, dtype="<u8"), np.frombuffer(other, dtype="<u8")
    wa, wb = weights[(a & np.uint64(63)).astype(np.int64)], weights[(b & np.uint64(63)).astype(np.int64)]
    _, i, j = np.intersect1d(a >> np.uint64(6), b >> np.uint64(6), assume_unique=True, return_indices=True)
    common = np.minimum(wa[i], wb[j]).sum()
    return float(common / max(wa.sum() + wb.sum() - common, 1e-12))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Written: the pairs (a, b) whose weighted Jaccard similarity is at least `similarity`, and that similarity."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.array([weighted_jaccard(x, y) for x, y in zip(batch["one"], batch["other"])])
            keep = near >= similarity
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep], "near": near[keep]})

    one = sets.select(F.col("row").alias("a"), F.col("set").alias("one"))
    other = sets.select(F.col("row").alias("b"), F.col("set").alias("other"))
    return written(pairs.join(one, "a").join(other, "b").mapInPandas(compare, "a long, b long, near double"), "links")


def _samples(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype="<u2").reshape(len(signatures), _SAMPLES)


def likely_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least the share LIKELY."""
    def agree(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series((_samples(one) == _samples(other)).sum(axis=1) >= LIKELY * _SAMPLES)

    one = signatures.select(F.col("row").alias("a"), F.col("signature").alias("one"))
    other = signatures.select(F.col("row").alias("b"), F.col("signature").alias("other"))
    return pairs.join(one, "a").join(other, "b").filter(F.pandas_udf(agree, "boolean")("one", "other")).select("a", "b")


def _blocks(members: DataFrame, classes: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several classes, dealt into blocks (band, l, r) of nodes outside the largest class (left) and all nodes.

    members: band, row; more: row and the columns that a block needs. A block has about _LEFT by _RIGHT rows.
    """
    labelled = members.join(classes, "row", "left").select("band", "row", F.coalesce("class", "row").alias("class"))
    labelled = written(labelled, "labelled")
    sizes = labelled.groupBy("band", "class").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("band").agg(F.sum("n").alias("all"), F.count("*").alias("classes"), F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("of_main"))
    open_ = whole.filter("classes > 1").select("band", "main", F.ceil((F.col("all") - F.col("of_main")) / _LEFT).alias("lefts"), F.ceil(F.col("all") / _RIGHT).alias("rights"))
    rows = join_split(labelled, open_, "band", heavy_keys(labelled, "band", labelled.count())).join(more, "row")
    spot, columns = F.xxhash64("row"), ["band", "class", *more.columns]
    right = rows.select(*columns, F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod(spot, "rights").alias("r"), F.lit(False).alias("left"))
    left = rows.filter("class <> main").select(
        *columns, F.pmod(spot, "lefts").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"), F.lit(True).alias("left"))
    return right.unionByName(left)


def _likely_in(band: int, classes: np.ndarray, left: np.ndarray, samples: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs of different classes in a block that are likely and share no band before this one, and their agreeing samples."""
    one, other = np.flatnonzero(left), np.flatnonzero(~left)
    pairs = [np.zeros((3, 0), dtype=np.int64)]
    for i in one if len(other) else ():
        agree = (samples[other] == samples[i]).sum(axis=1)
        met = np.flatnonzero((agree >= LIKELY * _SAMPLES) & (classes[other] != classes[i]))
        if len(met):
            met = met[(bands[other[met]] == bands[i]).argmax(axis=1) == (bands[i] == band).argmax()]
            pairs.append(np.stack([np.full(len(met), i), other[met], agree[met]]))
    i, j, agree = np.concatenate(pairs, axis=1)
    return i, j, agree


def _each_block(batches: Iterator[pd.DataFrame], work: Callable[..., None], done: Callable[[], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Goes through sorted rows block by block; a block may go over the end of a batch. done: what the blocks of a batch have given."""
    held = None
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        keys = rows[["band", "l", "r"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ends = [*starts[1:].tolist(), len(rows)]
        whole = len(starts) if batch is None else len(starts) - 1
        if whole:
            until = ends[whole - 1]
            samples = _samples(rows["signature"][:until])
            bands = np.frombuffer(b"".join(rows["all_bands"][:until]), dtype="<i8").reshape(until, BANDS)
            columns = {c: rows[c].to_numpy()[:until] for c in rows.columns if c not in ("signature", "all_bands")}
            for start, end in zip(starts[:whole].tolist(), ends[:whole]):
                own = {c: x[start:end] for c, x in columns.items()}
                i, j, agree = _likely_in(int(keys[start, 0]), own["class"], own["left"], samples[start:end], bands[start:end])
                if len(i):
                    work(own, i, j, agree)
            yield done()
        held = None if batch is None else rows.iloc[starts[-1] :]


def _in_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(F.col("band"), F.col("l"), F.col("r")).sortWithinPartitions("band", "l", "r")


def _rows_with_likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: list[np.ndarray] = []

    def done() -> pd.DataFrame:
        rows = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        found.clear()
        return pd.DataFrame({"row": rows})

    return _each_block(batches, lambda own, i, j, _: found.append(own["row"][np.concatenate([i, j])]), done)


def _uniting(similarity: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple[int, int, float]] = []

        def unite(own: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> None:
            rows, classes, sets = own["row"], own["class"], own["set"]
            over: dict[int, int] = {}

            def top(c: int) -> int:
                while over.setdefault(c, c) != c:
                    over[c] = c = over.setdefault(over[c], over[c])
                return c

            for at in np.argsort(-agree, kind="stable"):
                x, y = int(i[at]), int(j[at])
                one, other = top(int(classes[x])), top(int(classes[y]))
                if one != other and (near := weighted_jaccard(sets[x], sets[y])) >= similarity:
                    over[one] = other
                    links.append((min(rows[x], rows[y]), max(rows[x], rows[y]), near))

        def done() -> pd.DataFrame:
            made = pd.DataFrame(links, columns=["a", "b", "near"]).astype({"a": np.int64, "b": np.int64, "near": float})
            links.clear()
            return made

        return _each_block(batches, unite, done)

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, links, kept, text_key.

    Two texts are linked when their weighted Jaccard similarity over shingles of five words (lower case) is at least
    `similarity`; texts of equal words belong together in any case, so all null, empty and blank texts are one class. A class is
    what links connect; class_id is its smallest doc_id (null last), whose row is kept, and of repeated rows one. links is the
    number of verified links of the text to other texts, enough of them to connect the class but not all that exist within it. Texts of fewer than five words are one shingle. An empty table gives an empty result; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, similarity)


def _near_duplicates(docs: DataFrame, similarity: float) -> DataFrame:
    levels = idf_levels(docs)
    rows = signed_rows(docs, levels)
    copies = written(rows.groupBy("content").agg(F.min("row").alias("node"), F.count("*").alias("n")).filter("n > 1"), "copies").drop("n")
    others = rows.select("row", "content").join(copies, "content").filter("row <> node").select("row")
    nodes = rows.join(others, "row", "left_anti")
    banded = written(nodes.select("row", F.explode("bands").alias("band")), "bands")
    star = F.min(F.struct(F.xxhash64("band", "row").alias("mark"), F.col("row").alias("star")))["star"]
    stars = written(banded.groupBy("band").agg(F.count("*").alias("n"), star.alias("star")).filter("n > 1"), "stars")
    members = written(banded.join(stars, "band").select("band", "row", "star"), "members")
    signatures = rows.select("row", "signature", "all_bands")
    pairs = members.filter("row <> star").select(F.least("row", "star").alias("a"), F.greatest("row", "star").alias("b")).distinct()
    pairs = written(likely_pairs(pairs, signatures), "pairs")
    members, ends = members.select("band", "row"), pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    also = _in_blocks(_blocks(members, smallest_connected(pairs), signatures)).mapInPandas(_rows_with_likely, "row long")
    involved = written(ends.unionByName(also).distinct().join(rows.select("row", "doc_id", "text_key"), "row"), "involved")
    sets = written(_sets(docs, involved, levels), "sets")
    links = verified(pairs, sets, similarity)
    inside = _blocks(members.join(involved.select("row"), "row", "left_semi"), smallest_connected(links), signatures.join(sets, "row"))
    uniting = _in_blocks(inside).mapInPandas(_uniting(similarity), "a long, b long, near double").groupBy("a", "b").agg(F.max("near").alias("near"))
    links = links.unionByName(written(uniting, "links"))
    return _classes(rows, copies, links)


def _classes(rows: DataFrame, copies: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    of_node = smallest_connected(links).withColumnRenamed("row", "node").join(ends, "node")
    ids, total = rows.select("row", "doc_id", "text_key", "content"), rows.count()
    nodes = join_split(ids, copies, "content", heavy_keys(ids, "content", total), "left")
    nodes = written(nodes.select("row", "doc_id", "text_key", F.coalesce("node", "row").alias("node")), "nodes")
    known = written(join_split(nodes, of_node, "node", heavy_keys(nodes, "node", total), "left").select("row", "doc_id", "text_key", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    several = known.groupBy("class").agg(first, F.count("*").alias("class_size")).filter("class_size > 1")
    joined = join_split(known, several, "class", heavy_keys(known, "class", total), "left")
    one = F.col("first").isNull()
    return joined.select(
        "doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "links", (one | (F.col("row") == F.col("first.row"))).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; all columns stay."""
    return keep_rows(docs, near_duplicates(docs, similarity))
