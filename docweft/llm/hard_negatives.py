"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve through the components of most variance, and cut into blocks, one
Parquet row each. A block's zone map holds the least and the largest value of every component and label. Interval arithmetic on an
anchor and a zone map bounds the scores that the block can hold, so an anchor's window (which labels, and from which score to
which) reads only the blocks whose bounds meet it. The blocks of the highest bounds are read first; what they give raises the windows'
lower ends, and the rest is chosen by those. Anchors go in groups, zone maps in pages with a box of their own, which are compared first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.llm.shared import numbered, small_batches, written

#: Components and bits of each on the Hilbert curve, and how many vectors its cuts are fit on; no result depends on them.
CURVE, BITS, FIT = 16, 3, 4_096
#: Rows of a block and of a group of anchors (fewer where vectors are long), zone maps of a page, blocks that a group reads first.
BLOCK, GROUP, PAGE, FIRST = 2_048, 512, 256, 8
_BYTES = 4 << 20


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double; null where the vector or a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of cells (0 to 2^bits - 1 along each dimension) on the Hilbert curve, by Skilling's transform."""
    x = [c.astype(np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            turn = (x[i] & q) > 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turn, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros(len(cells), dtype=np.int64), top
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    place = np.zeros(len(cells), dtype=np.int64)
    for bit in reversed(range(bits)):
        for own in x:
            place = place << 1 | ((own ^ flip) >> bit & 1)
    return place


def _matrix(vectors, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)


def _cuts(rows: DataFrame, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the bytes of a vector: the components of most variance, and the quantiles that cut each, from a sample of FIT vectors."""
    by: dict[int, list[bytes]] = {}
    for row in rows.select("vector").orderBy(F.xxhash64("vector")).limit(FIT).collect():
        by.setdefault(len(row["vector"]), []).append(bytes(row["vector"]))
    found = {}
    for size, some in by.items():
        own = _matrix(some, kind)
        most = np.argsort(-own.var(axis=0), kind="stable")[:CURVE]
        found[size] = most, np.quantile(own[:, most], np.arange(1, 1 << BITS) / (1 << BITS), axis=0)
    return found


def _placed(rows: DataFrame, kind: str) -> DataFrame:
    """Written: rows with size (bytes of the vector) and place on the curve."""
    shared = rows.sparkSession.sparkContext.broadcast(_cuts(rows, kind))

    def place(vectors: pd.Series) -> pd.Series:
        out = pd.Series(0, index=vectors.index, dtype="int64")
        for size, some in vectors.groupby(vectors.map(len)):
            if size in shared.value:  # else all stand at one place
                most, cuts = shared.value[size]
                own = _matrix(some, kind)[:, most]
                out.loc[some.index] = hilbert((own[:, None, :] > cuts[None]).sum(axis=1))
        return out

    return written(rows.select("*", F.octet_length("vector").cast("long").alias("size"), F.pandas_udf(place, "long")("vector").alias("place")), "placed")


def _chunk(most: int) -> Column:
    """How many vectors of their size go together."""
    return F.greatest(F.lit(16), F.least(F.lit(most), F.floor(F.lit(_BYTES) / F.greatest(F.lit(1), F.col("size")))))


def _blocks(placed: DataFrame, kind: str) -> DataFrame:
    """Written: size, block, its rows (binary columns in order of the curve), and its zone map: lo, hi (binary doubles), label_lo, label_hi."""
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        own = _matrix(rows["vector"], kind)
        return pd.DataFrame({
            "size": [key[0]], "block": [key[1]], "rows": [rows["row"].to_numpy("<i8").tobytes()], "ids": [rows["key"].fillna(0).to_numpy("<i8").tobytes()],
            "no_id": [rows["key"].isna().to_numpy(np.uint8).tobytes()], "labels": [rows["label"].to_numpy("<i8").tobytes()], "vectors": [b"".join(rows["vector"])],
            "lo": [own.min(axis=0).tobytes()], "hi": [own.max(axis=0).tobytes()], "label_lo": [rows["label"].min()], "label_hi": [rows["label"].max()]})

    ddl = "size long, block long, rows binary, ids binary, no_id binary, labels binary, vectors binary, lo binary, hi binary, label_lo long, label_hi long"
    numbered_ = numbered(placed, "size", ["label", "place", "row"]).withColumn("block", F.floor(F.col("idx") / _chunk(BLOCK)).cast("long"))
    return written(numbered_.select("size", "block", "idx", "row", "key", "label", "vector").groupBy("size", "block").applyInPandas(block, ddl), "blocks")


def _pages(blocks: DataFrame) -> DataFrame:
    """Written: the zone maps, PAGE to a row in order of their blocks, and the box (box_lo, box_hi) that holds them."""
    def page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        lo, hi = (_matrix(rows[c], "<f8") for c in ("lo", "hi"))
        return pd.DataFrame({
            "size": [key[0]], "page": [key[1]], "blocks": [rows["block"].to_numpy("<i8").tobytes()], "lo": [lo.tobytes()], "hi": [hi.tobytes()],
            "label_lo": [rows["label_lo"].to_numpy("<i8").tobytes()], "label_hi": [rows["label_hi"].to_numpy("<i8").tobytes()],
            "box_lo": [lo.min(axis=0)], "box_hi": [hi.max(axis=0)]})

    ddl = "size long, page long, blocks binary, lo binary, hi binary, label_lo binary, label_hi binary, box_lo array<double>, box_hi array<double>"
    zones = blocks.select("size", "block", "lo", "hi", "label_lo", "label_hi", F.floor(F.col("block") / PAGE).cast("long").alias("page"))
    return written(zones.groupBy("size", "page").applyInPandas(page, ddl), "pages")


def _groups(anchors: DataFrame, windows: DataFrame, count: int, kind: str) -> DataFrame:
    """Written: the anchors (size, group, row, label, vector) that have windows (row, w < count, low, high), a group to a row, with their box and range."""
    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = _matrix(rows["vector"], kind)
        low, high = (rows[[f"{end}{w}" for w in range(count)]].to_numpy(np.float64) for end in ("low", "high"))
        return pd.DataFrame({
            "size": [key[0]], "group": [key[1]], "anchors": [rows["row"].to_numpy("<i8").tobytes()], "own_labels": [rows["label"].to_numpy("<i8").tobytes()],
            "own": [own.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()], "least": [float(np.nanmin(low))], "most": [float(np.nanmax(high))],
            "own_lo": [own.min(axis=0)], "own_hi": [own.max(axis=0)]})

    ends = [F.max(F.when(F.col("w") == w, F.col(end))).alias(f"{end}{w}") for end in ("low", "high") for w in range(count)]
    ddl = "size long, group long, anchors binary, own_labels binary, own binary, low binary, high binary, least double, most double, own_lo array<double>, own_hi array<double>"
    return written(anchors.join(windows.groupBy("row").agg(*ends), "row").groupBy("size", "group").applyInPandas(group, ddl), "groups")


def _readable(groups: DataFrame, pages: DataFrame, count: int, same: bool) -> DataFrame:
    """size, group, block, bound: the blocks that a window of the group must read, and the largest score that any of them can find there."""
    def choose(batches):
        for batch in batches:
            for g in batch.to_dict("records"):
                labels = np.frombuffer(g["own_labels"], dtype="<i8")
                own, low, high = (np.frombuffer(g[c], dtype="<f8").reshape(len(labels), -1) for c in ("own", "low", "high"))
                lo, hi = (np.frombuffer(g[c], dtype="<f8").reshape(-1, own.shape[1]) for c in ("lo", "hi"))
                label_lo, label_hi, blocks = (np.frombuffer(g[c], dtype="<i8") for c in ("label_lo", "label_hi", "blocks"))
                above, below = np.maximum(own, 0), np.minimum(own, 0)
                most, least = above @ hi.T + below @ lo.T, above @ lo.T + below @ hi.T
                if same:
                    fits = (label_lo[None] <= labels[:, None]) & (labels[:, None] <= label_hi[None])
                else:
                    fits = (label_lo[None] != labels[:, None]) | (label_hi[None] != labels[:, None])
                met = np.zeros_like(fits)
                for w in range(count):
                    met |= (most >= low[:, w, None]) & (least <= high[:, w, None])
                need = fits & met
                there = need.any(axis=0)
                bound = np.where(need, most, -np.inf).max(axis=0, initial=-np.inf)
                yield pd.DataFrame({"size": g["size"], "group": g["group"], "block": blocks[there], "bound": bound[there]})

    def product(pick: str) -> Column:
        """The least or the largest inner product of a vector of the group's box and one of the page's."""
        corners = lambda a, b: [a["lo"] * b["lo"], a["lo"] * b["hi"], a["hi"] * b["lo"], a["hi"] * b["hi"]]
        one = F.arrays_zip(F.col("own_lo").alias("lo"), F.col("own_hi").alias("hi"))
        other = F.arrays_zip(F.col("box_lo").alias("lo"), F.col("box_hi").alias("hi"))
        each = F.zip_with(one, other, lambda a, b: getattr(F, pick)(*corners(a, b)))
        return F.aggregate(each, F.lit(0.0), lambda x, y: x + y)

    boxes = groups.select("size", "group", "own_lo", "own_hi", "least", "most").join(pages.select("size", "page", "box_lo", "box_hi"), "size")
    pairs = boxes.filter((product("greatest") >= F.col("least")) & (product("least") <= F.col("most"))).select("size", "group", "page")
    met = pairs.join(groups.drop("own_lo", "own_hi", "least", "most"), ["size", "group"]).join(pages.drop("box_lo", "box_hi"), ["size", "page"])
    return met.select("size", "group", "own_labels", "own", "low", "high", "blocks", "lo", "hi", "label_lo", "label_hi").mapInPandas(choose, "size long, group long, block long, bound double")


def _read(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, kind: str, count: int, same: bool, best: int) -> DataFrame:
    """Written: row, w, other, other_id, score: what the windows of the groups find in the blocks, at most `best` for each window and block."""
    def find(batches):
        for batch in batches:
            for g in batch.to_dict("records"):
                anchors, labels, rows, ids, others = (np.frombuffer(g[c], dtype="<i8") for c in ("anchors", "own_labels", "rows", "ids", "labels"))
                own, low, high = (np.frombuffer(g[c], dtype="<f8").reshape(len(labels), -1) for c in ("own", "low", "high"))
                no_id = np.frombuffer(g["no_id"], dtype=np.uint8)
                scores = own @ np.frombuffer(g["vectors"], dtype=kind).reshape(len(rows), -1).astype(np.float64).T
                ok = (labels[:, None] == others[None]) == same
                ok &= anchors[:, None] != rows[None]
                for w in range(count):
                    inside = ok & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                    if inside.shape[1] > best:
                        limit = -np.partition(np.where(inside, -scores, np.inf), best - 1, axis=1)[:, best - 1]
                        inside &= scores >= limit[:, None]
                    i, j = np.nonzero(inside)
                    order = np.lexsort((rows[j], ids[j], no_id[j], -scores[i, j], i))
                    i, j = i[order], j[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < best
                    i, j = i[first], j[first]
                    yield pd.DataFrame({"row": anchors[i], "w": np.int32(w), "other": rows[j], "other_id": pd.Series(ids[j], dtype="Int64").mask(no_id[j] > 0), "score": scores[i, j].astype(np.int64)})

    met = pairs.select("size", "group", "block").join(groups.drop("own_lo", "own_hi", "least", "most"), ["size", "group"])
    met = met.join(blocks.select("size", "block", "rows", "ids", "no_id", "labels", "vectors"), ["size", "block"])
    spread = met.repartition(F.col("size"), F.col("group"), F.col("block"))
    return written(spread.mapInPandas(find, "row long, w int, other long, other_id long, score long"), "found")


def _best(found: DataFrame, best: int) -> DataFrame:
    by = Window.partitionBy("row", "w").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= best)


def _searched(anchors: DataFrame, windows: DataFrame, blocks: DataFrame, pages: DataFrame, kind: str, count: int, same: bool, best: int) -> DataFrame:
    """Written: row, w, other, other_id, score, rank: the first `best` rows in each window (row, w, low, high) of the anchors.

    Rows of the anchor's label (same) or of other labels, never the anchor's own, with a score in the window; higher scores first, then smaller ids.
    """
    groups = _groups(anchors, windows, count, kind)
    order = Window.partitionBy("size", "group").orderBy(F.desc("bound"), "block")
    first = written(_readable(groups, pages, count, same).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= FIRST).drop("at"), "first")
    found = _read(groups, blocks, first, kind, count, same, best)
    full = _best(found, best).filter(F.col("rank") == best).select("row", "w", F.col("score").cast("double").alias("least"))
    raised = written(windows.join(full, ["row", "w"], "left").select("row", "w", F.greatest("low", "least").alias("low"), "high"), "windows")
    again = _groups(anchors, raised, count, kind)
    rest = written(_readable(again, pages, count, same).join(first.select("size", "group", "block"), ["size", "group", "block"], "left_anti"), "rest")
    more = _read(again, blocks, rest, kind, count, same, best)
    return written(_best(found.unionByName(more), best), "best")


def hard_negatives(
    table: DataFrame, anchor: Column, vector: str = "embedding", key: str = "vec_id", label: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x counts as floor(scale * x); a row's score is its inner product with the anchor, exact below 2^53. Rows rank by
    score, highest first, then by key (null last). An anchor's positives are its first `positives` other rows of its label; for each, the
    negatives are the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score,
    ranked from 1. anchor: which rows are anchors (null: none). Rows with a null label or vector, an empty vector, or a null or non-finite
    component take no part; vectors of different lengths don't meet. Repeated rows are rows of their own, so a copy of an anchor is its positive, and
    repeated anchors have repeated results. An empty table gives an empty result; other columns are ignored.
    """
    with small_batches(table.sparkSession):
        return _hard_negatives(table, anchor, vector, key, label, scale, positives, negatives, low, high)


def _hard_negatives(
    table: DataFrame, anchor: Column, vector: str, key: str, label: str, scale: int, positives: int, negatives: int, low: int, high: int,
) -> DataFrame:
    numbers = whole_numbers(F.col(vector), scale)
    plain = table.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), numbers.alias("vector"))
    plain = plain.filter("label IS NOT NULL AND size(vector) > 0")
    largest = plain.select(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    kind = "<i2" if (largest or 0) < 32_768 else "<f8"

    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=np.float64).astype(kind).tobytes() for v in vectors])

    placed = _placed(written(plain.withColumn("vector", F.pandas_udf(pack, "binary")("vector")), "candidates"), kind)
    blocks = _blocks(placed, kind)
    pages = _pages(blocks)
    chosen = numbered(written(placed.filter("anchor"), "anchors"), "size", ["label", "place", "row"])
    anchors = written(chosen.select("size", F.floor(F.col("idx") / _chunk(GROUP)).cast("long").alias("group"), "row", "key", "label", "vector"), "anchors")
    everything = anchors.select("row", F.lit(0).alias("w"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    near = _searched(anchors.drop("key"), everything, blocks, pages, kind, 1, True, positives)
    near = near.select("row", (F.col("rank") - 1).alias("w"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers: the least and the largest score inside the window
    ends = near.select("row", "w", F.ceil(F.col("positive_score") * low / 100).cast("double").alias("low"), F.floor(F.col("positive_score") * high / 100).cast("double").alias("high"))
    mined = _searched(anchors.drop("key"), ends.filter("low <= high"), blocks, pages, kind, positives, False, negatives)
    out = mined.select("row", "w", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(near, ["row", "w"]).join(anchors.select("row", F.col("key").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
