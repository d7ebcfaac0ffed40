"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are sorted by the cells of a grid, as wide as the largest distance of a link, on the leading principal dimensions; where a
cell holds many, by finer cells of the same grid. The sequence is cut into intervals, and intervals are joined recursively: first
on Spark, eight parts at a time, down to tiles; then inside a task, by halves, down to leaves. A pair of intervals whose boxes
or balls are provably too far apart is dropped, one that is provably close enough is linked as a whole, and only what is
left at the leaves is compared vector by vector. A task returns how many links each vector has and a forest that connects what is linked,
never the pairs themselves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.graph import smallest_connected
from docweft.llm.shared import heavy_keys, join_split, numbered, small_batches, written

COSINE = 0.95
#: Leading principal dimensions of the grid. They are fit on a sample of this many vectors; no result depends on it.
GRID, FIT = 8, 4_096
#: Rows and bytes of a tile; rows of a leaf.
TILE_ROWS, TILE_BYTES, LEAF = 4_096, 4 << 20, 256
_FAN = 8
#: Bounds must hold by this much to count as proven; products so near the threshold are worked out anew.
_SURE = 1e-9
_AXES = range(GRID + 1)


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, not all zero, each component a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _packed(vector: Column, kind: str) -> Column:
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, dtype=kind).tobytes() for v in vectors])

    return F.pandas_udf(pack, "binary")(F.when(usable(vector), vector))


def _unpacked(vectors, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)


def principal_axes(vectors: np.ndarray, count: int = GRID) -> np.ndarray:
    """Rows: orthonormal directions of most variance, by subspace iteration without the threaded matrix library."""
    dims = vectors.shape[1]
    count = min(count, dims)
    centred = vectors - vectors.mean(axis=0)
    spread = np.einsum("ij,ik->jk", centred, centred)
    axes = np.random.default_rng(7).normal(size=(count, dims))
    for _ in range(30):
        axes = np.einsum("ij,jk->ik", axes, spread) + 1e-9 * axes
        for i in range(count):  # twice, so that rounding leaves them orthogonal
            for _ in range(2):
                axes[i] -= np.einsum("j,jk->k", np.einsum("jk,k->j", axes[:i], axes[i]), axes[:i])
            length = np.sqrt((axes[i] ** 2).sum())
            axes[i] = axes[i] / length if length > 1e-200 else np.eye(dims)[i]
    return axes if np.abs(np.einsum("ij,kj->ik", axes, axes) - np.eye(count)).max() < 1e-9 else np.eye(dims)[:count]


def _fitted(nodes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Axes by the bytes of a vector, from a sample of FIT vectors; sizes that it lacks use the first components."""
    sample = nodes.select("vector").orderBy(F.xxhash64("vector")).limit(FIT).collect()
    by: dict[int, list[bytes]] = {}
    for row in sample:
        by.setdefault(len(row["vector"]), []).append(bytes(row["vector"]))
    return {size: principal_axes(unit(_unpacked(some, kind))) for size, some in by.items()}


def _coordinates(units: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Along each axis of the grid, and last the length of what the axes leave."""
    found = np.einsum("ij,kj->ik", units, axes) if axes is not None else units[:, :GRID]
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", found, found), 0))
    return np.column_stack([found, np.zeros((len(units), GRID - found.shape[1])), rest])


def _tiles(nodes: DataFrame, fitted: dict[int, np.ndarray], kind: str, width: float) -> DataFrame:
    """Written: size, tile, rows, weights, vectors (binary, in grid order) and the box (lo0, hi0, ...) of each tile.

    A tile has TILE_ROWS vectors, fewer where they are long; vectors of other lengths stand in other tiles.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(fitted)

    def order(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        for size, some in vectors.groupby(vectors.map(len)):
            at = _coordinates(unit(_unpacked(some, kind)), shared.value.get(size))[:, :GRID] / width
            cells = np.concatenate([np.floor(at), np.floor(at * 8)], axis=1).astype(np.int32)
            for i, own in zip(some.index, cells):
                out[i] = own
        return out

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        at = _coordinates(unit(_unpacked(rows["vector"], kind)), shared.value.get(int(key[0])))
        box = {f"{end}{i}": [float(v)] for end, found in (("lo", at.min(axis=0)), ("hi", at.max(axis=0))) for i, v in enumerate(found)}
        return pd.DataFrame({"size": [key[0]], "tile": [key[1]], "rows": [rows["node"].to_numpy("<i8").tobytes()], "weights": [rows["n"].to_numpy("<i8").tobytes()],
                             "vectors": [b"".join(rows["vector"])], **box})

    ordered = written(nodes.select("node", "n", "vector", F.octet_length("vector").cast("long").alias("size"), F.pandas_udf(order, "array<int>")("vector").alias("cells")), "cells")
    rows = F.greatest(F.lit(64), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_BYTES) / F.col("size"))))
    placed = numbered(ordered, "size", ["cells", "vector"]).withColumn("tile", F.floor(F.col("idx") / rows).cast("long"))
    ddl = "size long, tile long, rows binary, weights binary, vectors binary, " + ", ".join(f"{end}{i} double" for end in ("lo", "hi") for i in _AXES)
    return written(placed.select("size", "tile", "idx", "node", "n", "vector").groupBy("size", "tile").applyInPandas(tile, ddl), "tiles")


def _pairs(tiles: DataFrame, width: float) -> DataFrame:
    """Written: size, a, b (a <= b) of the tiles whose boxes are not provably further apart than width, found from coarse intervals down."""
    zones = written(tiles.drop("rows", "weights", "vectors"), "zones")
    most = zones.agg(F.max("tile")).first()[0] or 0
    depth = 0
    while most >= _FAN**depth:
        depth += 1
    pairs = zones.select("size").distinct().select("size", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    parts = lambda c: F.sequence(F.col(c) * _FAN, F.col(c) * _FAN + _FAN - 1)
    for level in reversed(range(depth)):
        part = F.floor(F.col("tile") / _FAN**level).cast("long")
        boxes = zones.groupBy("size", part.alias("at")).agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in _AXES], *[F.max(f"hi{i}").alias(f"hi{i}") for i in _AXES])
        boxes = written(boxes, "boxes")
        of = lambda side: boxes.select("size", F.col("at").alias(side), *[F.col(f"{end}{i}").alias(f"{side}_{end}{i}") for end in ("lo", "hi") for i in _AXES])
        finer = pairs.select("size", F.explode(parts("a")).alias("a"), "b").select("size", "a", F.explode(parts("b")).alias("b")).filter("a <= b")
        met = finer.join(of("a"), ["size", "a"]).join(of("b"), ["size", "b"])
        gap = [F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")) for i in _AXES]
        pairs = written(met.filter(reduce(lambda x, y: x + y, [g * g for g in gap]) <= width * width + _SURE).select("size", "a", "b"), "pairs")
    return pairs


class _Intervals:
    """The rows of a tile, and the box and the ball of each of its intervals."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray | None, offset: int):
        self.units, self.raw, self.offset = unit(raw), raw, offset
        self.coordinates, self.known = _coordinates(self.units, axes), {}

    def bounds(self, start: int, end: int):
        if (start, end) not in self.known:
            at, own = self.coordinates[start:end], self.units[start:end]
            centre = own.mean(axis=0)
            away = own - centre
            self.known[start, end] = at.min(axis=0), at.max(axis=0), centre, float(np.sqrt(np.einsum("ij,ij->i", away, away).max()))
        return self.known[start, end]


class _Linker:
    """Joins intervals of one or two tiles: links of each row, and labels of what they connect."""

    def __init__(self, weights: np.ndarray, cosine: float):
        self.weights, self.cosine, self.width = weights, cosine, float(np.sqrt(2 - 2 * cosine))
        self.links, self.labels = np.zeros(len(weights), dtype=np.int64), np.arange(len(weights))

    def join(self, one: _Intervals, a: tuple[int, int], other: _Intervals, b: tuple[int, int]) -> None:
        (lo_a, hi_a, mid_a, far_a), (lo_b, hi_b, mid_b, far_b) = one.bounds(*a), other.bounds(*b)
        gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
        apart = float(np.sqrt(((mid_a - mid_b) ** 2).sum()))
        if (gap**2).sum() > self.width**2 + _SURE or apart - far_a - far_b > self.width + _SURE:
            return
        same = one is other and a == b
        if apart + far_a + far_b < self.width - _SURE:
            self._all(one.offset + a[0], one.offset + a[1], other.offset + b[0], other.offset + b[1], same)
        elif a[1] - a[0] > LEAF or b[1] - b[0] > LEAF:
            for x in _halves(a):
                for y in _halves(b):
                    if not same or x <= y:
                        self.join(one, x, other, y)
        else:
            self._compare(one, a, other, b, same)

    def _all(self, a: int, a_end: int, b: int, b_end: int, same: bool) -> None:
        if same:
            self.links[a:a_end] += self.weights[a:a_end].sum() - self.weights[a:a_end]
        else:
            self.links[a:a_end] += self.weights[b:b_end].sum()
            self.links[b:b_end] += self.weights[a:a_end].sum()
        self._unite(np.r_[a:a_end, b:b_end], np.full(a_end - a + b_end - b, a))

    def _compare(self, one: _Intervals, a: tuple[int, int], other: _Intervals, b: tuple[int, int], same: bool) -> None:
        near = one.units[a[0] : a[1]] @ other.units[b[0] : b[1]].T
        linked = near >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(near - self.cosine) < 1e-12)):
            x, y = one.raw[a[0] + i], other.raw[b[0] + j]
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            linked[i, j] = (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= self.cosine
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        i, j = np.nonzero(linked)
        i, j = i + one.offset + a[0], j + other.offset + b[0]
        np.add.at(self.links, i, self.weights[j])
        if not same:
            np.add.at(self.links, j, self.weights[i])
        self._unite(i, j)

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        """Every linked pair gets one label, the smallest of those that meet."""
        while True:
            x, y = self.labels[i], self.labels[j]
            if not (x != y).any():
                return
            least, most = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.labels, most, least)
            while (on := self.labels[self.labels] != self.labels).any():
                self.labels[on] = self.labels[self.labels[on]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what has one label: each row of it, in order, to the one at half its place, so that none has many."""
        order = np.argsort(self.labels, kind="stable")
        own = self.labels[order]
        first = np.searchsorted(own, own)
        place = np.arange(len(own)) - first
        there = place > 0
        return order[there], order[(first + (place - 1) // 2)[there]]


def _halves(span: tuple[int, int]) -> list[tuple[int, int]]:
    start, end = span
    if end - start <= LEAF:
        return [span]
    middle = start + -(-(end - start) // (2 * LEAF)) * LEAF
    return [(start, middle), (middle, end)]


def _joined(tiles: DataFrame, pairs: DataFrame, fitted: dict, kind: str, cosine: float) -> DataFrame:
    """Written: x, y, edge: either how many links (y) a node (x) has in a pair of tiles, or an edge of a forest over linked nodes."""
    shared = tiles.sparkSession.sparkContext.broadcast(fitted)

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile")
        axes = shared.value.get(int(key[0]))
        nodes, weights = (np.frombuffer(b"".join(rows[c]), dtype="<i8") for c in ("rows", "weights"))
        parts, offset = [], 0
        for own, vectors in zip(rows["rows"], rows["vectors"]):
            count = len(own) // 8
            parts.append(_Intervals(np.frombuffer(vectors, dtype=kind).reshape(count, -1).astype(np.float64), axes, offset))
            offset += count
        linker = _Linker(weights, cosine)
        linker.join(parts[0], (0, len(parts[0].raw)), parts[-1], (0, len(parts[-1].raw)))
        there = np.flatnonzero(linker.links)
        child, parent = linker.forest()
        return pd.DataFrame({
            "x": np.concatenate([nodes[there], nodes[child]]), "y": np.concatenate([linker.links[there], nodes[parent]]),
            "edge": np.concatenate([np.zeros(len(there), dtype=bool), np.ones(len(child), dtype=bool)])})

    sides = pairs.select("size", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    payload = tiles.select("size", "tile", "rows", "weights", "vectors")
    return written(sides.join(payload, ["size", "tile"]).groupBy("size", "a", "b").applyInPandas(join, "x long, y long, edge boolean"), "joined")


def near_vectors(table: DataFrame, cosine: float = COSINE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per row of table: `key`, n_links, component_id, kept.

    Two vectors are linked when they have the same number of components and their cosine in double precision is at least
    `cosine` (above 0); n_links counts the other rows linked directly. component_id is the smallest key that links reach, and kept says
    whether that is the row's own. Rows whose vector is null, empty or zero or holds a null or a number that is not finite
    link with nothing. Repeated rows are rows of their own, linked with each other, and kept alike. A null key comes last: the component is null where all keys
    are. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    with small_batches(table.sparkSession, 10_000):
        return _near_vectors(table, cosine, vector, key)


def _near_vectors(table: DataFrame, cosine: float, vector: str, key: str) -> DataFrame:
    kind = "<f4" if table.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    plain = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    rows = written(table.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), _packed(plain, kind).alias("vector")), "vectors")
    found = rows.filter("vector IS NOT NULL")
    nodes = written(found.groupBy("vector").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("key").alias("least")), "nodes")
    total, width = nodes.count(), float(np.sqrt(2 - 2 * cosine))
    fitted = _fitted(nodes, kind)
    tiles = _tiles(nodes, fitted, kind, max(width, 1e-6))
    joined = _joined(tiles, _pairs(tiles, width), fitted, kind, cosine)
    links = joined.filter("NOT edge").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("links"))
    classes = smallest_connected(joined.filter("edge").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("row", "node")
    known = nodes.join(links, "node", "left").join(classes, "node", "left")
    known = written(known.select("vector", "n", "least", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    of = join_split(known, least, "class", heavy_keys(known, "class", total)).select("vector", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = join_split(found, of, "vector", heavy_keys(found, "vector", found.count())).select("key", "n_links", "component_id")
    alone = rows.filter("vector IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
