"""Packing by cutting-stock column generation.

Pieces of documents are counted by length. A linear program over patterns (how many pieces of each length share one
sequence) is solved by column generation: its duals price the lengths, and a knapsack dynamic program finds the pattern that pays
most. Patterns are used a whole number of times, what is left over is packed best-fit on the counts, and the pieces, ranked within
their length, take the places of the patterns in order. Short pieces are first packed by their exact lengths into bundles, in the same
way, and a bundle then counts as a piece; longer ones are rounded up to units. The driver sees counts of lengths and patterns only, both of
bounded number.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docweft.llm.shared import numbered, text_or_empty, written

CAPACITY = 4096
END_ID = 2
#: The linear program is solved to within this share of its bound.
GAP = 0.001
#: The first steps of a tokenizer whose pieces can be looked up: composed, white space to blanks, lower case; then cut by this pattern, then bytes.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for texts that are composed, made of Latin letters without special case rules, digits, plain marks and white space.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_MARKS = "!-/:-@\\[-`{-~\u2013\u2014\u2018-\u201e\u2026\u20ac\u00a1\u00a7\u00ab\u00bb\u00bf"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: UTF-8 bytes of such texts but for two ranges of marks, and the few characters among them that have special rules.
_FINE_BYTES = bytes([*b" \t\n\r\x0b\x0c", *range(33, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_ODD_BYTES = tuple(c.encode() for c in "\u00d7\u00f7\u0130\u0149\u017f")
#: Entries of the newer half of a table, and the longest key that is kept.
_PIECES_MOST, _LONGEST = 250_000, 40


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one above 255, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Encoder:
    """A text's ids as little-endian 32-bit numbers.

    The tokenizer cuts a text into pieces and encodes each on its own, so the ids of pieces seen before are looked up, and only new
    ones go to its model. The table is bounded: when its newer half is full, the older one goes. Words of other make than the
    pieces' pattern covers, and texts for a tokenizer with other first steps, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        steps = json.loads(self.tokenizer.to_str())
        normalizers = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        cuts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known_steps = normalizers == _NORMALIZERS and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        special = [re.escape(t.decode()) for t in self.special]
        self.odd = re.compile("|".join([f"[^{_LETTERS}{_MARKS}0-9 \\t\\n\\r\x0b\x0c]", *special]))
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self.known_steps:
            return self._encoded(self.tokenizer, [text])[0]
        data = text.encode("utf-8", "surrogatepass")
        plain = not data.translate(None, _FINE_BYTES) and not any(c in data for c in _ODD_BYTES) and not any(c in data for c in self.special)
        if plain or not self.odd.search(text):
            return self._looked_up(text)
        ids, run = [], []
        for word in _WORD.findall(text):  # white space joins nothing
            if self.odd.search(word):
                if run:
                    ids.append(self._looked_up(" ".join(run)))
                    run = []
                ids += self._encoded(self.tokenizer, [word])
            else:
                run.append(word)
        return b"".join([*ids, self._looked_up(" ".join(run))])

    def _looked_up(self, text: str) -> bytes:
        pieces = _PIECE.findall(text.lower())
        ids = list(map(self.pieces.get, pieces))
        missing, gaps, at = ids.count(None), [], -1
        if missing:
            for _ in range(missing):
                at = ids.index(None, at + 1)
                gaps.append(at)
            new = self._learn(dict.fromkeys([pieces[at] for at in gaps]))
            for at in gaps:
                ids[at] = new[pieces[at]]
        return b"".join(ids)

    def _learn(self, new: dict[str, None]) -> dict[str, bytes]:
        if len(self.pieces) > _PIECES_MOST:
            self.pieces, self.older = {}, self.pieces
        older = self.older
        found = {piece: older[piece] for piece in new if piece in older}
        unknown = [piece for piece in new if piece not in found] if found else list(new)
        found.update(zip(unknown, self._encoded(self.model, [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in unknown])))
        if max(map(len, found)) <= _LONGEST:
            self.pieces.update(found)
        else:
            self.pieces.update((piece, ids) for piece, ids in found.items() if len(piece) <= _LONGEST)
        return found

    @staticmethod
    def _encoded(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@cache
def _encoder(path: str) -> _Encoder:
    """One per worker process, so that what it has looked up serves later tasks too."""
    return _Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (binary: little-endian 32-bit), doc_tokens: each text's ids and end_id, cut after every `capacity` ids.

    Null text counts as empty and has end_id alone.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc_id, at // 4, len(piece) // 4, piece, len(ids) // 4))
                    held += len(piece)
                    if held > 1 << 24:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    ddl = "doc_id long, start long, length long, ids binary, doc_tokens long"
    columns = [c.split()[0] for c in ddl.split(", ")]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(cut, ddl)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (ascending) that fits: unbounded knapsack over 0..room.

    The best for a space depends on smaller spaces by the smallest size at least, so that many are worked out at a time.
    """
    step, pad = int(sizes[0]), int(sizes[-1])
    value, choice = np.zeros(pad + room + 1), np.full(room + 1, -1)
    value[:pad] = -np.inf  # spaces below 0
    for start in range(step, room + 1, step):
        spaces = np.arange(start, min(start + step, room + 1))
        gains = prices + value[pad + spaces[:, None] - sizes]
        best = gains.argmax(axis=1)
        gain = gains[np.arange(len(spaces)), best]
        before = np.maximum.accumulate(np.concatenate([value[pad + start - 1 : pad + start], np.where(np.isfinite(gain), gain, 0)]))
        better = gain > before[:-1] + 1e-12
        value[pad + spaces], choice[spaces] = np.where(better, gain, before[:-1]), np.where(better, best, -1)
    pattern, space = np.zeros(len(sizes)), room
    while space > 0:
        if choice[space] < 0:
            space -= 1
            continue
        pattern[choice[space]] += 1
        space -= sizes[choice[space]]
    return float(value[pad + room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in a fractional optimum, by the revised simplex with column generation.

    Starts from patterns of one size each. Stops when no pattern pays, or when the sum is within `gap` of the bound that the
    prices give (Farley).
    """
    m = len(sizes)
    base = np.diag((room // sizes).astype(float))
    inverse, used = np.diag(1.0 / np.diag(base)), demand / np.diag(base)
    for step in range(40 * m + 100):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(np.maximum(prices, 0), sizes, room)
        if worth <= 1 + 1e-9 or used.sum() <= (1 + gap) * (np.maximum(prices, 0) * demand).sum() / worth:
            break
        there = np.flatnonzero(pattern)
        along = (inverse[:, there] * pattern[there]).sum(axis=1)
        ok = along > 1e-9
        ratio = np.where(ok, used / np.where(ok, along, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * along, 0)
        used[out] = ratio[out]
        base[:, out] = pattern
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        if step % 200 == 199:  # a Newton step takes out rounding; plain loops, as a threaded library may hang beside the JVM gateway
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", base, inverse))
    return base, used


def plan_sequences(counts: dict[int, int], room: int, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces by size) such that all counted pieces have a place and no sequence exceeds room.

    The fractional optimum is rounded down; what is left, fewer pieces than patterns times pieces in one, is packed best-fit,
    largest first, and equal sequences are counted together.
    """
    left = {s: n for s, n in counts.items() if n and s < room}
    plan = [(counts[room], {room: 1})] if counts.get(room) else []
    if left:
        sizes = np.array(sorted(left))
        patterns, used = solve_patterns(sizes, np.array([left[s] for s in sizes], dtype=float), room, gap)
        for pattern, times in zip(patterns.T, np.floor(used + 1e-9).astype(int)):
            held = {int(s): int(n) for s, n in zip(sizes, pattern) if n}
            times = min([int(times), *(left[s] // n for s, n in held.items())])
            if times > 0:
                plan.append((times, held))
                for s, n in held.items():
                    left[s] -= times * n
    return plan + _best_fit(left, room)


def _best_fit(left: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces by size) for what is left: largest first, into the fullest sequences that have room, equal ones counted together."""
    open_: Counter = Counter()  # (space, pieces) to times
    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            fitting = min((key for key in open_ if key[0] >= size), default=None)
            space, held = fitting or (room, ())
            times, each = open_.pop(fitting) if fitting else n, min(n, space // size)
            full = min(times, n // each)
            open_[space - each * size, (*held, (size, each))] += full
            n -= full * each
            if fitting and full < times:
                open_[fitting] += times - full
                if n:  # fewer than go into one
                    open_[fitting] -= 1
                    open_[space - n * size, (*held, (size, n))] += 1
                    n = 0
            open_ = +open_
    return [(times, dict(held)) for (_, held), times in sorted(open_.items())]


def _scales(capacity: int, unit: int | None) -> tuple[int, int, int, int]:
    """The unit, the first length that is rounded to it, the first that is rounded to two, and the size of a bundle."""
    unit = max(1, capacity // (512 if capacity >= 2048 else 128)) if unit is None else unit
    if capacity % (4 * unit):
        raise ValueError("a quarter of the capacity must be a whole number of units")
    short = min(8 * unit, capacity // 16) if unit > 1 else 0
    return unit, short, capacity // 8 if capacity // unit > 256 and unit > 1 else capacity, capacity // 4


def plan_places(counts: dict[int, int], capacity: int, unit: int | None = None) -> tuple[tuple, tuple]:
    """Places for counted pieces: of short ones (by minus their length) in bundles, and of the rest (by units) and of bundles in sequences.

    Each is sorted by (size, rank): the first of each stretch of pieces, what its first piece goes into, and the pieces that go into one.
    Bundles have a size in units and a rank after the pieces of that size.
    """
    unit, _, _, bundle = _scales(capacity, unit)
    whole = {size: n for size, n in counts.items() if size > 0}
    rows, next_rank, bundles = [], Counter(), Counter(whole)
    for times, held in plan_sequences({-size: n for size, n in counts.items() if size < 0}, bundle):
        units = -(-sum(size * n for size, n in held.items()) // unit)
        for size, n in held.items():
            rows.append((_key(size, next_rank[size]), _key(units, bundles[units]), n))
            next_rank[size] += times * n
        bundles[units] += times
    return _columns(rows), _places(plan_sequences(bundles, capacity // unit))


def packed(pieces: DataFrame, capacity: int = CAPACITY, unit: int | None = None) -> DataFrame:
    """pieces (doc_id, start, length of 1 to capacity, any more columns) with sequence_id and offset, gapless from 0.

    Repeated rows are pieces of their own. Nothing is cut further and nothing left out. Lengths, ids and the columns given are
    shuffled, so leave long columns out. An empty table gives an empty result. The result does not depend on how rows are
    partitioned, except that rows equal in doc_id, start and length may change places.
    """
    spark = pieces.sparkSession
    unit_, short, coarse, _ = _scales(capacity, unit)
    length = F.col("length")
    rounded = F.when(length < short, -length).when(length <= coarse, F.ceil(length / unit_)).otherwise(2 * F.ceil(length / (2 * unit_)))
    table = written(pieces.withColumns({"size": rounded.cast("int"), "hash": F.xxhash64("doc_id", "start", "length")}), "pieces")
    counts = {row["size"]: row["n"] for row in table.groupBy("size").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan_places(counts, capacity, unit))

    def sequence(size: pd.Series, rank: pd.Series) -> pd.Series:
        small, large = shared.value
        sizes, ranks = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = _key(np.abs(sizes), ranks)
        key[sizes < 0] = _found(small, key[sizes < 0])
        return pd.Series(_found(large, key))

    ranked = numbered(table, "size", ["hash"]).withColumnRenamed("idx", "rank")
    placed = ranked.withColumn("sequence_id", F.pandas_udf(sequence, "long")("size", "rank"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def _key(size, rank):
    return (size << 48) + rank


def _found(stretches: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    firsts, starts, slots = stretches
    at = np.searchsorted(firsts, key, side="right") - 1
    return starts[at] + (key - firsts[at]) // slots[at]


def _columns(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array(column, dtype=np.int64) for column in zip(*sorted(rows))) if rows else (np.zeros(1, dtype=np.int64),) * 3


def _places(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by size and rank: the first (size, rank) of each stretch of pieces, the first sequence, and the pieces per sequence."""
    rows, next_rank, next_sequence = [], Counter(), 0
    for times, held in plan:
        for size, n in held.items():
            rows.append((_key(size, next_rank[size]), next_sequence, n))
            next_rank[size] += times * n
        next_sequence += times
    return _columns(rows)


def packed_sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and ids: the sequences themselves, from token_pieces() and packed(). Needs (doc_id, start) to tell pieces apart."""
    ids = pieces.select("doc_id", "start", "ids").join(placed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return ids.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
