"""Spans of texts as Arrow functions: found, merged and masked in time that grows with the text and its spans.

Positions are held as sorted numpy arrays and go back as Arrow lists, so no span becomes a Python object of its own. Offsets count
code points. Batches are gone through in short stretches of rows, so what Python holds besides a batch is bounded by a stretch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from docweft.functions.text import BLANKS, NON_BLANK_CLASS, PAGE_MARKER

SPAN_ARRAY = "array<struct<start:int,end:int,entity_type:string>>"
MARKER_ARRAY = "array<struct<pos:int,page:int>>"
CHUNK_ARRAY = "array<struct<start:int,end:int,chunk:string>>"
_MASKED = re.compile(NON_BLANK_CLASS)
_DIGIT = re.compile(r"\d")
_MARKER = re.compile(PAGE_MARKER)
_LARGEST = 2**31 - 1
#: Bytes of the columns of a stretch of rows, of which several copies are held; a longer row is a stretch of its own.
STRETCH_BYTES = 1 << 20


def stretches(columns: Sequence[pa.Array], most: int = STRETCH_BYTES) -> Iterator[list[pa.Array]]:
    """The rows of a batch in order, about `most` bytes at a time; an empty batch gives one empty stretch."""
    rows, start = len(columns[0]), 0
    share = max(1, int(rows * most / max(1, sum(c.nbytes for c in columns))))
    while start < rows or not rows:
        size = min(share, rows - start)
        while size > 1 and sum(c.slice(start, size).nbytes for c in columns) > most:
            size //= 2
        yield [c.slice(start, size) for c in columns]
        start += size
        if not rows:
            return


def in_stretches(function: Callable[..., pa.Array], returns: str, *columns: Column) -> Column:
    """A function of Arrow arrays over the columns, called for a stretch of rows at a time, each given back before the next is read."""
    if len(columns) == 1:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for piece in stretches([batch]):
                    yield function(*piece)
    else:
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                for piece in stretches(batch):
                    yield function(*piece)

    return F.arrow_udf(run, returns)(*columns)


def lists_of(rows: Sequence[tuple | None], types: Sequence[pa.DataType], names: Sequence[str]) -> pa.Array:
    """A list of structs per row, from one array per member and row; None is null."""
    sizes = [0 if row is None else len(row[0]) for row in rows]
    offsets = pa.array([*np.cumsum([0, *sizes[:-1]]).tolist(), int(sum(sizes))], pa.int32(), mask=np.array([*[row is None for row in rows], False], dtype=bool))
    columns = []
    for at, kind in enumerate(types):
        parts = [row[at] for row in rows if row is not None and len(row[at])]
        columns.append(pa.concat_arrays([pa.array(p, kind) for p in parts]) if parts else pa.array([], kind))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=list(names)))


def members(lists: pa.ListArray, row: int, names: Sequence[str]) -> list[pa.Array]:
    """The members of one row's list of structs."""
    values = lists[row].values
    return [values.field(name) for name in names]


def found(text: str, patterns: Sequence[tuple[str, re.Pattern]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number of the pattern of all matches, by pattern and then in order."""
    starts, ends, kinds = [], [], []
    digits = _DIGIT.search(text) is not None
    for kind, (needs, pattern) in enumerate(patterns):
        if digits if needs == "digit" else needs in text:  # most texts hold nothing of a given kind
            for hit in pattern.finditer(text):
                starts.append(hit.start())
                ends.append(hit.end())
                kinds.append(kind)
    return np.array(starts, dtype=np.int32), np.array(ends, dtype=np.int32), np.array(kinds, dtype=np.int32)


def islands(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans merged where they overlap or touch, in order; the earliest, then longest, then first kind names the merged one."""
    if not len(starts):
        return starts, ends, kinds
    order = np.lexsort((kinds, -ends, starts))
    starts, ends, kinds = starts[order], ends[order], kinds[order]
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1], kinds[first]


def masked(text: str, starts: Iterable[int], ends: Iterable[int], char: str) -> str:
    """The text with every non-blank character inside disjoint, ordered spans replaced; the length is kept."""
    pieces, at = [], 0
    for start, end in zip(starts, ends):
        pieces += text[at:start], _MASKED.sub(char, text[start:end])
        at = end
    return "".join([*pieces, text[at:]])


def _named(kinds: np.ndarray, names: Sequence[str]) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(kinds, pa.int32()))


def _span_lists(rows: Sequence[tuple | None], names: Sequence[str]) -> pa.Array:
    named = [None if row is None else (row[0], row[1], _named(row[2], names)) for row in rows]
    return lists_of(named, (pa.int32(), pa.int32(), pa.string()), ("start", "end", "entity_type"))


def _compiled(patterns: dict[str, tuple[str, str]]) -> tuple[list[str], list[tuple[str, re.Pattern]]]:
    """In order of name, so that comparing the numbers of two kinds compares their names."""
    names = sorted(patterns)
    return names, [(patterns[name][0], re.compile(patterns[name][1])) for name in names]


def spans_of(text: Column, patterns: dict[str, tuple[str, str]]) -> Column:
    """All matches of the patterns (name to what a text must hold, and the pattern); none for a null text."""
    names, compiled = _compiled(patterns)

    def find(texts: pa.Array) -> pa.Array:
        return _span_lists([found(t.as_py() or "", compiled) for t in texts], names)

    return in_stretches(find, SPAN_ARRAY, text)


def redacted(text: Column, patterns: dict[str, tuple[str, str]], char: str) -> Column:
    """Struct (text, spans): the masked text and its merged spans, found in one go over the text; a null text stays null."""
    names, compiled = _compiled(patterns)

    def redact(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        rows = [islands(*found(t or "", compiled)) for t in plain]
        out = [masked(t, s.tolist(), e.tolist(), char) if t is not None and len(s) else t for t, (s, e, _) in zip(plain, rows)]
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), _span_lists(rows, names)], names=["text", "spans"])

    return in_stretches(redact, f"struct<text:string,spans:{SPAN_ARRAY}>", text)


def _of_row(spans: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    starts, ends, kinds = members(spans, row, ("start", "end", "entity_type"))
    names = sorted(set(kinds.to_pylist()), key=lambda n: (n is not None, n))
    number = {name: i for i, name in enumerate(names)}
    return starts.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False), np.array([number[k] for k in kinds.to_pylist()], dtype=np.int32), names


def merged_spans(spans: Column) -> Column:
    """The merged spans of a row's span array (any order, overlaps allowed)."""
    def merge(lists: pa.Array) -> pa.Array:
        rows = []
        for row in range(len(lists)):
            if not lists[row].is_valid:
                rows.append(None)
                continue
            *own, names = _of_row(lists, row)
            starts, ends, kinds = islands(*own)
            rows.append((starts, ends, _named(kinds, names)))
        return lists_of(rows, (pa.int32(), pa.int32(), pa.string()), ("start", "end", "entity_type"))

    return in_stretches(merge, SPAN_ARRAY, spans)


def masked_by(text: Column, spans: Column, char: str) -> Column:
    """The text masked by a row's span array (any order, overlaps allowed; null: none)."""
    def mask(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for row, text in enumerate(texts.to_pylist()):
            if text is not None and lists[row].is_valid and len(lists[row].values):
                *own, _ = _of_row(lists, row)
                starts, ends, _ = islands(*own)
                text = masked(text, starts.tolist(), ends.tolist(), char)
            out.append(text)
        return pa.array(out, pa.string())

    return in_stretches(mask, "string", text, spans)


def markers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and pages of all page markers; a page too large for an int counts as no marker."""
    hits = [(hit.start(), int(hit[1])) for hit in _MARKER.finditer(text)] if "[Page " in text else []
    both = np.array([h for h in hits if h[1] <= _LARGEST], dtype=np.int64).reshape(-1, 2)
    return both[:, 0].astype(np.int32), both[:, 1].astype(np.int32)


def markers_of(text: Column) -> Column:
    """Array of (pos, page) for every `[Page N]` marker, in text order; empty for a null text."""
    def mark(texts: pa.Array) -> pa.Array:
        return lists_of([markers(t.as_py() or "") for t in texts], (pa.int32(), pa.int32()), ("pos", "page"))

    return in_stretches(mark, MARKER_ARRAY, text)


def cited(text: Column, spans: Column) -> Column:
    """Per span (start, end) of a row's array: the slice of the text and the page of the last marker at or before its start.

    A span without a start, or ending before it, has neither; the markers are found once a text and looked up by binary search.
    """
    def cite(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for row, text in enumerate(texts.to_pylist()):
            if not lists[row].is_valid:
                rows.append(None)
                continue
            text = text or ""
            starts, ends = (m.to_pylist() for m in members(lists, row, ("start", "end")))
            pos, pages = markers(text)
            good = [s is not None and e is not None and 0 <= s <= e for s, e in zip(starts, ends)]
            at = np.searchsorted(pos, np.array([s if ok else -1 for s, ok in zip(starts, good)], dtype=np.int64), side="right").tolist()
            pages = pages.tolist()
            rows.append(([text[s:e] if ok else None for s, e, ok in zip(starts, ends, good)], [pages[i - 1] if i else None for i in at]))
        return lists_of(rows, (pa.string(), pa.int32()), ("source", "page"))

    return in_stretches(cite, "array<struct<source:string,page:int>>", text, spans)


def window_bounds(breaks: np.ndarray, length: int, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the overlapping windows of a text of that length whose possible cuts are the sorted positions `breaks`.

    A window has `size` characters or ends at the last break after its middle; the next begins `overlap` before its end, and at least one
    character on. The last one ends with the text. A size of 0 or less gives one window.
    """
    starts, ends = [0], []
    while 0 < size < length - starts[-1]:
        full = starts[-1] + size
        near = int(np.searchsorted(breaks, full))
        cut = int(breaks[near - 1]) if near else 0
        ends.append(cut if cut > full - size + size // 2 else full)
        starts.append(max(ends[-1] - overlap, starts[-1] + 1))
    return starts, [*ends, length]


def chunks_of(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end, chunk) of each stripped text: its windows, stripped, blank ones left out unless the text is blank."""
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            if text is None:
                rows.append(None)
                continue
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            starts, ends = window_bounds(np.flatnonzero((points == 10) | (points == 32)), len(text), size, overlap)
            pieces = [text[s:e].strip(BLANKS) for s, e in zip(starts, ends)]
            keep = [i for i, piece in enumerate(pieces) if piece or not text]
            rows.append(([starts[i] for i in keep], [ends[i] for i in keep], [pieces[i] for i in keep]))
        return lists_of(rows, (pa.int32(), pa.int32(), pa.string()), ("start", "end", "chunk"))

    return in_stretches(cut, CHUNK_ARRAY, text)
