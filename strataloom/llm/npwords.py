"""Text kernels on numpy code-point arrays: decoding Arrow text, words, hashes, all without per-row calls."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points above this one have no letter case and are looked up as "other".
TOP = 0x32400
#: Characters handled at once; bounds the memory of a Python worker.
CHUNK_CHARS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=None)
def category_table(kinds: str) -> np.ndarray:
    """Boolean table over code points: is the general category's first letter (or whole name) in ``kinds``?"""
    want = set(kinds.split())
    table = np.zeros(0x110000, dtype=bool)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))
        table[c] = kind in want or kind[0] in want
    return table


@lru_cache(maxsize=None)
def lower_table() -> np.ndarray:
    """Table of simple lower-case mappings."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(TOP):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=None)
def space_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x3001):
        table[c] = chr(c).isspace()
    return table


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of ``col`` end to end, and the offsets of the rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = bytes(data[int(offsets[0]) : int(offsets[-1])]) if data is not None else b""
    offsets = offsets - offsets[0]
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:  # bytes that are no UTF-8: row by row, with replacement characters
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ends = np.cumsum([0, *map(len, rows)])
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), ends.astype(np.int64)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(cp) != len(raw):
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
        offsets = lead[offsets]
    return cp, offsets.astype(np.int64)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``size`` bytes of ``column`` each, one row at least."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - 1) // size
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
        yield batch.slice(int(a), int(b - a))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True inside each row: row numbers, starts, ends."""
    n = len(mask)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # row starts, and the end
    before = np.concatenate([[False], mask[:-1]])
    start = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.concatenate([mask[1:], [False]])
    end = np.flatnonzero(mask & (~after | first[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, end


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal spans get equal values wherever they stand."""
    if len(start) == 0:
        return np.empty(0, np.uint64)
    size = 1 << max(12, int(len(cp)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])


def word_hash(word: str) -> int:
    """The hash that ``span_hashes`` gives ``word``."""
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return int(span_hashes(cp, np.array([0]), np.array([len(cp)]))[0])


def hashed_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the lower-case words (runs of letters, marks and digits) of all rows."""
    cp, offsets = codepoints(col)
    row, start, end = runs(category_table("L M N")[cp], offsets)
    return row, span_hashes(lower_table()[cp], start, end)
