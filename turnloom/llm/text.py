"""Bytes of Arrow text columns, their words, and hashes of words, lines and windows in numpy.

A word is a run of bytes other than space and 0x09 to 0x0D; since those are single bytes in UTF-8,
bytes give the same words as code points. Hashes are 64 bits: a polynomial over a table of random
byte values, then a mixing step, so they are equal on every machine and after every retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_powers: dict[str, np.ndarray] = {}


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts (one more entry than rows)."""
    column = one_array(column).fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_ranges(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text, at least one row each."""
    _, offsets = text_bytes(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed bijection)."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, … modulo 2^64; the last table is kept for pieces of usual size."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 4 * PIECE:
            _powers[name] = table
    return table[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes in each range; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[data] * _power("up", BASE, len(data)), out=total[1:])
    down = _power("down", INVERSE, len(data) + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_ranges(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row; ``outside``: bytes between words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~outside[data]
    at_row = np.zeros(len(data) + 1, bool)
    at_row[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | at_row))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | at_row))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the number of words before each row."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends, before = word_ranges(data, offsets)
    return range_hashes(data, starts, ends), before


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` successive words; windows may cross rows, see ``whole_windows``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + words[i:len(words) - n + 1 + i] + np.uint64(i + 1))
    return out


def owners(before: np.ndarray) -> np.ndarray:
    """The row of every item, from the number of items before each row."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def per_row(flags: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of a value per item over the items of each row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[before[1:]] - total[before[:-1]]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its ``n``-word shingles, letters A-Z lower-cased.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    for lo, hi in row_ranges(column):
        words, before = word_hashes(column.slice(lo, hi - lo), lower=True)
        windows = window_hashes(words, n)
        for i in range(hi - lo):
            a, b = int(before[i]), int(before[i + 1])
            if b - a >= n:
                yield np.unique(windows[a:b - n + 1])
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
