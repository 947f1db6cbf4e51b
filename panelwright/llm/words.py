"""Words of whole Arrow string columns as 64-bit hashes, without a Python object per word.

A text's words are maximal runs of bytes that are not separators. A word's hash is a polynomial of its (folded) bytes
modulo 2**64, read off a running sum over the column's byte buffer and then mixed; separators are ASCII, so UTF-8 bytes
of other characters always belong to words. NULL has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"n": 0, "up": np.zeros(0, U), "down": np.zeros(0, U)}


def fold_table(separators: bytes = WHITE, lower: bool = True) -> np.ndarray:
    """Value of each byte in a word's polynomial; 0 marks a separator."""
    table = np.arange(1, 257, dtype=U)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _grow(n: int) -> None:
    if _powers["n"] < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, U)
                p[0] = 1
                _powers[key] = np.cumprod(p, dtype=U)
        _powers["n"] = size


@dataclass
class Words:
    """``hash[first[r]:first[r + 1]]`` are the words of row ``r``; ``start`` and ``end`` are byte places in the row's text."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    prefixes: list[np.ndarray] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def text_buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the rows; ``prefixes``: also hashes of each word's first so many bytes (its own hash's basis if it is shorter)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(len(offsets), np.int64), none, none, [np.zeros(0, U) for _ in prefixes])
    _grow(n + 1)
    value = table[data]
    inside = value != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    starts[cuts] = inside[cuts]  # a row's first byte never goes on with a word of the row before
    begin = np.flatnonzero(starts)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    stops[before] = inside[before]
    end = np.flatnonzero(stops) + 1
    with np.errstate(over="ignore"):
        value *= _powers["up"][:n]
        np.cumsum(value, out=value)
        before = np.where(begin > 0, value[begin - 1], U(0))

        def upto(stop: np.ndarray) -> np.ndarray:
            return mix((value[stop - 1] - before) * _powers["down"][begin])

        h, short = upto(end), [mix(upto(np.minimum(begin + k, end)), 500 + k) for k in prefixes]
    first = np.searchsorted(begin, offsets)
    shift = np.repeat(offsets[:-1], np.diff(first))
    return Words(h, first, begin - shift, end - shift, short)


def pieces(texts, table: np.ndarray, most: int = 1 << 20, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, Words]]:
    """Words of a column in runs of whole rows of about ``most`` bytes: (first row, end row, words)."""
    data, offsets = text_buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        stop = min(rows, max(row + 1, stop))
        lo, hi = offsets[row], offsets[stop]
        yield row, stop, words(data[lo:hi], offsets[row : stop + 1] - lo, table, prefixes)
        row = stop


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and each row's first; a shorter row is one shingle, a row without words none."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    left = np.repeat(n, count)
    total = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for k in range(size):
            here = left > k
            term = mix(w.hash[at[here] + k], k + 1)
            total[here] += term
    return mix(total, 77), first


def distinct_in_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), ends


def sums_in_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row modulo 2**64; 0 for an empty row."""
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
        return run[first[1:]] - run[first[:-1]]
