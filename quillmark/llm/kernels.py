"""Vectorised text kernels over Arrow string buffers.

All functions work on the raw UTF-8 bytes of a whole batch, so the cost per
word is a few numpy passes and no Python object per word.  Separators are
always ASCII, hence byte-level splitting is exact for UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_SLAB = 1 << 18

#: Words between blanks: everything but 0x20 and 0x09-0x0D.
BLANK = np.ones(256, np.uint8)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
#: Words of ASCII letters and digits and all non-ASCII characters.
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = 1
ALNUM[0x41:0x5B] = 1
ALNUM[0x61:0x7B] = 1
ALNUM[0x80:] = 1


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
    codes[0x41:0x5B] = codes[0x61:0x7B]  # A-Z hash as a-z
    return codes


_CODES = _byte_codes()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * _MULT
    return h ^ (h >> U64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = U64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (n + 1 values)."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = 0
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = 0
    starts = np.flatnonzero(inside & (before ^ 1))
    after = np.empty_like(inside)
    after[-1] = 0
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = 0
    ends = np.flatnonzero(inside & (after ^ 1)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            low = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, low + _SLAB, side="right")))
            high = ends[j - 1]
            up, down = _POWERS.get(int(high - low) + 1)
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            part = _CODES[data[low:high]]
            part *= up[: high - low]
            np.cumsum(part, out=sums[1:])
            out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
            i = j
        return mix(out)


def hashed(column: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a whole column, and the first word of every text (n + 1 values)."""
    data, offsets = strings(column)
    starts, ends, first = spans(data, offsets, is_word)
    return word_hashes(data, starts, ends), first


def slabs(sizes: np.ndarray, limit: int):
    """Consecutive ranges of rows with at most ``limit`` in all, or one row that alone is larger."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    i, n = 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out *= _MULT
            out += words[j : j + n]
        return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence that is shorter than a shingle."""
    return ngrams(words, len(words)) ^ U64(len(words))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text (with repeats), and where each text's begin (n + 1 values).

    A text of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint64)
    grams = ngrams(words, k)
    long = np.flatnonzero(counts >= k)
    if len(long):
        n = sizes[long]
        src = np.repeat(first[long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        dst = np.repeat(begin[long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[dst] = grams[src]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[begin[i]] = whole(words[first[i] : first[i + 1]])[0]
    return out, begin


def unique_sorted(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[head], np.diff(np.concatenate([head, [len(keys)]]))
    return keys[head], np.add.reduceat(counts, head)


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key, or -1."""
    if len(sorted_keys) == 0:
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


class Prober:
    """Membership lookups of many unsorted keys in sorted ones that are spread evenly, as hashes are.

    A table on the top bits tells where keys that begin so lie: a run of one or
    two, which is walked along.  Keys that crowd together are searched by halves.
    """

    def __init__(self, sorted_keys: np.ndarray) -> None:
        self.keys = sorted_keys
        bits = max(8, min(23, int(len(sorted_keys)).bit_length() + 1))
        self.shift = U64(64 - bits)
        self.begin = np.zeros((1 << bits) + 1, np.int32)
        for i in range(0, len(sorted_keys), 1 << 18):  # a table of 8 bytes beside this one would be twice as large
            np.add.at(self.begin[1:], (sorted_keys[i : i + (1 << 18)] >> self.shift).astype(np.int64), 1)
        self.longest = int(self.begin.max())
        np.cumsum(self.begin, out=self.begin)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        head = (keys >> self.shift).astype(np.int64)
        at, end = self.begin[head], self.begin[head + 1]
        left = np.flatnonzero(at < end)
        if self.longest > 64:
            out[left] = lookup(self.keys, keys[left])
            return out
        at, end, wanted = at[left], end[left], keys[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            at = at + 1
            go = np.flatnonzero(~hit & (at < end))
            left, at, end, wanted = left[go], at[go], end[go], wanted[go]
        return out


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches; when it ends, the worker gives the memory it has freed back to the machine.

    Workers wait for the next task with what their allocators hold, beside those that run.
    """

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere there is nothing to do
        if trim is not None:
            trim(0)

    return run
