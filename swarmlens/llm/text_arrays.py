"""Vectorised words, word hashes and word n-gram hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch at once.  A word is a
maximal run of bytes outside 0x20 and 0x09-0x0D, so no multi-byte character is
ever split.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_TABLES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _GRAM_POWERS = (Powers(_BASE), Powers(0x9FB21C651E98DF25)), Powers(0xC2B2AE3D27D4EB4F)


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(run):
    """A function over batches that releases memory when its task ends."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (n + 1 values)."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, none overlapping), a block of bytes at a time.

    There are two families, of different byte tables and bases, so that spans which one confuses are told apart by the other.
    """
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), block)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:]):
        a, b = starts[i], ends[j - 1]
        up, down = _BYTE_POWERS[family].get(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_TABLES[family][data[a:b]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def gram_hashes(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words that start at each index (``at``, or all that have n words after them)."""
    if at is None:
        at = np.arange(max(0, len(words) - n + 1))
    up, down = _GRAM_POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * down[at])


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words at which n words of one text start."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    base = np.repeat(first[:-1], counts)
    return base + (np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, offsets, starts, ends, first word of each text, word hashes."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    return data, offsets, starts, ends, first, span_hashes(data, starts, ends)


def slices(batch: pa.RecordBatch, text: str, most_bytes: int):
    """Cut a batch into parts of about ``most_bytes`` of text (one long text may exceed it)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64) + 64
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
