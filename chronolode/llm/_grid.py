"""Words and word sequences of whole Arrow batches as numpy arrays.

A batch's texts already lie in one UTF-8 buffer, so words, their hashes and the hashes of word sequences are
found with a few passes over arrays instead of a Python loop over words. Documents are handled in groups of about
GROUP_BYTES, and a longer document alone; only its word table (about 2.5 bytes a character) is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_pow: np.ndarray = np.ones(1, np.uint64)
_inv: np.ndarray = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _pow, _inv = np.cumprod(up), np.cumprod(down)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each slice's bytes, the same wherever the slice lies; starts must ascend.

    With prefixes, rows of hashes: of the slices, then of their first k bytes for each k of prefixes; a slice of at
    most k bytes has 0 there.
    """
    out = np.zeros((1 + len(prefixes), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, at + GROUP_BYTES)))
        stop = int(ends[i:j].max())
        up, down = _powers(stop - at + 1)
        total = np.zeros(stop - at + 1, np.uint64)
        np.cumsum((buf[at:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - at], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[0, i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        for row, k in enumerate(prefixes, 1):
            some = np.flatnonzero(e - s > k)
            b = s[some]
            # Apart from whole words of k bytes by another term.
            out[row, i + some] = mix((total[b + k] - total[b]) * down[b] + np.uint64(1_000_003 * k))
        i = j
    return out if prefixes else out[0]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about GROUP_BYTES together; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of documents lo..hi of a batch: byte starts and ends in buf, and each document's first word."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each document, and one beyond the last
    lo: int

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return hash_slices(self.buf, self.starts, self.ends)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[Words]:
    """table maps a byte to what it counts as; to 0 where it separates words."""
    for lo, hi in groups(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        buf = table[data[a:b]]
        inside = np.zeros(b - a + 1, bool)
        inside[:-1] = buf != 0
        begin = inside[:-1].copy()
        begin[1:] &= ~inside[:-2]
        cuts = offsets[lo:hi] - a
        real = cuts[cuts < b - a]
        begin[real] = inside[real]
        starts = np.flatnonzero(begin)
        stop = inside[:-1] & ~inside[1:]
        last = real[real > 0] - 1
        stop[last] = inside[last]
        ends = np.flatnonzero(stop) + 1
        first = np.searchsorted(starts, offsets[lo : hi + 1] - a)
        yield Words(buf, starts, ends, first, lo)


def sequence_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, by its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    keys = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * keys[k]
    return mix(out)


def fold_table() -> np.ndarray:
    """A-Z become a-z; only letters, digits and the bytes of U+0080 and above are parts of words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    part = np.zeros(256, bool)
    part[48:58] = part[65:91] = part[97:123] = True
    part[128:] = True
    t[~part] = 0
    return t
