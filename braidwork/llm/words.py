"""Whole-batch word scanning with NumPy: no Python loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, as in the
pattern [^\\x20\\x09-\\x0D]+ on UTF-8 text, unless another byte class is given.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_libc = ctypes.CDLL(None)
U = np.uint64
SPAN = 1 << 20
MULT = U(0x9E3779B97F4A7C15 | 1)


def _table(separators) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


SPACE = [0x20, *range(0x09, 0x0E)]
NOT_SPACE = _table(SPACE)
#: Letters, digits and every byte of a multi-byte character.
ALNUM = _table(c for c in range(128) if not chr(c).isalnum())
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(MULT), -1, 1 << 64))
    up, down = np.full(SPAN + 1, MULT), np.full(SPAN + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


UP, DOWN = _powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F | 1)
    return h ^ (h >> U(32))


def trim() -> None:
    """Give freed memory back to the system.

    Python workers live on between tasks and stages, and what the allocators
    keep counts against the executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most `limit` bytes of `column`, or one row; tidy up after the last."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32, count=n + 1 + text.offset)[text.offset:]
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
    trim()


class Words:
    """Where the words of a string array are.

    data: the bytes; start, end: byte range of each word; first: index of
    each row's first word, with one more entry for the end.
    """

    def __init__(self, text: pa.Array, inside: np.ndarray = NOT_SPACE):
        n = len(text)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32, count=n + 1 + text.offset)[text.offset:].astype(np.int64)
        buf = text.buffers()[2]
        base, stop = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(buf, dtype=np.uint8, count=stop)[base:] if buf is not None and stop > base else np.empty(0, np.uint8)
        self.offsets = offsets = offsets - base
        mask = inside[self.data]
        if text.null_count:  # bytes under a null are not text
            for i in np.flatnonzero(~np.asarray(text.is_valid())):
                mask[offsets[i]:offsets[i + 1]] = False
        size = len(mask)
        before = np.empty(size + 1, bool)
        before[0], before[1:] = False, mask
        after = np.empty(size + 1, bool)
        after[size], after[:size] = False, mask
        cuts = offsets[(offsets > 0) & (offsets < size)]
        prev, nxt = before[:size].copy(), after[1:].copy()
        prev[cuts] = False
        nxt[cuts - 1] = False
        self.start = np.flatnonzero(mask & ~prev)
        self.end = np.flatnonzero(mask & ~nxt) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, lo: int, hi: int) -> bytes:
        return self.data[lo:hi].tobytes()

    def hashes(self, mapped: np.ndarray = SAME) -> np.ndarray:
        """A 64-bit hash of each word's bytes after the byte map."""
        out = np.empty(len(self.start), U)
        at, n = 0, len(self.start)
        while at < n:
            lo = int(self.start[at])
            to = int(np.searchsorted(self.end, lo + SPAN, side="right"))
            if to <= at:  # one word longer than a span
                out[at] = xxhash.xxh64_intdigest(mapped[self.data[lo:self.end[at]]].tobytes(), 7)
                at += 1
                continue
            hi = int(self.end[to - 1])
            x = (mapped[self.data[lo:hi]].astype(U) + U(1)) * UP[: hi - lo]
            total = np.empty(hi - lo + 1, U)
            total[0] = 0
            np.cumsum(x, out=total[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix((total[e] - total[s]) * DOWN[s] + (e - s).astype(U) * U(0xC2B2AE3D27D4EB4F))
            at = to
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive entries starting at each entry (shorter by k - 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, power = h[:n].copy(), U(1)
    with np.errstate(over="ignore"):
        for j in range(1, k):
            power = power * MULT
            out += h[j:j + n] * power
    return mix(out)
