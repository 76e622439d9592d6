"""Vectorised views of Arrow text columns: byte buffers, word spans and span hashes.

Everything works on blocks of about a megabyte, which stay in the processor's caches, so memory does not depend on partition size. A text
longer than a block is a block of its own.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, column: str, block_bytes: int = 1 << 20):
    """Slices of the record batches with about block_bytes of text each: (batch, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
            to = min(to, at + 60_000, n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


PRIME = (1 << 61) - 1
LOW31, LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)
#: Bytes of a span that sums hold at once; longer ones are hashed in pieces.
PIECE = 1 << 24


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    ah, al, bh, bl = a >> U(31), a & LOW31, b >> U(31), b & LOW31
    mid = al * bh + ah * bl
    return _reduce(ah * bh * U(2) + (mid >> U(30)) + ((mid & LOW30) << U(31)) + al * bl)


def draw_base() -> int:
    """A base for span hashes that no text can be made for: drawn anew for each job, on the driver."""
    return secrets.randbelow(PRIME - (1 << 32)) + (1 << 31)


class Powers:
    """Powers of a base and of its inverse modulo the prime 2**61 - 1, grown on demand. Two different spans of
    n bytes have one hash for at most n of the 2**61 bases."""

    def __init__(self, base: int = BASE % PRIME):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> "Powers":
        for name, b in (("up", self.base), ("down", self.inverse)):
            a = getattr(self, name)
            while len(a) < n:
                a = np.r_[a, times(a, U(pow(b, len(a), PRIME)))]
            setattr(self, name, a)
        return self

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Running sums of bytes times the low 31 and the high 30 bits of powers, from which the hash of any
        span follows in O(1)."""
        self.grow(len(data) + 1)
        out = np.zeros((2, len(data) + 1), U)
        x, power = data.astype(U) + U(1), self.up[: len(data)]
        np.cumsum(x * (power & LOW31), out=out[0, 1:])
        np.cumsum(x * (power >> U(31)), out=out[1, 1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) and int((ends - starts).max()) > PIECE:
            return self._long_spans(prefix, starts, ends)
        low, high = (_reduce(p[ends] - p[starts]) for p in prefix)
        total = _reduce(low + (((high & LOW30) << U(31)) | (high >> U(30))))
        return times(total, self.down[starts])

    def _long_spans(self, prefix, starts, ends):
        out = np.zeros(len(starts), U)
        for at in range(0, int((ends - starts).max()), PIECE):
            some = np.flatnonzero(ends - starts > at)
            s = starts[some] + at
            part = self.spans(prefix, s, np.minimum(ends[some], s + PIECE))
            out[some] = _reduce(out[some] + times(part, np.broadcast_to(self.up[at], len(some))))
        return out


def segments(data: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The kept bytes from each start to the next as binary values; a value begins at every start."""
    before = np.r_[0, np.cumsum(keep)]
    kept = data[keep]
    at = np.r_[before[starts], len(kept)] if len(starts) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept.tobytes())])


def codes(values: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal values only: the bytes are compared, no hash decides."""
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of two codes."""
    return codes(pa.array(a * (int(b.max(initial=0)) + 1) + b))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the row of each; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def distinct_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by both. Rows are below 65,536 in a block."""
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]


def sum_per_row(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by sorted row number."""
    out = np.zeros(n, U)
    if len(row):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[at]] = np.add.reduceat(value, at)
    return out


def shingles(data, offsets, k: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row as (row, hash), A-Z lower-cased; a text with fewer
    words has its whole sequence as one shingle, a text without words has none."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets)
    h = mix(powers.spans(powers.prefix(low), starts, ends))
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    coef = mix(np.arange(1, k + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
    m = max(0, len(h) - k + 1)
    acc = np.zeros(m, U)
    for i in range(k):
        acc += h[i : i + m] * coef[i]
    inside = row[:m] == row[k - 1 : k - 1 + m]
    rows, values = row[:m][inside], mix(acc[inside])
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        own = (count < k)[row]
        r = row[own]
        pos = np.arange(len(r)) - np.searchsorted(r, r)
        total = sum_per_row(r, h[own] * coef[pos], n)[few]
        rows = np.concatenate([rows, few])
        values = np.concatenate([values, mix(total + count[few].astype(U) * U(0xA24BAED4963EE407))])
    return distinct_per_row(rows, values)
