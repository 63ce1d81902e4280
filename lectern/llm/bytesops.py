"""Vectorised byte-level text work for Arrow batches: word bounds, word hashes, window hashes.

All hashes are 64-bit and depend on the bytes only, so any process gets the
same ones. Words never cross documents. Spans of few elements are hashed from
prefix sums; of words and long spans every bit goes through ``strong_hashes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: Text is hashed in pieces of about this many bytes.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= self.n:
            self.n = max(n + 1, PIECE * 2)
            one = np.full(self.n + 1, _MULT, U)
            one[0] = 1
            self.up = np.multiply.accumulate(one)
            one[1:] = _INVERSE
            self.down = np.multiply.accumulate(one)
        return self.up, self.down


_POWERS = _Powers()


def prefix_hashes_of(values: np.ndarray) -> np.ndarray:
    """C with ``span_hashes(C, a, b)`` a hash of the 64-bit values a to b."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _POWERS.get(len(values))[0][: len(values)], out=out[1:])
    return out


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """The same for bytes."""
    return prefix_hashes_of(_RANDOM[data])


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * _POWERS.get(len(c))[1][start])


#: Spans of more bytes than this are hashed one by one.
LONG = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def strong_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each span of bytes a hash that takes in eight bytes at a time, mixed after each; BLAKE2 for long spans.

    Unlike sums, it has no strings of a simple make that meet.
    """
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(length.astype(U) ^ U(_MULT))
    at = np.flatnonzero(length <= LONG)
    taken = 0
    while len(at):
        left = length[at] - taken
        if (left <= 0).any():
            at = at[left > 0]
            left = length[at] - taken
        h[at] = mix((h[at] * U(_MULT)) ^ (eight[start[at] + taken] & _MASKS[np.minimum(left, 8)]))
        taken += 8
    for k in np.flatnonzero(length > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


#: Words of the contracts: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. NUL is a word byte of the first.
PLAIN_KEEP = np.ones(256, bool)
PLAIN_KEEP[[9, 10, 11, 12, 13, 32]] = False
ALNUM_KEEP = np.zeros(256, bool)
ALNUM_KEEP[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string array; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about ``size`` bytes of text; a longer text stands alone."""
    _, o = buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(o) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(o, o[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Word bounds and hashes of a string array.

    ``starts``, ``ends``: byte bounds in ``data`` (lower-cased); ``first``:
    index of each document's first word, with the total at the end; ``hashes``:
    one a word.
    """

    def __init__(self, column: pa.Array, keep: np.ndarray) -> None:
        raw, self.offsets = buffers(column)
        self.data = LOWER[raw]
        on = np.zeros(len(raw) + 2, bool)
        on[1:-1] = keep[self.data]
        begin = on[1:-1] & ~on[:-2]
        bounds = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        begin[bounds] = on[1:-1][bounds]
        self.starts = np.flatnonzero(begin)
        last = on[1:-1] & ~on[2:]
        before = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[before] = on[1:-1][before]
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = strong_hashes(self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """Of each word, its document's index."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Of each run of ``n`` words, a hash that depends on their order."""
    if len(words) < n:
        return np.zeros(0, U)
    c = prefix_hashes_of(words)
    return mix((c[n:] - c[:-n]) * _POWERS.get(len(words))[1][: len(words) - n + 1] + U(n))
