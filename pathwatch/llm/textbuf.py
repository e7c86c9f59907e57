"""Vectorised helpers on Arrow text columns: words and their hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: the space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 4 << 20
_M = np.uint64


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, one row at least, so that work arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield batch.slice(first)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, with eight zero bytes after them, and each row's bounds; a null counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _M(30))
    x = x * _M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M(27))
    x = x * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


class Words:
    """Words of a text buffer: byte bounds, 64-bit hashes, and the row of each (first[i] .. first[i + 1] are row i's words)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, seed: int = 0):
        n = int(offs[-1])
        solid = ~SPACE[buf[:n]]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.buf = buf
        self.seed = seed

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        eight = np.lib.stride_tricks.as_strided(self.buf[:8].view("<u8"), shape=(len(self.buf) - 7,), strides=(1,))
        size = self.end - self.start
        out = mix(size.astype(np.uint64) + _M(self.seed))
        at, left, who = self.start, size, slice(None)
        while len(left):
            part = eight[at]
            short = left < 8
            part[short] &= (_M(1) << (left[short].astype(np.uint64) * _M(8))) - _M(1)
            out[who] = mix(out[who] * _M(0x9E3779B97F4A7C15) + part)
            more = np.flatnonzero(left > 8)
            who = more if isinstance(who, slice) else who[more]
            at, left = at[more] + 8, left[more] - 8
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values from each place on; the last k - 1 places have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _M(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        rest = width - have
        x = np.minimum(x[: len(x) - rest], x[rest:])
    return x
