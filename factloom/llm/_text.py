"""Vectorised word splitting and hashing over Arrow string columns.

All functions work on the raw UTF-8 bytes of a whole column, so a batch of
documents is split and hashed with a few numpy passes and no Python object per
word. Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_C1, _C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)

#: Separators of words in the corpus operators: space and TAB to CR.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(33))
    x *= _C1
    x ^= x >> U64(29)
    x *= _C2
    x ^= x >> U64(32)
    return x


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, padded by 8 zero bytes, and where each row begins."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    out = np.zeros(int(offsets[-1] - offsets[0]) + 8, dtype=np.uint8)
    if column.buffers()[2] is not None and len(out) > 8:
        out[:-8] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


def words(data: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of bytes in `inside`, and the first word of each row (one more at the end)."""
    n = int(rows[-1])
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(rows), dtype=np.int64)
    is_word = inside[data[:n]]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    at = rows[:-1][rows[1:] > rows[:-1]]
    first[at] = is_word[at]
    at = rows[1:][rows[1:] > rows[:-1]] - 1
    last[at] = is_word[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, rows)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step."""
    eight = np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    out = length.astype(U64) + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    if not len(start):
        return out
    out = mix(out ^ (eight[start] & _MASKS[np.minimum(length, 8)]))
    at, done = np.flatnonzero(length > 8), 8
    while len(at):
        out[at] = mix(out[at] * U64(31) ^ (eight[start[at] + done] & _MASKS[np.minimum(length[at] - done, 8)]))
        done += 8
        at = at[length[at] > done]
    return out


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n neighbouring hashes, in order; shorter by n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(m, (n + seed * 0x632BE59BD9B4E019) & (2**64 - 1), dtype=U64)
    for k in range(n):
        out *= U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(31)
        out += h[k : k + m]
    return mix(out)


def within(rows: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n words stays in one row; rows as words() gives them."""
    count = np.maximum(np.diff(rows) - n + 1, 0)
    return np.repeat(rows[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, in place."""
    upper = (data >= 0x41) & (data <= 0x5A)
    data[upper] += 32
    return data
