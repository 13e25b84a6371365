"""Vectorised word handling on Arrow text columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything here works on whole
Arrow columns with numpy, so that no Python statement runs once per word.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of text that are handled at once; one longer document is handled alone
SLICE_BYTES = 6 << 20


def as_binary(column: pa.Array) -> pa.Array:
    """The column's UTF-8 as large_binary, nulls as empty values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary column and its n + 1 offsets, the first of them 0."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each; every row is in one part."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(as_binary(batch.column(batch.schema.get_field_index(text))))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def split_words(column: pa.Array, space: np.ndarray = _SPACE, folded: np.ndarray | None = None) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of all texts in order, and the n + 1 word offsets of the texts. ``space`` marks the bytes that no word
    has, ``folded`` gives the bytes to write in place of those of words."""
    data, offsets = buffers(as_binary(column))
    keep = ~space[data]
    if folded is not None:
        data = folded[data]
    before = np.empty_like(keep)
    before[:1] = False
    before[1:] = keep[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(keep & ~before)
    after = np.empty_like(keep)
    after[-1:] = False
    after[:-1] = keep[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(keep & ~after) + 1
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[keep])])
    return words, np.searchsorted(starts, offsets)


def hash_words(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent unsigned 64-bit hashes of each word (the halves of XXH3-128)."""
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()])
    both = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    index = coded.indices.to_numpy()
    return both[index, 0], both[index, 1]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of ``width`` consecutive hashes, boundaries between texts ignored."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    factor = np.uint64(base)
    for k in range(1, width):
        out *= factor
        out += hashes[k : k + n]
    return mix(out)
