"""Words and hashes of whole texts, many at a time: numpy over the bytes of Arrow batches.

Texts are taken in blocks of about `BLOCK` bytes, so that what a block needs stays small; a longer text is a block alone.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18

#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are cut at ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
#: Bytes of words of lower-cased letters and digits; all bytes beyond ASCII count as letters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_PLACE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: What is left of 8 bytes of which so many belong to a word.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes up to which words are hashed together, 8 bytes of each at a time.
TOGETHER = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def trimmed() -> None:
    """Gives back memory that is no longer used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for the batches of a partition, after which the worker gives back the memory it no longer uses: workers live on, beside those of later stages."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trimmed()

    return outer


class Block:
    """Neighbouring texts and their words. first: the row of the first text; at: where each text's words begin, of len(texts) + 1."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool = True) -> None:
        self.first, self.n, self.data, self.offsets = first, len(offsets) - 1, LOWER[data] if lower else data, offsets
        inside = letters[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.at = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its length, then 8 bytes after another, each round mixed; of long words BLAKE2."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.ends - self.starts
        out = mixed((eight[self.starts] & _MASK[np.minimum(size, 8)]) + mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        more = np.flatnonzero((size > 8) & (size <= TOGETHER))
        at = 8
        while len(more):
            out[more] = mixed(out[more] ^ mixed((eight[self.starts[more] + at] & _MASK[np.minimum(size[more] - at, 8)]) + np.uint64(at)))
            at += 8
            more = more[size[more] > at]
        for i in np.flatnonzero(size > TOGETHER).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return out


def arrow_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array | pa.ChunkedArray, letters: np.ndarray, size: int = BLOCK, lower: bool = True) -> Iterator[Block]:
    data, at = arrow_bytes(texts)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield Block(row, data[at[row] : at[end]], at[row : end + 1] - at[row], letters, lower)
        row = end


def windows(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of k words in each text, and where each text's windows begin. A text of fewer words, but not none, is one window."""
    counts = np.diff(at)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(k, dtype=np.uint64)])
    sums = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        sums += padded[i : i + n] * _PLACE[i]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = at[short]
        total = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            total += np.where(i < counts[short], padded[first + i], np.uint64(0)) * _PLACE[i]
        sums[first] = total + counts[short].astype(np.uint64) * _PLACE[-1]
    # word i begins a window unless it is one of the last k - 1 of a longer text, or any but the first of a short one
    skip = np.zeros(n + 1, dtype=np.int64)
    lost = np.flatnonzero(counts > made)
    np.add.at(skip, (at[:-1] + made)[lost], 1)
    np.add.at(skip, at[1:][lost], -1)
    return mixed(sums[np.cumsum(skip[:-1]) == 0]), begin
