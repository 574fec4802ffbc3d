"""Words and shingles of whole texts as numpy arrays, many documents at a time.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D. Bytes of
multi-byte characters are never white space, so UTF-8 can be cut without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_BLOCK_WORDS = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20240607))
_odd = lambda *n: _random.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
_PLACES = _odd(64)
# A random number for each byte at each place of a block, for two independent hashes.
_BLOCK_BYTES = 64
_SEEDS = tuple(_odd(_BLOCK_BYTES, 256) for _ in range(2))
_FOLDED = tuple(t.copy() for t in _SEEDS)
for _t in _FOLDED:
    _t[:, 65:91] = _t[:, 97:123]
_STEPS = _odd(4)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, one row at least."""
    sizes = batch.column(text).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else [0]
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


@dataclass
class Words:
    """Words of a run of documents: byte ranges, and the first word of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def cut(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[offsets] = False
        starts = np.flatnonzero(inside & ~before)
        after = inside.copy()
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return cls(data, starts, ends, np.searchsorted(starts, offsets))

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Words:
        return cls.cut(*texts_of(column))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool = False, seed: int = 0) -> np.ndarray:
        """64 bits for each word; `fold` takes A-Z as a-z, and seeds 0 and 1 are independent.

        The bytes of a block of a word add up random numbers of their places. A block's sum is scrambled
        with the block's own place before the blocks are added, so no rule of arithmetic that holds for
        whole words makes two of them equal.
        """
        table = (_FOLDED if fold else _SEEDS)[seed].ravel()
        out = np.empty(len(self.starts), np.uint64)
        for low in range(0, len(out), _BLOCK_WORDS):
            starts, ends = self.starts[low : low + _BLOCK_WORDS], self.ends[low : low + _BLOCK_WORDS]
            lengths = ends - starts
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
            values = table[((place % _BLOCK_BYTES) << 8) + self.data[place + np.repeat(starts, lengths)]]
            blocks = -(-lengths // _BLOCK_BYTES)
            if len(lengths) and lengths.max() <= _BLOCK_BYTES:
                total = mix(np.add.reduceat(values, at) ^ _STEPS[seed])
            else:
                first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
                number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
                sums = np.add.reduceat(values, np.repeat(at, blocks) + number * _BLOCK_BYTES)
                total = np.add.reduceat(mix(sums ^ (_STEPS[seed] * (2 * number + 1).astype(np.uint64))), first)
            out[low : low + len(starts)] = mix(total + _STEPS[2 + seed] * lengths.astype(np.uint64))
        return out

    def runs(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """64 bits for `width` words from each word on, whatever document they are in."""
        n = max(len(hashes) - width + 1, 0)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += hashes[j : j + n] * _PLACES[j]
        return mix(total)


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingles, in 64 bits, of case-folded words.

    A text with fewer words than `width` has one shingle, its whole sequence; a text
    without words has none.
    """
    words = Words.of(column)
    hashes = words.hashes(fold=True)
    runs = words.runs(hashes, width)
    sets = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if high - low >= width:
            sets.append(np.unique(runs[low : high - width + 1]))
        elif high > low:
            short = (hashes[low:high] * _PLACES[: high - low]).sum(dtype=np.uint64) + _PLACES[63] * np.uint64(high - low)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
