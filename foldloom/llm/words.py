"""Words of Arrow text columns as numpy arrays: bounds, ids and 64-bit hashes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Those six bytes never occur inside
a multi-byte UTF-8 character, so the bounds are found on the raw buffer without decoding.
A null text has no words.  All functions work on slices of a few megabytes, whatever the
size of the Arrow batch; one text is never cut, so a slice is as large as its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: of slices whose words are hashed, which takes some fifty bytes a byte of text for a moment
HASHED_BYTES = 1 << 18
#: greatest length of the kept tables of powers: a slice, and a text that ends it
KEPT_POWERS = SLICE_BYTES + (1 << 16)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# odd multipliers of the polynomial hashes, fixed values
BASE = 0x9E3779B97F4A7C15
GRAM = 0xD6E8FEB86659FD93


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each one starts (one offset more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take ``most`` bytes together (or a single row)."""
    _, offsets = buffer_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, Arrow gives freed memory back, which a waiting worker would keep."""
    yield from batches
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of several texts: ``data[starts[i]:ends[i]]``; those of row r are first[r]:first[r + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffer_of(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = before[1:].copy()
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    follows = np.zeros(len(data), bool)
    follows[:-1] = after[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    follows[last] = False
    ends = np.flatnonzero(inside & ~follows) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 … and its inverses, modulo 2^64, for n positions; one table of each base is kept."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = n if n > KEPT_POWERS else min(KEPT_POWERS, max(1 << 16, 1 << n.bit_length()))

        def powers(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        kept = powers(base), powers(pow(base, -1, 1 << 64))
        if size <= KEPT_POWERS:  # tables for longer texts go again
            _POWERS[base] = kept
    return kept[0][:n], kept[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of every run values[starts[i]:ends[i]], from one cumulative sum."""
    n = len(values)
    up, down = _powers(base, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(words: Words) -> np.ndarray:
    raw = run_hashes(words.data, words.starts, words.ends, BASE)
    length = (words.ends - words.starts).astype(np.uint64)
    return mixed(raw ^ (length * np.uint64(GRAM)))


def gram_hashes(hashes: np.ndarray, size: int, base: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` words from each position on; fewer than that many positions at the end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mixed(run_hashes(hashes, at, at + size, base) + np.uint64(size))


def word_list(words: Words, row: int) -> list[bytes]:
    a, b = words.first[row], words.first[row + 1]
    raw = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes()
    return raw.split() if b > a else []


def blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
