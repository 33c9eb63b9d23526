"""Statistics of whole texts, computed on slices of Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from foldloom.llm.words import SPACE, Words, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between successive bounds."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def string_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly for equal strings data[starts[i]:ends[i]] (ascending, disjoint)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    runs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return runs.dictionary_encode().indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)


def ranks(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on that are equal exactly for equal values."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ranks(a * (int(b.max(initial=0)) + 1) + b)


def repeated_words(words: Words) -> np.ndarray:
    """Per row, the words inside a window of WINDOW words that is found twice or more in the row's text."""
    n = len(words.starts)
    rows = len(words.first) - 1
    if n < WINDOW:
        return np.zeros(rows, np.int64)
    ids = string_ids(words.data, words.starts, words.ends)
    two = paired(ids[:-1], ids[1:])
    four = paired(two[:-2], two[2:])
    grams = paired(four[: n - WINDOW + 1], ids[WINDOW - 1 :])
    row = np.repeat(np.arange(rows), words.counts)
    inside = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    found = paired(row[inside], grams[inside])
    again = inside[np.bincount(found)[found] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return per_row(np.cumsum(edge[:-1]) > 0, words.first)


def duplicate_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the lines that hold a word, and those of them that equal an earlier line."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((offsets[1:], breaks)))
    row = np.sort(np.concatenate((np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1)))
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[full], ends[full], row[full]
    lines = np.bincount(row, minlength=rows)
    if not len(row):
        return lines, lines.copy()
    found = paired(row, string_ids(data, starts, ends))
    first = np.zeros(found.max() + 1, np.int64)
    first[found] = row
    return lines, lines - np.bincount(first, minlength=rows)


def stats_of(texts: pa.Array) -> dict[str, np.ndarray]:
    words = words_of(texts)
    lines, again = duplicate_lines(words)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_row(~SPACE[words.data] & ((words.data & 0xC0) != 0x80), words.offsets),
        "n_symbols": per_row(SYMBOLS[words.data], words.offsets),
        "n_lines": lines,
        "n_dup_lines": again,
        "n_repeat_words": repeated_words(words),
    }
