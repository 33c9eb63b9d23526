"""Vocabulary files of public tokenizers, and pre-tokenisation of whole slices with numpy.

Both tokenizers cut a text by character class (letters, numbers, white space, others) plus the
English contractions.  The classes come from the tokenizers library's own regex engine, so they
are the library's Unicode tables.  Pieces are laid over the UTF-8 buffer as one Arrow string
array, whose dictionary encoding yields the distinct pieces exactly.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@cache
def char_classes() -> np.ndarray:
    """Class of every code point, as ``\\p{L}``, ``\\p{N}`` and ``\\s`` of the library see it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # surrogates have no UTF-8 form; planes from 4 on hold no letters, numbers or white space
    codes = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, codes))
    at = np.array(codes)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[at[a:b]] = kind
    return out


@cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


@cache
def byte_of_char() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


@dataclass
class Vocabulary:
    """Tokens, merge ranks by id pair, and special strings of a vocabulary file."""

    tokens: dict[str, int]
    strings: list[str]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    suffix: str


@cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    tokens = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (max([*tokens.values(), *special.values()]) + 1)
    for s, i in [*tokens.items(), *special.items()]:
        strings[i] = s
    merges = {(tokens[a], tokens[b]): (rank, tokens[a + b]) for rank, (a, b) in enumerate(model["merges"])}
    return Vocabulary(tokens, strings, merges, special, model.get("end_of_word_suffix") or "")


LONG = 64


class Merger:
    """Byte-pair merges of many pieces at once: in each, the lowest rank first, leftmost among equals."""

    def __init__(self, vocab: Vocabulary):
        chars = byte_chars()
        self.first = np.array([vocab.tokens[c] for c in chars], np.int64)
        self.last = np.array([vocab.tokens[c + vocab.suffix] for c in chars], np.int64)
        self.merges = vocab.merges
        pairs = np.array([a << 20 | b for a, b in vocab.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.ranks = order.astype(np.int64)  # a pair's rank is its place in the file
        self.made = np.array([new for _, new in vocab.merges.values()], np.int64)
        self.never = len(pairs)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), self.never - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.never)

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[starts[i]:ends[i]] (none empty) end to end, and how many each has."""
        size = ends - starts
        counts = np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(size > LONG):
            ids = self.first[data[starts[i] : ends[i]]]
            ids[-1] = self.last[data[ends[i] - 1]]
            ids = np.array(_merge_long(ids.tolist(), self.merges), np.int64)
            done.append((np.array([i]), np.array([len(ids)]), ids))
        rows = np.flatnonzero(size <= LONG)
        sym = self.first[data[spread(starts[rows], size[rows])]]
        cuts = np.cumsum(size[rows])
        sym[cuts - 1] = self.last[data[ends[rows] - 1]]
        heads = cuts - size[rows]
        rank = np.full(len(sym), self.never)
        if len(sym):
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[cuts - 1] = self.never
        while len(rows):
            length = np.diff(np.append(heads, len(sym)))
            best = np.minimum.reduceat(rank, heads)
            over = best == self.never
            if over.any():
                stay = np.repeat(~over, length)
                done.append((rows[over], length[over], sym[~stay]))
                sym, rank, rows, length, best = sym[stay], rank[stay], rows[~over], length[~over], best[~over]
                heads = np.cumsum(length) - length
                if not len(rows):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            owner = np.searchsorted(heads, hit, "right")
            hit = hit[np.concatenate(([True], owner[1:] != owner[:-1]))]  # the leftmost of each row
            sym[hit] = self.made[best]
            gone = np.ones(len(sym), bool)
            gone[hit + 1] = False
            sym, rank = sym[gone], rank[gone]
            at = hit - np.arange(len(hit))
            length = length - 1
            heads = np.cumsum(length) - length
            tail = heads + length - 1
            rank[at] = np.where(at == tail, self.never, self.rank(sym[at], sym[np.minimum(at + 1, len(sym) - 1)]))
            left = at[at > heads]
            rank[left - 1] = self.rank(sym[left - 1], sym[left])
        owners = np.concatenate([o for o, _, _ in done]) if done else np.zeros(0, np.int64)
        lengths = np.concatenate([n for _, n, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([f for _, _, f in done]) if done else np.zeros(0, np.int64)
        counts[owners] = lengths
        place = np.cumsum(lengths) - lengths
        order = np.argsort(owners, kind="stable")
        return flat[spread(place[order], lengths[order])], counts


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], …, starts[i] + sizes[i] - 1 of all i, one after another."""
    starts, sizes = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
    shift = starts - (np.cumsum(sizes) - sizes)
    return np.arange(sizes.sum()) + np.repeat(shift, sizes)


def _merge_long(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same for one piece of many symbols: linked positions and a heap."""
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get((a, b)))]
    heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else -1
            if right >= 0 and (m := merges.get((ids[left], ids[right]))):
                heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
    return [x for x in ids if x >= 0]


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """Runs of ordinary text and ids of special strings, leftmost first."""
    parts: list[str | int] = [text]
    for string, number in special.items():
        if string in text:
            parts = [
                x
                for part in parts
                for x in (
                    [y for i, run in enumerate(part.split(string)) for y in ([number] * (i > 0) + [run])]
                    if isinstance(part, str)
                    else [part]
                )
            ]
    return [p for p in parts if p != ""]


@dataclass
class Pieces:
    """Pieces of several runs of text, in order.

    ``chars`` bounds them in code points, ``kinds`` is the class of each one's first character,
    ``ids`` index ``distinct``; those of run r are first[r]:first[r + 1].
    """

    chars: np.ndarray
    kinds: np.ndarray
    ids: np.ndarray
    distinct: pa.Array
    first: np.ndarray
    codes: np.ndarray
    run_chars: np.ndarray


def cut(runs: list[str], joins_space: bool, single_numbers: bool) -> Pieces:
    """Pieces of every run.

    With ``joins_space`` a space goes to the piece after it and the white space before it is a
    piece of its own; else white space forms pieces that the caller drops.
    """
    text = "".join(runs)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    sizes = np.array([len(r) for r in runs], np.int64)
    run_chars = np.concatenate(([0], np.cumsum(sizes)))
    cls = char_classes()[codes]
    start = np.zeros(n + 1, bool)
    start[1:n] = cls[1:] != cls[:-1]
    edge = np.zeros(n + 1, bool)
    edge[run_chars] = True
    start |= edge
    if single_numbers and n:
        start[:n] |= cls == NUMBER
    # an apostrophe that no other symbol or joined space precedes, before s t m d re ve ll
    at = np.flatnonzero((codes == 39) & start[:n])
    if len(at):
        padded = np.concatenate((codes, np.zeros(3, np.uint32)))
        stop = run_chars[np.searchsorted(run_chars, at, "right")]
        one, two = padded[at + 1], padded[at + 2]
        if joins_space:
            free = (at == 0) | edge[at] | (codes[at - 1] != 32)
        else:
            free = np.ones(len(at), bool)
        short = free & (at + 1 < stop) & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        long = free & (at + 2 < stop) & (pairs[0] | pairs[1] | pairs[2])
        for mask, size in ((short, 2), (long, 3)):
            hit, limit = at[mask], stop[mask]
            start[hit + 1] = False
            start[(hit + size)[hit + size <= limit]] = True
    if joins_space and n:
        # white space before a visible character of the same run: its last character stands apart
        head = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~edge[1:n]) + 1
        start[head - 1] = True
        start[head[codes[head - 1] == 32]] = False
    bounds = np.flatnonzero(start)
    if not n:
        bounds = np.zeros(1, np.int64)
    kinds = cls[bounds[:-1]]
    width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
    at_byte = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    strings = pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(at_byte[bounds])), pa.py_buffer(text.encode())
    )
    encoded = strings.dictionary_encode()
    return Pieces(
        bounds,
        kinds,
        encoded.indices.to_numpy(zero_copy_only=False),
        encoded.dictionary,
        np.searchsorted(bounds, run_chars),
        codes,
        run_chars,
    )
