"""Exact token counts of every prefix of a text, by dynamic programming over byte-pair tokens.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are what their
joined bytes encode to.  So the last token of a prefix is the one token that ends there, whose
start is a prefix with a compatible last token, and its count is that prefix's count plus one:
each piece of a text gets the counts of all its prefixes in one sweep, without encoding any
prefix.  Counts add up over the pieces that pre-tokenisation cuts; where a prefix would be cut
differently from the whole text (white-space runs, contractions, special strings) the counts of
those positions are set to those of the prefix as it stands.

Short pieces advance together, byte by byte; a piece of over ``LONE`` bytes is swept on its own, in
time and memory proportional to its length.

``count_prefixes`` stores the counts as one difference per character.  ``count_at`` and
``longest_within`` then answer truncation and budget questions by a running sum.

Defined cases: a null text is the empty text (0 tokens, empty prefix column); special strings in a
text count as their one special token; rows repeat independently; an empty table gives an empty
result; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from foldloom.llm.pieces import SPACE, Merger, byte_of_char, char_classes, cut, spread, vocabulary
from foldloom.llm.words import mixed, slices

KNOWN_BITS = 19
LONE = 256  # bytes of a piece from which on it is swept alone
LONE_PAIRS = 1 << 18  # checked pairs that the sweep of a lone piece remembers
CONTRACTIONS = (b"'re", b"'ve", b"'ll")  # of two letters, which stand apart while incomplete


class TokenSuffixes:
    """Automaton over all tokens: the longest token that ends after each byte, and the next shorter ones."""

    def __init__(self, tokens: dict[int, bytes]):
        ids = np.array(list(tokens), np.int64)
        size = np.array([len(b) for b in tokens.values()], np.int64)
        order = np.argsort(-size, kind="stable")
        ids, size = ids[order], size[order]
        data = np.frombuffer(b"".join(tokens.values()), np.uint8).astype(np.int64)
        at = (np.cumsum([len(b) for b in tokens.values()]) - [len(b) for b in tokens.values()])[order]
        node = np.zeros(len(ids), np.int64)
        self.keys = np.zeros(0, np.int64)  # source state << 8 | byte, ascending; the target is the place + 1
        self.fail = np.zeros(1, np.int64)
        self.longest = np.full(1, -1, np.int64)
        self.size = np.zeros(max(tokens) + 1, np.int64)
        self.size[ids] = size
        self.shorter = np.full(max(tokens) + 1, -1, np.int64)
        for depth in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -depth))  # tokens of more than ``depth`` bytes
            keys, node_of = np.unique(node[:live] << 8 | data[at[:live] + depth], return_inverse=True)
            parent, byte = keys >> 8, keys & 255
            fail = self.step(self.fail[parent], byte) if depth else np.zeros(len(keys), np.int64)
            token = np.full(len(keys), -1, np.int64)
            own = np.flatnonzero(size[:live] == depth + 1)
            token[node_of[own]] = ids[own]
            self.shorter[ids[own]] = self.longest[fail[node_of[own]]]
            first = len(self.keys) + 1
            self.keys = np.concatenate((self.keys, keys))
            self.fail = np.concatenate((self.fail, fail))
            self.longest = np.concatenate((self.longest, np.where(token >= 0, token, self.longest[fail])))
            node[:live] = first + node_of

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        left, state = np.arange(len(state)), state.copy()
        while len(left):
            key = state << 8 | byte[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[left[hit]] = at[hit] + 1
            on = ~hit & (state > 0)  # at the root, a byte without a way on stays there
            left, state = left[on], self.fail[state[on]]
        return out


class LoneSweep:
    """The sweep of one long piece, on plain lists: a step per byte, whatever the length."""

    def __init__(self, counter: PrefixCounter):
        suffixes, merger = counter.suffixes, counter.merger
        self.way = dict(zip(suffixes.keys.tolist(), range(1, len(suffixes.keys) + 1), strict=True))
        self.fail, self.longest = suffixes.fail.tolist(), suffixes.longest.tolist()
        self.size, self.shorter = suffixes.size.tolist(), suffixes.shorter.tolist()
        self.made, self.left, self.right = counter.made.tolist(), counter.left.tolist(), counter.right.tolist()
        self.alone = counter.alone.tolist()
        self.merges, self.never = merger.merges, merger.never
        self.known: dict[tuple[int, int], bool] = {}

    def _check(self, a: int, b: int) -> bool:
        """``PrefixCounter._check`` of one pair."""
        until = self.never
        while True:
            merge = self.merges.get((a, b))
            if merge is not None and merge[0] < until:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_b >= made_a:
                until, b = made_b + 1, self.left[b]
            else:
                until, a = made_a, self.right[a]

    def fit(self, before: int, token: int) -> bool:
        if before < 0:
            return self.alone[token]
        found = self.known.get((before, token))
        if found is None:
            if len(self.known) >= LONE_PAIRS:
                self.known.clear()
            found = self.known[before, token] = self._check(before, token)
        return found

    def counts(self, piece: bytes) -> np.ndarray:
        """Tokens of every byte prefix."""
        way, fail, size = self.way, self.fail, self.size
        last, count = array("i", [-1]), array("q", [0])
        state = 0
        for depth, byte in enumerate(piece, 1):
            while (to := way.get(state << 8 | byte)) is None and state:
                state = fail[state]
            state = to or 0
            token = self.longest[state]
            while not self.fit(last[depth - size[token]], token):
                token = self.shorter[token]
            last.append(token)
            count.append(count[depth - size[token]] + 1)
        return np.frombuffer(count, np.int64)[1:]


class PrefixCounter:
    """Counts of all prefixes of pieces, for one byte-level vocabulary file."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        back = byte_of_char()
        tokens = {i: bytes(back[c] for c in s) for s, i in vocab.tokens.items()}
        self.special = vocab.special
        self.merger = Merger(vocab)
        self.suffixes = TokenSuffixes(tokens)
        n = max(tokens) + 1
        self.made = np.full(n, -1, np.int64)  # rank of the merge that makes a token, and its two parts
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for (a, b), (rank, new) in vocab.merges.items():
            self.made[new], self.left[new], self.right[new] = rank, a, b
        data = np.frombuffer(b"".join(tokens.values()), np.uint8)
        ends = np.cumsum([len(b) for b in tokens.values()])
        _, parts = self.merger.merge(data, ends - [len(b) for b in tokens.values()], ends)
        self.alone = np.zeros(n, bool)
        self.alone[list(tokens)] = parts == 1
        # pairs checked before: a table with one place for each key's hash, the newest stays
        self.known = np.full(1 << KNOWN_BITS, -1, np.int64)
        self.known_fit = np.zeros(1 << KNOWN_BITS, bool)

    @cached_property
    def lone(self) -> LoneSweep:
        return LoneSweep(self)

    def _check(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether ``token`` may follow ``before`` in an encoding.

        The merges that build both tokens are undone from the last one on.  In each state the two
        symbols that touch must not merge before the symbol that the undone merge took is gone; of
        equal ranks the left one is first.
        """
        out = np.zeros(len(before), bool)
        left = np.arange(len(before))
        a, b = before.copy(), token.copy()
        until = np.full(len(a), self.merger.never, np.int64)  # a merge of the two must not come before
        while len(left):
            clash = self.merger.rank(a, b) < until
            made_a, made_b = self.made[a], self.made[b]
            over = ~clash & (made_a < 0) & (made_b < 0)
            out[left[over]] = True
            on = ~clash & ~over
            left, a, b, made_a, made_b = left[on], a[on], b[on], made_a[on], made_b[on]
            undo_b = made_b >= made_a
            until = np.where(undo_b, made_b + 1, made_a)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return out

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = self.alone[token]  # where nothing is before
        at = np.flatnonzero(before >= 0)
        key = before[at] << 20 | token[at]
        place = (mixed(key.astype(np.uint64)) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        new = np.unique(key[self.known[place] != key])
        fits = self._check(new >> 20, new & 0xFFFFF)
        found = self.known_fit[place]
        miss = np.flatnonzero(self.known[place] != key)
        found[miss] = fits[np.searchsorted(new, key[miss])]
        self.known[place[miss]] = key[miss]
        last = np.flatnonzero(self.known[place[miss]] == key[miss])  # the key that stayed, where several share a place
        self.known_fit[place[miss[last]]] = found[miss[last]]
        out[at] = found
        return out

    def sweep(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of every byte prefix of every piece data[starts[i]:starts[i] + sizes[i]], end to end."""
        long = sizes > LONE
        if not long.any():
            return self._sweep(data, starts, sizes)
        out = np.empty(sizes.sum(), np.int64)
        first = np.cumsum(sizes) - sizes
        out[spread(first[~long], sizes[~long])] = self._sweep(data, starts[~long], sizes[~long])
        for i in np.flatnonzero(long):
            out[first[i] : first[i] + sizes[i]] = self.lone.counts(data[starts[i] : starts[i] + sizes[i]].tobytes())
        return out

    def _sweep(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for short pieces, which all advance byte by byte; those that begin alike share that state."""
        order = np.argsort(-sizes, kind="stable")
        starts, size = starts[order], sizes[order]
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size, -np.arange(longest), "left")  # pieces of more than so many bytes
        level = np.concatenate(([0], np.cumsum(live)))
        node_at = np.zeros(level[-1], np.int64)  # by depth and piece: the state after so many bytes
        state, last, count = np.zeros(1, np.int64), np.full(1, -1, np.int64), np.zeros(1, np.int64)
        node = np.zeros(len(size), np.int64)
        for depth in range(longest):
            n = live[depth]
            byte = data[starts[:n] + depth].astype(np.int64)
            keys, row, node_of = np.unique(node[:n] << 8 | byte, return_index=True, return_inverse=True)
            new_state = self.suffixes.step(state[keys >> 8], keys & 255)
            token = self.suffixes.longest[new_state]
            new_last, new_count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
            left = np.arange(len(keys))
            while len(left):
                start = depth + 1 - self.suffixes.size[token]
                source = np.where(start > 0, node_at[level[np.maximum(start, 1) - 1] + row[left]], 0)
                fit = self.fit(last[source], token)
                new_last[left[fit]], new_count[left[fit]] = token[fit], count[source[fit]] + 1
                left, token = left[~fit], self.suffixes.shorter[token[~fit]]
            first = len(state)
            state = np.concatenate((state, new_state))
            last, count = np.concatenate((last, new_last)), np.concatenate((count, new_count))
            node[:n] = first + node_of
            node_at[level[depth] : level[depth + 1]] = node[:n]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        total = sizes.sum()
        piece = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return count[node_at[level[depth] + back[piece]]]

    def char_counts(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the end of every character of the pieces raw[bounds[i]:bounds[i + 1]], and where each starts."""
        data = np.frombuffer(raw + b"\0", np.uint8)
        counts = self.sweep(data, bounds[:-1], np.diff(bounds))
        for i in np.flatnonzero((np.diff(bounds) == 3) & (data[bounds[:-1]] == 39)):
            if raw[bounds[i] : bounds[i + 1]] in CONTRACTIONS:
                counts[bounds[i] + 1] = 2
        ends = (data[1:] & 0xC0) != 0x80  # the next byte starts a character
        at = np.concatenate(([0], np.cumsum(ends)))
        return counts[ends], at[bounds]

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every character of every run, counted from the run's start; where runs start."""
        pieces = cut(runs, True, False)
        n = len(pieces.ids)
        if not n:
            return np.zeros(0, np.int64), pieces.run_chars
        bounds = np.frombuffer(pieces.distinct.buffers()[1], np.int64)[: len(pieces.distinct) + 1]
        flat, start = self.char_counts(pieces.distinct.buffers()[2].to_pybytes()[: bounds[-1]], bounds)
        size, start = np.diff(start), start[:-1]
        total = flat[start + size - 1][pieces.ids]
        before = np.cumsum(total) - total
        run_of = np.searchsorted(pieces.first, np.arange(n), "right") - 1
        before -= before[np.minimum(pieces.first[:-1], n - 1)][run_of]
        own = size[pieces.ids]
        out = flat[spread(start[pieces.ids], own)] + np.repeat(before, own)
        # white space whose last character stands apart: one piece, if the text ended there
        blank = (pieces.kinds == SPACE) & (char_classes()[pieces.codes[pieces.chars[1:] - 1]] == SPACE)
        at = np.flatnonzero(blank[:-1] & (pieces.kinds[1:] == SPACE) & (run_of[:-1] == run_of[1:]))
        spaces = [
            pieces.codes[a : b + 1].tobytes().decode("utf-32-le").encode()
            for a, b in zip(pieces.chars[at].tolist(), pieces.chars[at + 1].tolist(), strict=True)
        ]
        if spaces:
            ends = np.concatenate(([0], np.cumsum([len(x) for x in spaces])))
            flat, start = self.char_counts(b"".join(spaces), ends)
            out[pieces.chars[at + 1]] = before[at] + flat[start[1:] - 1]
        return out, pieces.run_chars

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Counts at the end of every character of every text."""
        runs: list[str] = []
        plan: list[list[tuple[int, int]]] = []
        special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        for text in texts:
            text, own, at = text or "", [], 0
            for hit in special.finditer(text):
                # the incomplete special string is ordinary text, so the run goes on into it
                own.append((len(runs), hit.start() - at))
                runs.append(text[at : hit.end() - 1])
                at = hit.end()
            if at < len(text):
                own.append((len(runs), len(text) - at))
                runs.append(text[at:])
            plan.append(own)
        counts, first = self.runs(runs)
        out = []
        for text, own in zip(texts, plan, strict=True):
            parts, before, done = [], 0, 0
            for run, size in own:
                local = counts[first[run] : first[run + 1]] + before
                parts.append(local)
                done += len(local)
                if len(local) > size or done < len(text or ""):
                    before += (int(counts[first[run] + size - 1]) if size else 0) + 1
                    parts.append(np.array([before]))
                    done += 1
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        return out


@cache
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_prefixes(docs: DataFrame, path: str, text: str = "text", limits: Sequence[int] = ()) -> DataFrame:
    """``docs`` plus n_bytes, n_tokens, prefix_counts and, per limit, longest_<limit>.

    prefix_counts holds one difference per character (see ``pack``); longest_<limit> is the number of
    characters of the longest prefix that has at most that many tokens.
    """
    own = ["n_bytes", "n_tokens", "prefix_counts", *[f"longest_{n}" for n in limits]]
    kept = [c for c in docs.columns if c not in own]
    docs = docs.select(*kept)
    schema = StructType(list(docs.schema.fields)).add("n_bytes", "long").add("n_tokens", "long").add("prefix_counts", "binary")
    for name in own[3:]:
        schema = schema.add(name, "long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                counts = counter.texts(texts)
                columns = [
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()),
                    pa.array([pack(c) for c in counts], pa.binary()),
                    *[pa.array([_longest(c, n) for c in counts], pa.int64()) for n in limits],
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*kept, *own])

    return docs.mapInArrow(counted, schema)


def pack(counts: np.ndarray) -> bytes:
    """Differences of neighbouring counts, little-endian: 16 bits each, or a zero byte and 32 bits each.

    The second form, of odd length, is for texts where two neighbouring prefixes differ by over 32 767.
    """
    steps = np.diff(counts, prepend=0)
    if len(steps) and np.abs(steps).max() > 32767:
        return b"\0" + steps.astype("<i4").tobytes()
    return steps.astype("<i2").tobytes()


def unpack(prefix_counts: bytes) -> np.ndarray:
    wide = len(prefix_counts) % 2
    return np.cumsum(np.frombuffer(prefix_counts, "<i4" if wide else "<i2", offset=wide), dtype=np.int64)


def _longest(counts: np.ndarray, limit: int) -> int:
    within = np.flatnonzero(counts <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def count_at(prefix_counts: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(unpack(prefix_counts)[chars - 1]) if chars else 0


def longest_within(prefix_counts: bytes, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens."""
    return _longest(unpack(prefix_counts), limit)
