"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

``frequent_words`` counts the words of the whole corpus; the commonest ``LEXICON_WORDS`` are
compiled by ``Transducer.compile`` into a minimal automaton in which words share prefixes and
suffixes.  Each arc carries how many words sort before it, so the sum along a path is the number
of the word, which indexes the table of its token ids.  The automaton is one flat file that Spark
ships to every executor and that workers map into memory, all pieces of a slice walking it
together.  Words outside it are merged exactly, rank by rank.

Defined cases: a null text is the empty text (no ids, empty decoded text); special strings inside
a text give their special id; rows repeat independently; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldloom.llm.pieces import (
    SPACE,
    Merger,
    byte_of_char,
    cut,
    split_special,
    spread,
    vocabulary,
)
from foldloom.llm.store import Scratch
from foldloom.llm.words import released, slices

LEXICON_WORDS = 1 << 15

#: (application, file name) of the lexicons that Spark distributes already
_SHIPPED: set[tuple[str, str]] = set()


class Transducer:
    """Minimal acyclic automaton over bytes; ``find`` gives each word's number or -1."""

    def __init__(self, flat: np.ndarray):
        head = flat[:4].astype(np.int64)
        cuts = np.cumsum([4, *head[[0, 0, 0, 1, 2]]])
        self.keys, self.targets, self.before, self.final, self.offsets = (
            flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)
        )
        self.outputs = flat[cuts[-1] : cuts[-1] + head[3]]

    @staticmethod
    def compile(entries: dict[bytes, np.ndarray]) -> np.ndarray:
        """Words are added in order; a finished branch is replaced by an equal state if there is one."""
        words = sorted(entries)
        known: dict[tuple, int] = {}
        states: list[tuple] = []

        def settled(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        # path[i] = [final, arcs] after i bytes of the last word; an arc is (byte, state)
        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            while len(path) - 1 > same:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settled(node)))
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settled(node)))
        root = settled(path[0])

        below: list[int] = []
        keys, targets, before = [], [], []
        for number, (final, arcs) in enumerate(states):  # targets come before their sources
            count = int(final)
            for byte, target in arcs:
                keys.append(number << 8 | byte)
                targets.append(target)
                before.append(count)
                count += below[target]
            below.append(count)
        order = np.argsort(keys, kind="stable") if keys else np.zeros(0, np.int64)
        outputs = [entries[w] for w in words]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in outputs]))) if outputs else np.zeros(1)
        flat = [
            [len(keys), len(states) + 1, len(offsets), sum(map(len, outputs))],
            np.asarray(keys, np.int64)[order],
            np.asarray(targets, np.int64)[order],
            np.asarray(before, np.int64)[order],
            [*(int(f) for f, _ in states), root],  # the last entry is the root's number
            offsets,
            [x for out in outputs for x in out],
        ]
        return np.concatenate([np.asarray(x, np.int64) for x in flat]).astype(np.int32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        state = np.full(len(starts), self.final[-1], np.int64)
        number = np.zeros(len(starts), np.int64)
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(starts < ends)
        at = 0
        while len(live) and len(self.keys):
            key = state[live] << 8 | data[starts[live] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            number[live] += self.before[arc]
            state[live] = self.targets[arc]
            at += 1
            done = starts[live] + at == ends[live]
            ended = live[done]
            out[ended] = np.where(self.final[state[ended]] == 1, number[ended], -1)
            live = live[~done]
        return out


def normalised(text: str) -> str:
    """NFC and lower case by character (no final sigma); white space only separates pieces."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _runs(texts: list[str | None], special: dict[str, int]) -> tuple[list[str], list[list[int]]]:
    """Normalised runs of ordinary text, and per text its runs (>= 0) and special ids (< 0: -1 - id)."""
    runs: list[str] = []
    plan: list[list[int]] = []
    for text in texts:
        own: list[int] = []
        for part in split_special(text or "", special):
            if isinstance(part, str):
                own.append(len(runs))
                runs.append(normalised(part))
            else:
                own.append(-1 - part)
        plan.append(own)
    return runs, plan


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The commonest pieces of the corpus, counted over all texts: at most ``most``.

    Counts are banded, eight bands to a doubling; the highest bands that hold ``most`` pieces
    together are taken whole, so the driver gets the bands' sizes and those pieces only.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(path).special
        for batch in batches:
            for part in slices(batch, "text"):
                runs, _ = _runs(part.column("text").to_pylist(), special)
                pieces = cut(runs, False, True)
                n = np.bincount(pieces.ids[pieces.kinds != SPACE], minlength=len(pieces.distinct))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pieces.distinct.take(pa.array(seen)).cast(pa.binary()), pa.array(n[seen], pa.int64())],
                    ["piece", "n"],
                )

    table = docs.select("text").mapInArrow(lambda batches: released(counted(batches)), "piece binary, n long")
    band = F.floor(8 * F.log2(F.sum("n").cast("double"))).cast("int").alias("band")
    with Scratch(docs.sparkSession) as scratch:
        bands = scratch.save(table.groupBy("piece").agg(band))
        sizes = sorted(((r["band"], r["n"]) for r in bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        lowest, held = None, 0
        for number, n in sizes:
            if held + n > most:
                break
            lowest, held = number, held + n
        if lowest is None:
            return []
        return [bytes(r["piece"]) for r in bands.filter(F.col("band") >= lowest).select("piece").collect()]


def ship_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon and give it to Spark's file distribution; returns the file's name."""
    words = frequent_words(docs, path, most)
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    ids, counts = Merger(vocabulary(path)).merge(data, ends - size, ends)
    flat = Transducer.compile(dict(zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if words else {})
    name = f"lexicon-{hashlib.sha256(flat.tobytes()).hexdigest()[:16]}.npy"
    context = docs.sparkSession.sparkContext
    if (context.applicationId, name) in _SHIPPED:
        return name
    # Spark's file server reads the file whenever an executor asks, so it stays as long as the driver
    folder = tempfile.mkdtemp(prefix="foldloom-lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    np.save(f"{folder}/{name}", flat)
    context.addFile(f"{folder}/{name}")
    _SHIPPED.add((context.applicationId, name))
    return name


class Encoder:
    """Ids and decoded bytes of distinct pieces, from the mapped lexicon or by merging."""

    def __init__(self, path: str, lexicon: str | None):
        self.vocab = vocabulary(path)
        self.lexicon = Transducer(np.load(SparkFiles.get(lexicon), mmap_mode="r")) if lexicon else None
        self.merger = Merger(self.vocab)
        names = [s.encode() for s in self.vocab.strings]
        self.names = np.frombuffer(b"".join(s + b" " for s in names), np.uint8)
        self.name_at = np.concatenate(([0], np.cumsum([len(s) + 1 for s in names])))

    def table(self, distinct: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the wanted distinct pieces laid end to end, and where each piece's ids start."""
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        known = np.full(len(distinct), -1, np.int64)
        if self.lexicon is not None:
            known[wanted] = self.lexicon.find(data, offsets[:-1][wanted], offsets[1:][wanted])
        rest = wanted[known[wanted] < 0]
        merged, counts = self.merger.merge(data, offsets[:-1][rest], offsets[1:][rest])
        size = np.zeros(len(distinct), np.int64)
        size[rest] = counts
        found = wanted[known[wanted] >= 0]
        if self.lexicon is not None:
            at = self.lexicon.offsets
            size[found] = at[known[found] + 1] - at[known[found]]
        start = np.concatenate(([0], np.cumsum(size)))
        flat = np.zeros(start[-1], np.uint32)
        flat[spread(start[rest], size[rest])] = merged
        if len(found):
            flat[spread(start[found], size[found])] = self.lexicon.outputs[spread(at[known[found]], size[found])]
        return flat, start

    def decoded(self, ids: np.ndarray) -> bytes:
        """The token strings joined by a space, which is what a vocabulary without decoder gives."""
        size = (self.name_at[1:] - self.name_at[:-1])[ids]
        return self.names[spread(self.name_at[ids], size)].tobytes()[:-1]


@cache
def _encoder(path: str, lexicon: str | None) -> Encoder:
    return Encoder(path, lexicon)


def encode_texts(texts: list[str | None], encoder: Encoder) -> list[np.ndarray]:
    runs, plan = _runs(texts, encoder.vocab.special)
    pieces = cut(runs, False, True)
    used = pieces.kinds != SPACE
    wanted = np.flatnonzero(np.bincount(pieces.ids[used], minlength=len(pieces.distinct)))
    flat, start = encoder.table(pieces.distinct, wanted)
    out = []
    for own in plan:
        parts = []
        for run in own:
            if run < 0:
                parts.append(np.array([-1 - run], np.uint32))
                continue
            a, b = pieces.first[run], pieces.first[run + 1]
            ids = pieces.ids[a:b][used[a:b]]
            parts.append(flat[spread(start[ids], start[ids + 1] - start[ids])])
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
    return out


def encode(docs: DataFrame, path: str, text: str = "text", lexicon: str | None = None) -> DataFrame:
    """``docs`` plus n_tokens, ids (little-endian 32-bit) and decoded (UTF-8).

    ``lexicon`` names a file of ``ship_lexicon``; it is built from ``docs`` when missing.
    Columns of ``docs`` with these names are replaced.
    """
    own = ("n_tokens", "ids", "decoded")
    kept = [c for c in docs.columns if c not in own]
    docs = docs.select(*kept)
    lexicon = lexicon or ship_lexicon(docs.select(F.col(text).alias("text")), path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, lexicon)
        for batch in batches:
            for part in slices(batch, text):
                ids = encode_texts(part.column(text).to_pylist(), encoder)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([encoder.decoded(x) for x in ids], pa.binary()),
                    ],
                    [*kept, *own],
                )

    schema = StructType(list(docs.schema.fields)).add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")
    return docs.mapInArrow(lambda batches: released(encoded(batches)), schema)


def decode_ids(ids: bytes, path: str) -> str:
    """Decoded text of one encoded document."""
    return _encoder(path, None).decoded(np.frombuffer(ids, "<u4")).decode()


def words_of_ids(ids: bytes, path: str) -> str:
    """Readable text: the bytes behind the tokens, a space after each word."""
    vocab, back = vocabulary(path), byte_of_char()
    out = bytearray()
    for i in np.frombuffer(ids, "<u4"):
        token = vocab.strings[i]
        ends = vocab.suffix and token.endswith(vocab.suffix)
        out += bytes(back.get(c, 63) for c in (token.removesuffix(vocab.suffix) if ends else token))
        out += b" " * bool(ends)
    return out.decode(errors="replace").rstrip()

