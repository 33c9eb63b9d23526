"""Substring dedup with automata of repeated phrases.

A word goes if it lies in a window of ``WINDOW`` words that also starts in a document with a smaller
doc_id.  Finding them takes the same steps twice.

1. *Phrases.*  Of the ``PHRASE``-word phrases of each window, the one of least hash is selected, so
   equal windows select the same phrase.  A census of the selected phrases gives each one's first
   document, its owner.
2. *Automata.*  The owners' passages around their recurring phrases are dealt into shards of bounded
   size, each shard's phrases are compiled into an Aho-Corasick automaton, and the passages of the
   other documents that hold a phrase of the shard stream through it.  An owner with very many
   documents has its passages in several shards.  Every match is extended word by word to both
   sides; a run of at least ``WINDOW`` equal words is confirmed, and a passage tells the words that
   its runs cover together, which are at most a run for each ``WINDOW`` of its words.
3. *Windows left.*  A window may recur in another document than its phrase's owner.  The windows
   around recurring phrases that no run covers are hashed, a census gives their first documents, and
   the second round confirms them by automata whose phrases are the windows' beginnings.

Windows are judged on the input.  Documents whose word sequences are equal go through this once, as
the one of smallest doc_id; in the others every window recurs.

Defined cases: a null text has no words and stays null; texts shorter than a window stay as they
are; rows with a null doc_id come after all others and lose every window that any document with a
doc_id holds; rows that share a doc_id do not make each other's windows recur; an empty table gives
an empty result; extra columns are kept unless an output has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldloom.llm.census import census, values
from foldloom.llm.store import Scratch, attach, bounded, sifted, small_side
from foldloom.llm.words import HASHED_BYTES, gram_hashes, released, slices, word_hashes, word_list, words_of

WINDOW = 50
PHRASE = 25
#: bytes of passages that one automaton is built from, and that stream through it in one task
SHARD_BYTES = 1 << 20
STREAM_BYTES = 16 << 20
#: stands for a null doc_id inside, after all others
LAST = (1 << 63) - 1

PHRASES = "doc_id long, key long, n_words long, words_sha256 string, tokens binary, places binary"


def selected(hashes: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the position of the least hash among the ``reach`` positions from it on.

    Of equal hashes, which are the same phrase, that of least position modulo ``reach`` is taken,
    so that repetitive text selects no more positions than other text.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, (reach - 1).bit_length()))
    place = np.arange(len(hashes), dtype=np.uint64) % np.uint64(reach)
    low = (hashes >> bits) << bits | place
    size, least = 1, low
    while 2 * size <= reach:  # minima of 1, 2, 4, … positions
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[starts], least[starts + reach - size])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return starts + (at - starts) % reach


def digest(words: list[bytes]) -> tuple[str, int]:
    """SHA-256 of the words joined by one space, and its first 64 bits as a key."""
    found = hashlib.sha256(b" ".join(words))
    return found.hexdigest(), int.from_bytes(found.digest()[:8], "big", signed=True)


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Selected phrase hashes of every document, their places, and a digest of its words."""
    reach = window - phrase + 1

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED_BYTES):
                words = words_of(part.column("text"))
                grams = gram_hashes(word_hashes(words), phrase)
                row = np.repeat(np.arange(part.num_rows), words.counts)
                starts = np.flatnonzero(row[: max(0, len(row) - window + 1)] == row[window - 1 :])
                at = np.unique(selected(grams, starts, reach))
                cuts = np.searchsorted(at, words.first)
                digests = [digest(word_list(words, i)) for i in range(part.num_rows)]
                spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([k for _, k in digests], pa.int64()),
                        pa.array(words.counts, pa.int64()),
                        pa.array([d for d, _ in digests], pa.string()),
                        pa.array([grams[at[s]].astype("<u8").tobytes() for s in spans], pa.binary()),
                        pa.array([(at[s] - f).astype("<i4").tobytes() for s, f in zip(spans, words.first, strict=False)], pa.binary()),
                    ],
                    ["doc_id", "key", "n_words", "words_sha256", "tokens", "places"],
                )

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(computed(batches)), PHRASES)


CUT = "owner long, doc_id long, key long, start long, words binary, phrases binary"
CUT_NAMES = ["owner", "doc_id", "key", "start", "words", "phrases"]


def _passages(at: np.ndarray, words: list[bytes], reach: int, phrase: int) -> list[tuple]:
    """Passages around the phrases at ``at``, as far as windows with them reach; close ones are one."""
    out = []
    breaks = np.flatnonzero(np.diff(at) > 2 * reach + phrase) + 1
    for group in np.split(at, breaks):
        start, end = max(0, int(group[0]) - reach), min(len(words), int(group[-1]) + phrase + reach)
        out.append((start, b" ".join(words[start:end]), (group - start).astype("<i4").tobytes()))
    return out


def cut(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """Passages of documents (doc_id, key, text, places, first): what asks an owner, and the owners' own."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                rows = []
                docs, keys = part["doc_id"].to_pylist(), part["key"].to_pylist()
                marks = zip(values(part["places"], "<i4"), values(part["first"], "<i8"), strict=True)
                for row, (places, first) in enumerate(marks):
                    own = word_list(words, row)
                    for owner in np.unique(first).tolist():
                        found = _passages(np.unique(places[first == owner]), own, window - phrase, phrase)
                        rows += [(owner, docs[row], keys[row], *p) for p in found]
                kinds = [*[pa.int64()] * 4, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], CUT_NAMES
                )

    return texts.select("doc_id", "key", "text", "places", "first").mapInArrow(lambda batches: released(computed(batches)), CUT)


RUNS = "doc_id long, key long, start long, end long"


def joined(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs as disjoint ascending ones that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Automaton:
    """Phrases of owners' passages as sequences of word numbers, with the passages and places that hold them."""

    def __init__(self, rows: pa.Table, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.passages: list[tuple[int, list[bytes]]] = []
        self.number: dict[bytes, int] = {}
        held: dict[tuple, list[tuple[int, int]]] = {}
        for owner, words, places in zip(
            rows["owner"].to_pylist(), rows["words"].to_pylist(), values(rows["phrases"], "<i4"), strict=True
        ):
            own = words.split(b" ")
            for at in places.tolist():
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in own[at : at + phrase])
                held.setdefault(key, []).append((len(self.passages), at))
            self.passages.append((owner, own))
        for key, where in held.items():
            self.machine.add_word(key, where)
        if held:
            self.machine.make_automaton()

    def runs(self, doc: int, words: bytes) -> set[tuple[int, int]]:
        """Disjoint runs of words covered by windows that a passage of a smaller document holds as well.

        Repetitive text matches at very many offsets; their runs overlap, and only what they cover together is told.
        """
        if not len(self.machine):
            return set()
        own = words.split(b" ")
        out: set[tuple[int, int]] = set()
        reached: dict[tuple[int, int], int] = {}
        low, high = 0, 0  # the run that reaches furthest
        reach, phrase = self.window - self.phrase, self.phrase
        for end, where in self.machine.iter(tuple(self.number.get(w, 0) for w in own)):
            at = end + 1 - phrase
            if low <= max(0, at - reach) and min(len(own), at + self.window) <= high:
                continue  # all windows with this phrase lie in that run
            for number, place in where:
                owner, passage = self.passages[number]
                if owner >= doc or reached.get((number, at - place), -1) >= at:
                    continue
                a, b = at, place
                while a and b and own[a - 1] == passage[b - 1]:
                    a, b = a - 1, b - 1
                start = a
                a, b = at + phrase, place + phrase
                while a < len(own) and b < len(passage) and own[a] == passage[b]:
                    a, b = a + 1, b + 1
                reached[number, at - place] = a
                if a - start >= self.window:
                    out.add((start, a))
                    if a > high:
                        low, high = start, a
        return set(joined(out))


def confirm(passages: DataFrame, window: int, phrase: int, shard_bytes: int, stream_bytes: int, scratch: Scratch) -> DataFrame:
    """doc_id, start, end of runs of words that an owner's passage confirms."""
    passages = scratch.save(passages)
    size = F.octet_length("words") + F.octet_length("phrases")
    owners, asking = passages.filter("owner = doc_id"), passages.filter("owner <> doc_id")
    # owners are packed by their own size; each is repeated as often as what streams through it needs
    total = owners.agg(F.sum(size)).first()[0] or 0
    streams = asking.groupBy("owner").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    streams = streams.withColumn("copies", F.ceil(F.col("bytes") / stream_bytes).cast("int")).filter("copies > 1")
    hot = Scratch.kept(streams.select("owner", "copies", "n"))
    asked_bytes = asking.agg(F.sum(size)).first()[0] or 0
    shards = max(1, total // shard_bytes, asked_bytes // stream_bytes)

    def shard(salt: str) -> F.Column:
        return F.pmod(F.xxhash64("owner", salt), F.lit(shards))

    copies = F.coalesce("copies", F.lit(1))
    held = attach(owners, hot, ["owner"], "n", "left")
    held = held.select(
        "owner", "words", "phrases", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")
    ).withColumn("shard", shard("salt"))
    streamed = attach(asking, hot, ["owner"], "n", "left")
    salt = F.pmod(F.xxhash64("doc_id", "start"), copies).cast("int").alias("salt")
    # new names, as both sides of the cogroup come from one table
    streamed = streamed.select(
        *[F.col(c).alias(c) for c in ("owner", "doc_id", "key", "start", "words")], salt
    ).withColumn("shard", shard("salt"))

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = Automaton(left, window, phrase)
        rows = []
        for batch in right.to_batches(max_chunksize=1024):
            columns = [batch[c].to_pylist() for c in ("doc_id", "key", "start", "words")]
            for doc, key, start, words in zip(*columns, strict=True):
                rows += [(doc, key, start + a, start + b) for a, b in automaton.runs(doc, words)]
        names = ("doc_id", "key", "start", "end")
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)})

    found = held.groupBy("shard").cogroup(streamed.groupBy("shard")).applyInArrow(matched, RUNS)
    return scratch.save(found)


def windows_left(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """Hashes and places of the windows around recurring phrases of another owner that no run covers."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED_BYTES):
                words = words_of(part.column("text"))
                hashes = gram_hashes(word_hashes(words), window)
                docs, keys, runs = (part[c].to_pylist() for c in ("doc_id", "key", "runs"))
                marks = zip(values(part["places"], "<i4"), values(part["first"], "<i8"), strict=True)
                rows = []
                for row, (at, first) in enumerate(marks):
                    begin, n = words.first[row], int(words.counts[row]) - window + 1
                    edge = np.zeros(n + 1, np.int64)
                    at = at[first != docs[row]]
                    np.add.at(edge, np.maximum(0, at + phrase - window), 1)
                    np.add.at(edge, np.minimum(n, at + 1), -1)
                    left = np.cumsum(edge[:-1]) > 0
                    for run in runs[row] or []:
                        left[run["start"] : max(run["start"], run["end"] - window + 1)] = False
                    where = np.flatnonzero(left)
                    if len(where):
                        tokens = hashes[begin + where].astype("<u8").tobytes()
                        rows.append((docs[row], keys[row], tokens, where.astype("<i4").tobytes()))
                yield _batch(rows, ["id", "key", "tokens", "places"])

    columns = texts.select("doc_id", "key", "text", "places", "first", "runs")
    return columns.mapInArrow(lambda batches: released(computed(batches)), "id long, key long, tokens binary, places binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Two numbers, then two binary columns."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def recurring(rows: DataFrame) -> DataFrame:
    """doc_id, key, places, first of the tokens of rows (id, key, tokens, places) that several documents hold."""

    def kept(table: pa.Table, docs: list[np.ndarray], first: list[np.ndarray]) -> pa.Table:
        out = []
        ids = zip(table["id"].to_pylist(), table["key"].to_pylist(), strict=True)
        for (doc, key), places, held, owner in zip(ids, values(table["places"], "<i4"), docs, first, strict=True):
            again = held > 1
            if again.any():
                out.append((doc, key, places[again].tobytes(), owner[again].astype("<i8").tobytes()))
        return pa.Table.from_batches([_batch(out, ["doc_id", "key", "places", "first"])])

    return census(rows, kept, "doc_id long, key long, places binary, first binary")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _doc_id, which is never null, and _key, the key of its words."""
    schema = StructType([*docs.schema.fields, StructField("_key", LongType())])

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                keys = [digest(word_list(words, i))[1] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], schema.names)

    return docs.mapInArrow(lambda batches: released(computed(batches)), schema).withColumn("_doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))


def _candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, key, text, places, first of the documents that hold a recurring phrase."""
    ids = Scratch.kept(found.select("doc_id").distinct())
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi") if bounded(ids) else sifted(docs, ids, "doc_id")
    texts = keyed(texts)
    texts = texts.select("doc_id", F.col("_key").alias("key"), "text").dropDuplicates(["doc_id", "key"])
    return texts.join(found, ["doc_id", "key"])


def spans_of(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Runs as disjoint ascending spans of words."""
    return joined((r["start"], r["end"]) for r in runs or [])


SPANS = "doc_id long, key long, n_removed long, kept_sha256 string, spans array<struct<start long, end long>>"


def _judged(texts: DataFrame) -> DataFrame:
    """What the runs leave of each document (doc_id, key, text, runs)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                removed, digests, all_spans = [], [], []
                for row, runs in enumerate(part["runs"].to_pylist()):
                    spans, own = spans_of(runs), word_list(words, row)
                    for start, end in reversed(spans):
                        del own[start:end]
                    removed.append(sum(b - a for a, b in spans))
                    digests.append(digest(own)[0])
                    all_spans.append([{"start": a, "end": b} for a, b in spans])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["key"],
                        pa.array(removed, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(all_spans, span),
                    ],
                    ["doc_id", "key", "n_removed", "kept_sha256", "spans"],
                )

    return texts.select("doc_id", "key", "text", "runs").mapInArrow(lambda batches: released(computed(batches)), SPANS)


def repeated_passages(
    docs: DataFrame,
    window: int = WINDOW,
    phrase: int = PHRASE,
    shard_bytes: int = SHARD_BYTES,
    stream_bytes: int = STREAM_BYTES,
) -> DataFrame:
    """doc_id, key, n_words, n_removed, kept_sha256, spans of every document.

    spans are the words to remove, as [start, end); key names the document's word sequence.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    same = ["doc_id", "key"]
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.save(phrases(docs, window, phrase))
        facts = table.select("doc_id", "key", "n_words", "words_sha256")
        # word sequences of several rows, and the document that stands for them
        first = facts.groupBy("words_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
        first = Scratch.kept(first.filter("rows > 1"))
        own = attach(table.filter(F.octet_length("tokens") > 0), first, ["words_sha256"], "rows", "left")
        own = own.filter("first_id is null or doc_id = first_id")
        own = scratch.save(own.select(F.col("doc_id").alias("id"), "key", "tokens", "places"))
        found = scratch.save(recurring(own).dropDuplicates(same))
        # joined three times below, each time with little
        texts = scratch.bucketed(_candidates(docs, found), same)
        runs = confirm(cut(texts, window, phrase), window, phrase, shard_bytes, stream_bytes, scratch)
        by_doc = runs.groupBy(*same).agg(F.collect_set(F.struct("start", "end")).alias("runs"))
        waiting = windows_left(texts.join(by_doc, same, "left"), window, phrase)
        again = scratch.save(recurring(scratch.save(waiting)))
        again = texts.select(*same, "text").join(again, same)
        more = confirm(cut(again, window, phrase), window, phrase, shard_bytes, stream_bytes, scratch)
        by_doc = runs.unionByName(more).groupBy(*same).agg(F.collect_set(F.struct("start", "end")).alias("runs"))
        judged = Scratch.kept(_judged(texts.select(*same, "text").join(by_doc, same)))
        rows = attach(facts, first, ["words_sha256"], "rows", "left").join(judged, same, "left")
        copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)) & (F.col("n_words") >= window)
        whole = F.expr("array(named_struct('start', 0L, 'end', n_words))")
        out = rows.select(
            F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"),
            "key",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
            F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
        )
        return scratch.kept(out)


def without_passages(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with the repeated passages cut out of text; the white space before the next kept word goes too."""
    found = repeated_passages(docs, **options).filter("n_removed > 0")
    found = found.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("_doc_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans")
    ).dropDuplicates(["_doc_id", "_key"])
    joined = keyed(docs).join(small_side(Scratch.kept(found)), ["_doc_id", "_key"], "left")
    names = docs.columns
    joined = joined.select(*names, "_spans")

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                texts = part["text"].to_pylist()
                for row, spans in enumerate(part["_spans"].to_pylist()):
                    if spans:
                        at, base, end = words.first[row], words.offsets[row], words.offsets[row + 1]
                        raw = words.data[base:end].tobytes()
                        starts = [*(words.starts[at : words.first[row + 1]] - base).tolist(), len(raw)]
                        cuts = [0, *[starts[s[e]] for s in spans for e in ("start", "end")], len(raw)]
                        texts[row] = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode()
                columns = [pa.array(texts, pa.string()) if n == "text" else part[n] for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(lambda batches: released(computed(batches)), StructType(list(docs.schema.fields)))
