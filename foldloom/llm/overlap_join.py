"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of distinct word shingles, as 64-bit hashes; two link when their sets overlap
enough (100 * intersection >= 80 * union).  A partner of a set of n shingles shares at least
T = ceil(0.8 n) of them, which is used three times, each time exactly:

1. *Prefixes.*  Sorted by hash, the first n - T + l shingles of linked sets have l in common.  Each
   document sends that prefix only; a set that shares too few with any other set is alone.
2. *Document frequencies.*  Among the sets left, shingles that one set alone holds cannot overlap.
   Sets with fewer than T shared shingles are alone.  The others, rarest shingles first, have a
   common shingle among the first m - T + 1 of their m shared ones, which ties sets that may link
   into blocks.
3. *T-occurrence search* in each block.  A set's inverted lists are divided: the short ones are
   heap-merged for the sets that occur in T - L of them, the L long ones are probed by binary
   search for those candidates only (DivideSkip), and candidates that reach the overlap are linked.
   Sets found are taken out of the lists at once, which keeps components and drops no link that
   would join two of them.

Blocks are bounded: one that holds more than ``BLOCK_TOKENS`` is dealt into pieces that each hold a
few common pivot sets.  Pieces are searched alone; afterwards only the sets outside the block's
largest component are compared with every piece, in blocks of both.

Copies: documents with equal sets are one set from step 2 on, with a number of its own.

Defined cases: a null text has no shingles; sets without shingles link with nothing; a row without doc_id
links like any other, gets the smallest doc_id of its component and null if that has none; rows that share a doc_id
are documents of their own, whose components may differ; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.llm.census import bucket_of, census, parts_of, runs_of, values
from foldloom.llm.components import components
from foldloom.llm.pieces import spread
from foldloom.llm.store import Scratch, attach, small_side
from foldloom.llm.words import (
    GRAM, HASHED_BYTES, Words, blobs, gram_hashes, mixed, released, run_hashes, slices, word_hashes, words_of,
)

SHINGLE = 5
#: prefix shingles that a task gathers before it asks about them
ASK_TOKENS = 1 << 19
BLOCK_TOKENS = 1 << 22
BLOCK_SETS = 1 << 14
PIVOTS = 16
#: cost of probing against merging in DivideSkip's choice of long lists
MU = 0.02
#: from this many entries on, short lists are merged by one sort, which is the same merge in arrays
HEAP_ENTRIES = 512
#: stands for the holders of a shingle that several sets of one batch hold
MANY = 0


def shingles(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            whole = run_hashes(hashes[a:b], np.array([0]), np.array([b - a]), GRAM)
            out.append(mixed(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n):
    """Least overlap of a set of n with any partner: ceil(0.8 n)."""
    return -(-4 * n // 5)


def spare(n):
    """Shingles that the prefixes of linked sets of n or more have in common, at least."""
    return np.maximum(1, n // 10)


def fingerprint(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.astype("<u8").tobytes(), digest_size=16).digest()


def _holder(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p[:8] for p in prints), "<u8") | np.uint64(1)


ASKED = """bucket long, tokens binary, holders binary, own binary, own_counts binary,
           doc_id long, n_shingles long, print binary"""
FOUND = "holder long, found long, doc_id long, n_shingles long, print binary"
ASKED_NAMES = ["bucket", "tokens", "holders", "own", "own_counts", "doc_id", "n_shingles", "print"]
FOUND_NAMES = ["holder", "found", "doc_id", "n_shingles", "print"]


def prefix(shingle_set: np.ndarray) -> np.ndarray:
    n = len(shingle_set)
    return shingle_set[: n - needed(n) + int(spare(n))].copy()


def _prefixes(distinct: dict[bytes, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Questions about the prefixes of distinct sets, by bucket, each shingle once."""
    parts = list(distinct.values())
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    holder = np.repeat(_holder(list(distinct)), [len(p) for p in parts])
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    start = runs_of(tokens)
    size = np.diff(np.append(start, len(tokens)))
    many = np.repeat(size > 1, size)
    asked = np.where(size > 1, np.uint64(MANY), holder[start])
    bucket, own_bucket = bucket_of(tokens[start], buckets), bucket_of(tokens[many], buckets)
    rows: list[list] = [[] for _ in ASKED_NAMES]
    cuts = np.append(runs_of(bucket), len(bucket))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        low, high = np.searchsorted(own_bucket, [bucket[a], bucket[a] + 1])
        own, counts = np.unique(holder[many][low:high], return_counts=True)
        row = [int(bucket[a]), tokens[start][a:b].tobytes(), asked[a:b].tobytes(), own.tobytes()]
        for column, value in zip(rows, [*row, counts.astype("<i4").tobytes(), None, None, None], strict=True):
            column.append(value)
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ASKED_NAMES)


def _shared(rows: pa.Table) -> pa.Table:
    """How many shingles of one bucket each set shares with another set; document rows pass."""
    facts = rows.filter(rows.column("print").is_valid())
    asked = rows.filter(rows.column("tokens").is_valid())
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if asked.num_rows:
        tokens = np.concatenate(values(asked.column("tokens"), "<u8"))
        holder = np.concatenate(values(asked.column("holders"), "<u8"))
        order = np.lexsort((holder, tokens))
        tokens, holder = tokens[order], holder[order]
        start = runs_of(tokens)
        size = np.diff(np.append(start, len(tokens)))
        last = start + size - 1
        # several holders, or one entry that stands for many of a slice
        several = np.repeat((holder[start] != holder[last]) | (holder[start] == MANY), size)
        hit = holder[several & (holder != MANY)]
        every = np.concatenate([hit, *values(asked.column("own"), "<u8")])
        weight = np.concatenate([np.ones(len(hit), np.int64), *values(asked.column("own_counts"), "<i4")])
        found, flat = np.unique(every, return_inverse=True)
        counts = np.bincount(flat, weights=weight, minlength=len(found)).astype(np.int64)
    none = pa.nulls(len(found))
    shared = pa.table(
        [pa.array(found.view(np.int64)), pa.array(counts), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())],
        names=FOUND_NAMES,
    )
    n = facts.num_rows
    passed = pa.table(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), facts["doc_id"], facts["n_shingles"], facts["print"]],
        names=FOUND_NAMES,
    )
    return pa.concat_tables([shared, passed])


def summaries(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, n_shingles, print) of all documents, and rows (holder, found) of shared prefixes."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: dict[bytes, np.ndarray] = {}
        gathered = 0
        for batch in batches:
            for part in slices(batch, "text", HASHED_BYTES):
                sets = shingles(words_of(part.column("text"), lower=True))
                prints = [fingerprint(s) for s in sets]
                n = len(sets)
                place = [p[0] * 256 + p[1] for p in prints]
                facts = [pa.array([x * buckets >> 16 for x in place], pa.int64()), *[pa.nulls(n, pa.binary())] * 4]
                facts += [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*facts, pa.array(prints, pa.binary())], ASKED_NAMES)
                for p, s in zip(prints, sets, strict=True):
                    if len(s) and p not in distinct:
                        distinct[p] = prefix(s)
                        gathered += len(distinct[p])
                if gathered >= ASK_TOKENS:
                    yield _prefixes(distinct, buckets)
                    distinct, gathered = {}, 0
        yield _prefixes(distinct, buckets)

    rows = docs.select("doc_id", "text").mapInArrow(lambda batches: released(asked(batches)), ASKED)
    return rows.groupBy("bucket").applyInArrow(_shared, FOUND)


class InvertedLists:
    """The sets of a block by shingle."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        tokens = np.concatenate([sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
        holder = np.repeat(members, [len(sets[i]) for i in members])
        order = np.argsort(tokens, kind="stable")  # members ascend, so every list does
        tokens, self.holder = tokens[order], holder[order]
        start = runs_of(tokens)
        self.token = tokens[start]
        self.start, self.size = start, np.diff(np.append(start, len(tokens)))

    def candidates(self, tokens: np.ndarray, least: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Living sets that hold at least ``least`` of the tokens, and how many: DivideSkip."""
        at = np.minimum(np.searchsorted(self.token, tokens), max(0, len(self.token) - 1))
        lists = at[self.token[at] == tokens] if len(self.token) else at[:0]
        if len(lists) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = lists[np.argsort(self.size[lists], kind="stable")]
        longest = int(self.size[lists[-1]])
        n_long = min(least - 1, int(least / (MU * log2(max(2, longest)) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, count = self._merged(short, alive)
        enough = count >= least - n_long
        found, count = found[enough], count[enough]
        if len(found) and n_long:
            count = count + self._probed(long, found)
            enough = count >= least
            found, count = found[enough], count[enough]
        return found, count

    def _merged(self, lists: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets on the lists, ascending, and on how many each is."""
        if self.size[lists].sum() < HEAP_ENTRIES:
            own = [self.holder[a : a + n].tolist() for a, n in zip(self.start[lists], self.size[lists], strict=True)]
            found, count = [], []
            for holder in heapq.merge(*own):
                if found and found[-1] == holder:
                    count[-1] += 1
                elif alive[holder]:
                    found.append(holder)
                    count.append(1)
            return np.array(found, np.int64), np.array(count, np.int64)
        every = self.holder[spread(self.start[lists], self.size[lists])]
        every = np.sort(every[alive[every]], kind="stable")
        start = runs_of(every)
        return every[start], np.diff(np.append(start, len(every)))

    def _probed(self, lists: np.ndarray, found: np.ndarray) -> np.ndarray:
        """On how many of the lists each candidate is, by binary search in every list."""
        low = np.repeat(self.start[lists], len(found))
        end = low + np.repeat(self.size[lists], len(found))
        want = np.tile(found, len(lists))
        high = end
        while (low < high).any():
            middle = (low + high) // 2
            less = (self.holder[np.minimum(middle, len(self.holder) - 1)] < want) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
        hit = (low < end) & (self.holder[np.minimum(low, len(self.holder) - 1)] == want)
        return hit.reshape(len(lists), len(found)).sum(axis=0)


def linked_sets(lists: InvertedLists, tokens: np.ndarray, n: int, sizes: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Living sets whose overlap with the given one is at least 0.8 of the union: 9 * overlap >= 4 * (n + n')."""
    found, overlap = lists.candidates(tokens, int(needed(n)), alive)
    return found[9 * overlap >= 4 * (n + sizes[found])]


def block_components(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The smallest id linked with each set, directly or through others."""
    out = ids.copy()
    by_id: dict[int, list[int]] = {}
    for i, x in enumerate(ids.tolist()):
        by_id.setdefault(x, []).append(i)
    alive = np.ones(len(ids), bool)
    left = len(ids)
    lists, held = InvertedLists(sets, np.arange(len(ids))), len(ids)
    for first in range(len(ids)):
        if not alive[first]:
            continue
        queue, group = [first], []
        alive[first] = False
        while queue:
            at = queue.pop()
            group.append(at)
            found = linked_sets(lists, sets[at], int(sizes[at]), sizes, alive).tolist()
            found += [i for i in by_id[int(ids[at])] if alive[i] and i not in found]
            alive[found] = False
            queue += found
        left -= len(group)
        out[group] = ids[group].min()
        if left and left < held // 2:
            lists, held = InvertedLists(sets, np.flatnonzero(alive)), left
    return out


SEARCHED = "rep long, component long"


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return table["rep"].to_numpy(), table["n"].to_numpy(), values(table["tokens"], "<u8")


def _search_block(table: pa.Table) -> pa.Table:
    ids, sizes, sets = _rows_of(table)
    return pa.table({"rep": ids, "component": block_components(ids, sizes, sets)})


def _search_across(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of the sets on the right with those on the left, one for each pair of components."""
    ids, sizes, sets = _rows_of(left)
    lists, alive = InvertedLists(sets, np.arange(len(ids))), np.ones(len(ids), bool)
    labels = left["component"].to_numpy() if left.num_rows else np.zeros(0, np.int64)
    pairs = set()
    for own, n, tokens in zip(right["component"].to_pylist(), right["n"].to_pylist(), values(right["tokens"], "<u8"), strict=True):
        found = linked_sets(lists, tokens, n, sizes, alive & (labels != own)) if len(ids) else []
        pairs |= {(own, int(x)) for x in labels[found]}
    return pa.table({"rep": pa.array([a for a, _ in pairs], pa.int64()), "component": pa.array([b for _, b in pairs], pa.int64())})


def _large_blocks(rows: DataFrame, blocks: DataFrame, block_tokens: int, block_sets: int, scratch: Scratch) -> DataFrame:
    """Components of the sets of blocks that are too large for one task: rep, component."""
    pieces = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("sets") / block_sets))
    large = blocks.select("block", pieces.cast("int").alias("pieces"), F.col("sets").alias("weight"))
    place = F.pmod(F.xxhash64(F.lit(3), "rep"), "pieces").cast("int")
    dealt = scratch.save(attach(rows, large, ["block"], "weight").withColumn("piece", place))
    pivots = dealt.groupBy("block").agg(
        F.slice(F.sort_array(F.collect_set(F.when(F.col("piece") == 0, F.col("rep")))), 1, PIVOTS).alias("reps")
    )
    # the pivots of a block go to each of its other pieces
    pivot = dealt.join(small_side(pivots.select("block", F.explode("reps").alias("rep"))), ["block", "rep"])
    copies = pivot.select(*rows.columns, "pieces", F.explode(F.expr("sequence(1, pieces)")).alias("piece"))
    together = dealt.unionByName(copies.filter("piece < pieces"))
    alone = together.groupBy("block", "piece").applyInArrow(lambda key, t: _search_block(t), SEARCHED)
    ties = alone.filter("rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b"))
    found = components(Scratch.kept(ties))
    found = found.withColumnRenamed("node", "rep")
    labelled = scratch.save(
        dealt.join(found, "rep", "left").withColumn("component", F.coalesce("component", F.col("rep")))
    )
    core = labelled.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"))
    core = core.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("core"))
    outside = attach(labelled, core.withColumn("w", F.lit(1)), ["block"], "w").filter("component <> core")
    sub = outside.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("tokens")).alias("bytes"))
    sub = sub.withColumn("parts", F.ceil(F.greatest(F.col("m") / block_sets, F.col("bytes") / (8 * block_tokens))).cast("int"))
    sub = Scratch.kept(sub.select("block", "parts", "m"))
    columns = ["block", "rep", "n", "tokens", "component"]
    # new names, as both sides of the cogroup come from one table
    asked = attach(outside, sub, ["block"], "m").select(
        *[F.col(c).alias(c) for c in columns],
        F.pmod(F.xxhash64(F.lit(4), "rep"), "parts").cast("int").alias("part"),
        F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"),
    )
    index = attach(labelled, sub, ["block"], "m").select(
        *columns, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "piece"
    )
    keys = ["block", "piece", "part"]
    across = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_across, SEARCHED)
    more = across.select(F.col("rep").alias("a"), F.col("component").alias("b"))
    final = components(Scratch.kept(more)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    out = labelled.select("rep", "component").join(final, "component", "left")
    return out.select("rep", F.coalesce("joined", "component").alias("component"))


def set_components(sets: DataFrame, scratch: Scratch, block_tokens: int, block_sets: int) -> DataFrame:
    """rep, component of the sets (id, n, tokens) that may link with another; others are alone."""

    def shared_only(rows: pa.Table, docs: list[np.ndarray], _: list[np.ndarray]) -> pa.Table:
        keep, tokens, rare = [], [], []
        sizes = rows["n"].to_numpy()
        for i, (own, held) in enumerate(zip(values(rows["tokens"], "<u8"), docs, strict=True)):
            m, least = int((held > 1).sum()), int(needed(sizes[i]))
            if m >= least:
                own, held = own[held > 1], held[held > 1]
                order = np.lexsort((own, held))
                keep.append(i)
                tokens.append(own)
                rare.append(own[order[: m - least + 1]].view(np.int64))
        columns = [rows["id"].take(pa.array(keep, pa.int64())), pa.array(sizes[keep], pa.int64()), blobs(tokens)]
        return pa.table([*columns, pa.array(rare, pa.list_(pa.int64()))], names=["rep", "n", "tokens", "rare"])

    counted = census(sets, shared_only, "rep long, n long, tokens binary, rare array<long>")
    rows = scratch.save(counted)
    lists = rows.select("rep", F.explode("rare").alias("token"))
    heads = lists.groupBy("token").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    ties = attach(lists, Scratch.kept(heads), ["token"], "sets").select(F.col("rep").alias("a"), "b")
    tied = components(ties).withColumnRenamed("node", "rep").withColumnRenamed("component", "block")
    rows = scratch.save(rows.select("rep", "n", "tokens").join(Scratch.kept(tied), "rep"))
    blocks = rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("sets"), F.sum(F.octet_length("tokens") / 8).alias("tokens")
    )
    large = Scratch.kept(blocks.filter((F.col("tokens") > block_tokens) | (F.col("sets") > block_sets)))
    if large.isEmpty():
        return rows.groupBy("block").applyInArrow(lambda key, t: _search_block(t), SEARCHED)
    small = rows.join(small_side(large.select("block")), "block", "left_anti")
    alone = small.groupBy("block").applyInArrow(lambda key, t: _search_block(t), SEARCHED)
    return alone.unionByName(_large_blocks(rows, large, block_tokens, block_sets, scratch))


def full_sets(docs: DataFrame) -> DataFrame:
    """id, print, n, tokens of every document."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED_BYTES):
                sets = shingles(words_of(part.column("text"), lower=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        blobs(sets),
                    ],
                    ["id", "print", "n", "tokens"],
                )

    schema = "id long, print binary, n long, tokens binary"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(computed(batches)), schema)


def duplicate_classes(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return classes(docs, block_tokens, block_sets).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, print, component, component_id of every document.

    ``print`` names the set, ``component`` (null without shingles) the component, also one without any doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as scratch:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # a byte of text gives about a twentieth of a prefix shingle
        found = scratch.save(summaries(docs, parts_of(size // 20)))
        facts = found.filter("print is not null").select("doc_id", "n_shingles", "print")
        counts = found.filter("holder is not null").groupBy("holder").agg(F.sum("found").alias("found"))
        sets = facts.filter("n_shingles > 0").groupBy("print", "n_shingles")
        sets = sets.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        # numbers of a written table, which stay
        sets = scratch.save(sets.withColumn("id", F.monotonically_increasing_id()))
        likely = scratch.save(_likely(sets, counts))
        tokens = scratch.save(_tokens(docs, likely))
        joined = set_components(tokens, scratch, block_tokens, block_sets)
        joined = Scratch.kept(joined.groupBy(F.col("rep").alias("id")).agg(F.min("component").alias("component")))
        # only sets that were searched can have a component of several
        searched = joined.join(sets.select("id", "rep"), "id")
        smallest = searched.groupBy("component").agg(F.min("rep").alias("least"))
        searched = searched.select("id", "component").join(smallest, "component")
        named = sets.join(searched, "id", "left").select(
            "print", "copies", F.coalesce("component", "id").alias("component"),
            F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least"),
        )
        out = attach(facts, Scratch.kept(named), ["print"], "copies", "left")
        smallest = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
        return scratch.kept(out.select("doc_id", "n_shingles", "print", "component", smallest.alias("component_id")))


def _tokens(docs: DataFrame, likely: DataFrame) -> DataFrame:
    """id, n, tokens of the likely sets, from a text of each."""
    numbers = likely.select("print", "id")
    texts = docs.join(small_side(likely.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = full_sets(texts).drop("id")
    if not likely.filter("rep is null").isEmpty():
        # sets that no numbered document has
        nameless = likely.filter("rep is null").select("print")
        own = full_sets(docs.filter("doc_id is null")).drop("id").join(small_side(nameless), "print", "left_semi")
        sets = sets.unionByName(own.groupBy("print").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    return sets.join(small_side(numbers), "print").select("id", "n", "tokens")


def with_print(docs: DataFrame) -> DataFrame:
    """``docs`` with the print of every text as ``_print``."""
    names = docs.columns

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED_BYTES):
                prints = [fingerprint(s) for s in shingles(words_of(part.column("text"), lower=True))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.binary())], [*names, "_print"])

    return docs.mapInArrow(lambda batches: released(computed(batches)), T.StructType([*docs.schema.fields, T.StructField("_print", T.BinaryType())]))


def _likely(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Sets whose prefix shares enough shingles with another set."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holder = _holder([p.as_py() for p in batch["print"]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(holder), *batch.columns], ["holder", *batch.schema.names])

    own = sets.select("print", "rep", "id", "n_shingles").mapInArrow(
        marked, "holder long, print binary, rep long, id long, n_shingles long"
    )
    least = F.greatest(F.lit(1), F.expr("((4 * n_shingles + 4) div 5) div 10"))
    return own.join(counts, "holder").filter(F.col("found") >= least).select("print", "rep", "id")
