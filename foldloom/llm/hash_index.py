"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

``fit`` learns, on a bounded sample, two rotations of the centred vectors that bring them close to
the corners of a cube (iterative quantisation); the signs of the rotated vectors are the bits of a
code.  Every vector is coded.  The index is kept in shards of bounded size; in each, the codes are
cut into substrings of at most 16 bits, the logarithm of a shard's size, with a table from substring
to codes.  Probing goes outwards: after all patterns of up to f flipped bits in the first j of m
substrings, and up to f - 1 in the others, every code within (f - 1) m + j bits of the query has been
retrieved, because a code further on in every substring differs in more.  The radius grows from 0
until k codes lie ``margin`` bits inside it, so it follows the data: near codes end the search after
a few probes.  Codes within the radius are ordered by their original vectors.

The stated query set meets the shards in blocks: a task holds one shard and one block of queries and
returns the best k of that shard, so no task grows with the data.  Shards and blocks are of one size,
which sends the fewest copies for the memory of a task.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors whose length is not the sample's commonest; a null vec_id takes no part; equal vectors are
separate rows (distance 0, ties to the smaller vec_id); a vec_id that repeats is left out only where
it is the query's own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from foldloom.llm.pieces import spread
from foldloom.llm.store import first_by_hash

SAMPLE_ROWS = 10_000
ROUNDS = 30
ROTATIONS = 2
SUBSTRING = 16
#: bits by which the radius exceeds the k-th nearest code, as a share of a code's bits
MARGIN_SHARE = 0.085
SHARD_ROWS = 65_536
QUERY_ROWS = 65_536

RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Codes:
    """A centre and rotations (dimension × bits each) whose signs are the bits."""

    centre: np.ndarray
    rotations: list[np.ndarray]

    @property
    def bits(self) -> int:
        return sum(r.shape[1] for r in self.rotations)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One 64-bit word per rotation and vector."""
        words = []
        for rotation in self.rotations:
            bits = (vectors - self.centre) @ rotation > 0
            place = np.uint64(1) << np.arange(rotation.shape[1], dtype=np.uint64)
            words.append((bits * place).sum(axis=1, dtype=np.uint64))
        return np.stack(words, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part; floats stay floats until they are compared."""
    whole = F.col("embedding")
    if vectors.schema["embedding"].dataType.elementType not in (FloatType(), DoubleType()):
        whole = F.transform("embedding", lambda x: x.cast("double"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding"))
        .filter("vec_id is not null and embedding is not null and size(embedding) > 0")
        .filter(
            """forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))
               and exists(embedding, x -> x <> 0)"""
        )
    )


def fit(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Codes | None:
    """Learn the rotations on the ``sample_rows`` rows that come first by a hash of vec_id."""
    rows = first_by_hash(usable(vectors), "vec_id", sample_rows, seed).select("embedding").collect()
    if not rows:
        return None
    size = Counter(len(r[0]) for r in rows).most_common(1)[0][0]
    data = np.array([r[0] for r in rows if len(r[0]) == size])
    centre = data.mean(axis=0)
    data = data - centre
    bits = min(size, 64)
    axes = np.linalg.eigh(data.T @ data)[1][:, ::-1][:, :bits]
    flat = data @ axes
    rotations = []
    for number in range(ROTATIONS):
        turn = np.linalg.qr(np.random.default_rng(seed + number).normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        rotations.append(axes @ turn)
    return Codes(centre, rotations)


class SubstringIndex:
    """Tables from each substring's value to the codes that hold it."""

    def __init__(self, words: np.ndarray, bits: list[int]):
        self.words = words
        self.parts = [
            (word, low, min(SUBSTRING, n - low)) for word, n in enumerate(bits) for low in range(0, n, SUBSTRING)
        ]
        self.tables = []
        for word, low, width in self.parts:
            value = self.substring(words, word, low, width)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << width) + 1))))

    @staticmethod
    def substring(words: np.ndarray, word: int, low: int, width: int) -> np.ndarray:
        return ((words[:, word] >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def shells(self, query: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The radius up to which all codes are retrieved, the codes that came with it, and their distances.

        ``seen`` marks codes to leave out; those retrieved are marked in it.
        """
        values = [int(self.substring(query[None, :], *part)[0]) for part in self.parts]
        for flipped in range(max(width for _, _, width in self.parts) + 1):
            for number, (value, (_, _, width), (order, first)) in enumerate(
                zip(values, self.parts, self.tables, strict=True)
            ):
                probes = flips(width, flipped) ^ value
                sizes = first[probes + 1] - first[probes]
                hit = sizes > 0
                new = order[spread(first[probes[hit]], sizes[hit])]
                new = new[~seen[new]]
                seen[new] = True
                differing = np.bitwise_count(self.words[new] ^ query).sum(axis=1, dtype=np.int64)
                yield flipped * len(self.parts) + number, new, differing

    def nearest(self, query: np.ndarray, k: int, margin: int, seen: np.ndarray) -> np.ndarray:
        """Codes up to ``margin`` bits beyond the k-th nearest; all of them, if there are no more than k.

        ``seen`` marks codes that are no candidates; those retrieved are marked in it.
        """
        left = len(seen) - int(seen.sum())
        found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.zeros(64 * self.words.shape[1] + 1, np.int64)  # codes by distance
        for radius, new, differing in self.shells(query, seen):
            found.append(new)
            far.append(differing)
            at += np.bincount(differing, minlength=len(at))
            left -= len(new)
            if not left or (radius >= margin and at[: radius - margin + 1].sum() >= k):
                break
        codes, differing = np.concatenate(found), np.concatenate(far)
        return codes[differing <= np.searchsorted(np.cumsum(at), k) + margin]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All codes that differ from the query in at most ``radius`` bits."""
        found = []
        for reached, new, differing in self.shells(query, np.zeros(len(self.words), bool)):
            found.append(new[differing <= radius])
            if reached >= radius:
                break
        return np.sort(np.concatenate(found))


@cache
def flips(width: int, flipped: int) -> np.ndarray:
    """All patterns of ``flipped`` set bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), flipped)], np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(table.num_rows, -1)


def nearest_in_shard(index: pa.Table, queries: pa.Table, codes: Codes, k: int, margin: int) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if index.num_rows and queries.num_rows:
        ids = index.column("vec_id").to_numpy()
        vectors, asked = _matrix(index), _matrix(queries)
        tables = SubstringIndex(codes.encode(vectors), [r.shape[1] for r in codes.rotations])
        for query, vector, word in zip(
            queries.column("vec_id").to_pylist(), asked, codes.encode(asked), strict=True
        ):
            found = tables.nearest(word, k, margin, ids == query)
            score = np.sqrt(((vectors[found] - vector) ** 2).sum(axis=1))
            best = np.lexsort((ids[found], score))[:k]
            out.append((np.full(len(best), query, np.int64), ids[found[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    codes: Codes | None,
    k: int = 10,
    margin: int | None = None,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query among the other rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if codes is None:
        return empty
    size = len(codes.centre)
    margin = max(2, round(MARGIN_SHARE * codes.bits)) if margin is None else margin
    rows = usable(vectors).filter(F.size("embedding") == size)
    asked = usable(queries).filter(F.size("embedding") == size)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))

    def dealt(df: DataFrame, own: int, seed: int, name: str, other: int, other_name: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select("vec_id", "embedding", place.alias(name), every.alias(other_name))

    index = dealt(rows, shards, 1, "shard", blocks, "block")
    asked = dealt(asked, blocks, 2, "block", shards, "shard")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_in_shard(left, right, codes, k, margin)

    found = (
        index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(searched, RESULT)
    )
    # at most k rows of each shard meet here
    best = found.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best")
    )
    ranked = best.select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", F.col("hit.score").alias("score")
    )

