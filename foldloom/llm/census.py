"""In how many documents a token occurs, and the first of them, answered to every holder.

Documents are dealt into chunks of bounded size; a chunk asks once for each of its tokens, so a token
that a third of all documents hold costs one row per chunk.  The questions meet in buckets of the
token space, and the answers go back to the chunks.  Tokens are 64-bit hashes in binary columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: tokens of a chunk or bucket: the small size up to ``PARTS`` of them, then larger ones up to the large size
SMALL, LARGE, PARTS = 1 << 18, 1 << 23, 1 << 11

ASKED = "chunk long, bucket long, tokens binary, counts binary, firsts binary"


def values(column: pa.ChunkedArray | pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer() or b"", kind) if v.is_valid else np.zeros(0, kind) for v in column]


def parts_of(tokens: int) -> int:
    """Into how many chunks or buckets so many tokens go.

    A chunk has a row for each bucket that it asks, so both grow once there are many of them.
    """
    return max(1, tokens // LARGE, min(tokens // SMALL, PARTS))


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the token space; ascending with the token."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def _ask(key: tuple, rows: pa.Table, buckets: int) -> pa.Table:
    parts = values(rows.column("tokens"), "<u8")
    ids = rows.column("id").to_numpy()
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.repeat(ids, [len(p) for p in parts])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))) if len(tokens) else []
    tokens, owner = tokens[new], owner[new]
    start = runs_of(tokens)
    counts = np.diff(np.append(start, len(tokens))).astype("<i4")
    tokens, firsts = tokens[start], owner[start].astype("<i8")
    bucket = bucket_of(tokens, buckets)
    cuts = np.append(runs_of(bucket), len(bucket))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table(
        {
            "chunk": pa.array([key[0].as_py()] * len(spans), pa.int64()),
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
            "tokens": pa.array([tokens[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
            "firsts": pa.array([firsts[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _answer(rows: pa.Table) -> pa.Table:
    parts = values(rows.column("tokens"), "<u8")
    tokens = np.concatenate(parts)
    counts, firsts = np.concatenate(values(rows.column("counts"), "<i4")), np.concatenate(values(rows.column("firsts"), "<i8"))
    asker = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(tokens, kind="stable")
    start = runs_of(tokens[order])
    size = np.diff(np.append(start, len(order)))
    total = np.add.reduceat(counts[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    first = np.minimum.reduceat(firsts[order], start) if len(start) else np.zeros(0, np.int64)
    shared = np.repeat(total > 1, size)
    place = order[shared]
    back = np.argsort(asker[place], kind="stable")
    place = place[back]
    total, first = np.repeat(total, size)[shared][back], np.repeat(first, size)[shared][back]
    cuts = np.searchsorted(asker[place], np.arange(len(parts) + 1))
    chunk, bucket = rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist()
    told = [i for i in range(len(parts)) if cuts[i] < cuts[i + 1]]
    span = [slice(cuts[i], cuts[i + 1]) for i in told]
    return pa.table(
        {
            "chunk": pa.array([chunk[i] for i in told], pa.int64()),
            "bucket": pa.array([bucket[i] for i in told], pa.int64()),
            "tokens": pa.array([tokens[place[s]].astype("<u8").tobytes() for s in span], pa.binary()),
            "counts": pa.array([np.minimum(total[s], 2**31 - 1).astype("<i4").tobytes() for s in span], pa.binary()),
            "firsts": pa.array([first[s].astype("<i8").tobytes() for s in span], pa.binary()),
        }
    )


def _resolve(rows: pa.Table, answers: pa.Table, finish: Callable[[pa.Table, list, list], pa.Table]) -> pa.Table:
    told = [
        np.concatenate(values(answers.column(c), k)) if answers.num_rows else np.zeros(0, k)
        for c, k in (("tokens", "<u8"), ("counts", "<i4"), ("firsts", "<i8"))
    ]
    order = np.argsort(told[0], kind="stable")
    known, counts, firsts = (t[order] for t in told)
    docs, first = [], []
    for own, tokens in zip(rows.column("id").to_pylist(), values(rows.column("tokens"), "<u8"), strict=True):
        at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
        hit = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
        docs.append(np.where(hit, counts[at] if len(known) else 1, 1))
        first.append(np.where(hit, firsts[at] if len(known) else own, own))
    return finish(rows, docs, first)


def census(rows: DataFrame, finish: Callable[[pa.Table, list, list], pa.Table], schema: str) -> DataFrame:
    """What ``finish`` makes of the rows of each chunk and, for each row, two arrays beside its tokens.

    The first is the number of ids that hold the token, the second the smallest of them.  ``rows``
    (id, tokens and any others) should be a written table, as it is read more than once; ids must
    not be null.
    """
    total = (rows.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 8
    chunks = buckets = parts_of(total)
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")
    asked = rows.select("id", "tokens", chunk).groupBy("chunk")
    asked = asked.applyInArrow(lambda key, table: _ask(key, table, buckets), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(_answer, ASKED)
    return (
        rows.select("*", chunk)
        .groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInArrow(lambda left, right: _resolve(left, right, finish), schema)
    )
