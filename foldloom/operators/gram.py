"""Second moments of wide frames: products of whole batches, summed in rows of the matrix.

A task multiplies the matrices of its batches and keeps one sum; rows of the sums meet by key.  The
frame is read once, however many pairs of columns there are, and no task holds more than one row of the
matrix from every other task.  With missing cells every pair of columns has its own count, sums and
squares, over the rows that have both.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.operators.packed import HELD_BYTES, SUMS, collected, sent, summed

#: rows whose mean is subtracted before products are summed, to keep the digits
CENTER_ROWS = 1_000
PARTS = ("n", "own", "other", "square", "other_square", "product", "bad")


def sample_center(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Mean of the first rows, 0 where they have none; any value near the data serves."""
    head = df.select([F.expr(f"{sql.finite(c)}").alias(f"x{i}") for i, c in enumerate(columns)]).limit(CENTER_ROWS)
    values = np.array([list(r) for r in head.collect()], dtype=float).reshape(-1, len(columns))
    known = ~np.isnan(values)
    return np.where(known, values, 0).sum(0) / np.maximum(known.sum(0), 1)


def _matrices(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(batch.num_rows, width)


def _arrays(df: DataFrame, columns: Sequence[str], by: str | None, cell) -> DataFrame:
    key = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    cells = ", ".join(cell(c) for c in columns)
    return df.select(key.alias("key"), F.expr(f"cast(array({cells}) as array<double>)").alias("x"))


def products(
    df: DataFrame, columns: Sequence[str], center: np.ndarray, by: str | None = None
) -> dict[str, np.ndarray]:
    """Per key the sums of products of (1, columns) about ``center``; a missing cell counts as the centre."""
    width = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrices(batch, width) - center
            x = np.concatenate((np.ones((len(x), 1)), np.where(np.isnan(x), 0.0, x)), axis=1)
            keys = batch.column("key").dictionary_encode()
            which = keys.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(keys.dictionary.to_pylist()):
                own = x[which == i] if len(keys.dictionary) > 1 else x
                key = (name, 0, 0, "sum")
                held[key] = held.get(key, 0) + own.T @ own
        yield from sent(held)

    found = collected(summed(_arrays(df, columns, by, sql.double).mapInArrow(partial, SUMS)))
    return {name: matrix for (name, _, _, _), matrix in found.items()}


def pair_sums(arrays: DataFrame, centers: Mapping[str, np.ndarray]) -> DataFrame:
    """Sums for every two columns over the rows that have both: ``SUMS`` with a task per entry of ``PARTS``.

    ``arrays`` has key and x; the arrays of a key are as long as its centre.  Part i of a task is the row of
    column i.  ``own`` and ``square`` are of column i, ``other`` and ``other_square`` of the partner; ``bad`` counts
    rows where either is NaN or infinite.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("key").dictionary_encode()
            which = keys.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(keys.dictionary.to_pylist()):
                own = batch if len(keys.dictionary) == 1 else batch.filter(pa.array(which == k))
                for i, m in enumerate(_pair_matrices(own, centers[name])):
                    key = (name, 0, i, "sum")
                    held[key] = held.get(key, 0) + m
            if sum(m.nbytes for m in held.values()) > HELD_BYTES:
                yield from sent(held)
                held = {}
        yield from sent({k: m for k, m in held.items() if m.size})

    return summed(arrays.mapInArrow(partial, SUMS))


def _pair_matrices(batch: pa.RecordBatch, center: np.ndarray) -> tuple[np.ndarray, ...]:
    rows, width = batch.num_rows, len(center)
    cells = batch.column("x").flatten()
    known = (~np.asarray(cells.is_null())).reshape(rows, width).astype(float)
    x = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(rows, width)
    wrong = known * ~np.isfinite(x)
    x = np.where((known > 0) & (wrong == 0), x - center, 0.0)
    own, square = x.T @ known, (x * x).T @ known
    return known.T @ known, own, own.T, square, square.T, x.T @ x, wrong.T @ known + known.T @ wrong


def correlations_of(arrays: DataFrame, centers: Mapping[str, np.ndarray]) -> DataFrame:
    """dataset, i, r: per key the correlations of column i with all later columns, NaN where they have none."""

    def rows(key: tuple, sums: pa.Table) -> pa.Table:
        name, i = (k.as_py() for k in key)
        by = {r["task"]: np.array(r["numbers"])[i + 1 :] for r in sums.select(["task", "numbers"]).to_pylist()}
        n, own, other, square, other_square, product, bad = (by[t] for t in range(len(PARTS)))
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.maximum(n * square - own**2, 0) * np.maximum(n * other_square - other**2, 0)
            r = (n * product - own * other) / np.sqrt(spread)
        r[(bad > 0) | (spread <= 0)] = np.nan
        kinds = pa.array([name], pa.string()), pa.array([i], pa.int32()), pa.array([np.clip(r, -1, 1)], pa.list_(pa.float64()))
        return pa.table(list(kinds), names=["dataset", "i", "r"])

    # a group is one row of each of the matrices
    grouped = pair_sums(arrays, centers).groupBy("dataset", "part")
    return grouped.applyInArrow(rows, "dataset string, i int, r array<double>")


def correlation_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, r: the correlations of column i with all later columns."""
    center = sample_center(df, columns)
    return correlations_of(_arrays(df, columns, None, sql.double), {"": center}).select("i", "r")
