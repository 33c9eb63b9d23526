"""Rows of many datasets in one frame, and sums over them by dataset, held-out fold and task.

A packed row is ``dataset, fold, row_id, y, x, t``: numeric cells as an array in the dataset's own
column order, and for every text cell its code for each held-out fold.  Datasets of any width share the
frame, so one job serves all of them.  ``keyed_sums`` is the only aggregate: tasks add up dense
vectors per key with numpy and send a row for each key and part; parts meet by key in bounded groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.operators import columns as cols
from foldloom.operators.encode import order_codes
from foldloom.operators.state import Settled, lookup, settle
from foldloom.session import checkpointed

ROWS = "dataset string, fold int, row_id long, y double, x array<double>, t array<array<int>>"
SUMS = "dataset string, held_out int, task int, op string, part int, numbers array<double>"
#: bytes of sums that a task holds before it sends them
HELD_BYTES = 64 << 20
UNSEEN = -1


@dataclass(frozen=True)
class Layout:
    """Columns of a dataset: numeric ones, then text ones, and its folds in order."""

    numeric: tuple[str, ...]
    text: tuple[str, ...]
    folds: tuple[int, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.numeric, *self.text)


@dataclass(frozen=True)
class Packed:
    rows: DataFrame
    layout: Mapping[str, Layout]
    #: dataset, held_out, pos -> code that an unseen text takes: the most frequent one
    modes: Mapping[tuple[str, int], np.ndarray]


def pack(frames: Mapping[str, tuple[DataFrame, str]], row_id: str = "row_id", fold: str = "fold") -> Packed:
    """Pack frames (name -> frame, target) that have a row id and a fold.

    Missing, NaN and infinite numbers are null.  A missing text is ``unknown``.  The code of a text for a held-out
    fold is its place among the texts of the other folds, so it depends on training rows alone.
    """
    parts, shapes = [], {}
    for name, (frame, target) in sorted(frames.items()):
        kinds = cols.column_kinds(frame, [row_id, fold, target])
        numbers = [f"{sql.finite(c)}" for c in kinds.numeric]
        texts = [f"coalesce(cast({sql.name(c)} as string), 'unknown')" for c in kinds.categorical]
        shapes[name] = (tuple(kinds.numeric), tuple(kinds.categorical))
        parts.append(
            frame.selectExpr(
                f"{sql.literal(name, frame.sparkSession.createDataFrame([], 'a string').schema[0].dataType)} as dataset",
                f"cast({sql.name(fold)} as int) as fold", f"cast({sql.name(row_id)} as long) as row_id",
                f"{sql.finite(target)} as y",
                f"cast(array({', '.join(numbers)}) as array<double>) as x",
                f"cast(array({', '.join(texts)}) as array<string>) as c",
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = checkpointed(rows)
    found = rows.groupBy("dataset").agg(F.sort_array(F.collect_set("fold")).alias("folds")).collect()
    folds = {r["dataset"]: tuple(r["folds"]) for r in found}
    layout = {d: Layout(*shapes[d], folds[d]) for d in shapes if d in folds}
    if not any(s.text for s in layout.values()):
        empty = F.expr("cast(array() as array<array<int>>)").alias("t")
        return Packed(rows.select("dataset", "fold", "row_id", "y", "x", empty), layout, {})
    return _coded(rows, layout)


def _coded(rows: DataFrame, layout: Mapping[str, Layout]) -> Packed:
    spark = rows.sparkSession
    cells = rows.select("dataset", "fold", "row_id", F.posexplode("c").alias("pos", "key"))
    counts = cells.groupBy("dataset", "pos", "key", "fold").agg(F.count(F.lit(1)).alias("n"))
    held = spark.createDataFrame([(d, list(s.folds)) for d, s in layout.items()], "dataset string, folds array<int>")
    counts = counts.groupBy("dataset", "pos", "key").agg(
        # an entry per fold
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"),
    )
    each = counts.join(F.broadcast(held), "dataset").select(
        "dataset", "pos", "key", "total", F.posexplode("folds").alias("at", "held_out"), "own"
    )
    seen = each.withColumn("n", F.col("total") - F.coalesce(F.try_element_at("own", "held_out"), F.lit(0))).filter("n > 0")
    group = F.concat_ws("|", F.col("at"), F.col("pos"), F.col("dataset"))
    seen = seen.select(group.alias("group"), "dataset", "pos", "at", "held_out", "key", "total", "n")
    coded = checkpointed(order_codes(seen, "group", "key"))
    modes = coded.groupBy("dataset", "held_out", "pos").agg(F.min_by("code", F.struct(-F.col("n"), F.col("key"))).alias("mode"))
    table = {d: {f: np.full(len(s.text), UNSEEN) for f in s.folds} for d, s in layout.items()}
    for r in modes.collect():
        table[r["dataset"]][r["held_out"]][r["pos"]] = r["mode"]
    codes = coded.groupBy("dataset", "pos", "key").agg(
        F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "code"))).alias("by_fold")
    )
    filled = F.expr(f"transform(sequence(0, size(folds) - 1), i -> coalesce(try_element_at(by_fold, i), {UNSEEN}))")
    codes = codes.join(F.broadcast(held), "dataset").select("dataset", "pos", "key", "n", filled.alias("codes"))
    state = settle(codes)
    met = lookup(cells, Settled(state.table, state.local), ["dataset", "pos", "key"])
    # as many cells as the row has text columns
    texts = met.groupBy("dataset", "row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "codes"))).alias("cells"))
    texts = texts.select("dataset", "row_id", F.col("cells.codes").alias("t"))
    bare = F.coalesce("t", F.expr("cast(array() as array<array<int>>)")).alias("t")
    rows = rows.join(texts, ["dataset", "row_id"], "left").select("dataset", "fold", "row_id", "y", "x", bare)
    return Packed(checkpointed(rows), layout, {(d, f): m for d, own in table.items() for f, m in own.items()})


@dataclass
class Block:
    """Rows of one dataset as arrays; missing numbers and labels are NaN, ``t`` is rows x texts x folds."""

    dataset: str
    fold: np.ndarray
    row_id: np.ndarray
    y: np.ndarray
    x: np.ndarray
    t: np.ndarray

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.dataset, self.fold[rows], self.row_id[rows], self.y[rows], self.x[rows], self.t[rows])


def blocks(batch: pa.RecordBatch, layout: Mapping[str, Layout]) -> Iterator[Block]:
    names = batch.column("dataset").dictionary_encode()
    which = names.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(names.dictionary.to_pylist()):
        own = batch if len(names.dictionary) == 1 else batch.filter(pa.array(which == i))
        shape, n = layout[name], own.num_rows
        x = own.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
        t = own.column("t").flatten().flatten().to_numpy(zero_copy_only=False)
        yield Block(
            name,
            own.column("fold").to_numpy(zero_copy_only=False),
            own.column("row_id").to_numpy(zero_copy_only=False),
            own.column("y").to_numpy(zero_copy_only=False).astype(float),
            x.reshape(n, len(shape.numeric)),
            t.reshape(n, len(shape.text), len(shape.folds)).astype(np.int64),
        )


#: (held-out fold, task, operation, matrix of which every row is a part)
Found = Iterable[tuple[int, int, str, np.ndarray]]
JOINED: dict[str, Callable] = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def keyed_sums(packed: Packed, kernel: Callable[[Block, Layout], Found]) -> DataFrame:
    """Sums (or minima, maxima) of what ``kernel`` gives for every block: the columns of ``SUMS``."""
    return summed(partial_sums(packed, kernel))


def partial_sums(packed: Packed, kernel: Callable[[Block, Layout], Found]) -> DataFrame:
    """The sums of each task, not yet joined."""
    layout = packed.layout

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, layout) if batch.num_rows else ():
                for held_out, task, op, values in kernel(block, layout[block.dataset]):
                    key = (block.dataset, held_out, task, op)
                    held[key] = JOINED[op](held[key], values) if key in held else np.array(values, float)
            if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                yield from sent(held)
                held = {}
        yield from sent(held)

    return packed.rows.mapInArrow(partial, SUMS)


def summed(sums: DataFrame) -> DataFrame:
    """Partial sums of ``SUMS`` joined by key and part; a group has a row per task."""

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        op = key[3].as_py()
        total = None
        for chunk in rows.column("numbers").chunks:
            for numbers in chunk:
                values = numbers.values.to_numpy(zero_copy_only=False)
                total = values.copy() if total is None else JOINED[op](total, values)
        return rows.slice(0, 1).drop_columns(["numbers"]).append_column("numbers", pa.array([total], pa.list_(pa.float64())))

    return sums.groupBy("dataset", "held_out", "task", "op", "part").applyInArrow(joined, SUMS)


def sent(held: Mapping[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (dataset, held_out, task, op), values in held.items():
        n, width = values.shape
        numbers = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dataset] * n), pa.array([int(held_out)] * n, pa.int32()), pa.array([int(task)] * n, pa.int32()),
                pa.array([op] * n), pa.array(np.arange(n, dtype=np.int32)), numbers,
            ],
            ["dataset", "held_out", "task", "op", "part", "numbers"],
        )


def collected(sums: DataFrame) -> dict[tuple[str, int, int, str], np.ndarray]:
    """Sums as matrices by key.  Their size follows from columns, folds and tasks, not from rows."""
    out: dict[tuple, dict[int, np.ndarray]] = {}
    for r in sums.toArrow().to_pylist():
        out.setdefault((r["dataset"], r["held_out"], r["task"], r["op"]), {})[r["part"]] = np.array(r["numbers"])
    return {k: np.stack([parts[i] for i in sorted(parts)]) for k, parts in out.items()}


def mapped(
    packed: Packed, work: Callable[[Block, Layout], Iterable[pa.RecordBatch]], schema: str, names: Sequence[str]
) -> DataFrame:
    """``work`` on every block, without a shuffle."""
    layout = packed.layout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, layout) if batch.num_rows else ():
                for out in work(block, layout[block.dataset]):
                    yield out.select(list(names))

    return packed.rows.mapInArrow(run, schema)
