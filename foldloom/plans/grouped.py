"""Cleaning and feature selection for every (dataset, held-out fold) at once.

For each held-out fold the state comes from the other folds alone: text codes, means for missing
values, constant columns, the two moments of the log normalisation, minima that decide which unary
features exist, and the selection by votes of several L1 models on labels of training rows.  Each step is one
pass of ``keyed_sums`` over all datasets; the rows are never copied per fold, a task computes the
features of a held-out fold when it needs them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldloom.operators.linear import Moments, solve_lasso
from foldloom.operators.packed import UNSEEN, Block, Layout, Packed, collected, keyed_sums, mapped

FEATURE_CAP = 50
SELECTION_ALPHA = 0.0005
SELECTION_RUNS = 5
#: row blocks of each selection run
RUN_BLOCKS = 2
DIGITS = 3


@dataclass
class FoldState:
    """What training rows say about the columns of one dataset, in layout order."""

    fill: np.ndarray
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: columns that vary
    kept: tuple[int, ...] = ()
    #: (column, unary step) of the selected features
    selected: tuple[tuple[int, str], ...] = ()

    def filled(self, block: Block, at: int) -> np.ndarray:
        codes = block.t[:, :, at].astype(float)
        codes[codes == UNSEEN] = np.nan
        out = np.concatenate((block.x, codes), axis=1)
        return np.where(np.isnan(out), self.fill, out)

    def logged(self, block: Block, at: int) -> np.ndarray:
        return np.log1p(np.abs((self.filled(block, at) - self.center) / self.scale))

    def scaled(self, block: Block, at: int) -> np.ndarray:
        return np.round((self.logged(block, at) - self.log_center) / self.log_scale, DIGITS)

    def candidates(self) -> list[tuple[int, str]]:
        """The varying columns and one unary step of each: log where positive, sqrt where not negative, else abs."""
        steps = [(c, "log") for c in self.kept if self.low[c] > 0]
        steps += [(c, "sqrt" if self.low[c] >= 0 else "abs") for c in self.kept]
        return [*((c, "") for c in self.kept), *steps]

    def features(self, block: Block, at: int, chosen=None) -> np.ndarray:
        x = self.scaled(block, at)
        chosen = self.selected if chosen is None else chosen
        out = np.empty((len(x), len(chosen)))
        for i, (c, step) in enumerate(chosen):
            v = x[:, c]
            if step == "log":
                v = np.log(np.maximum(v, self.low[c]))
            elif step == "sqrt":
                v = np.sqrt(np.maximum(v, self.low[c]))
            elif step == "abs":
                v = np.abs(v)
            out[:, i] = v
        return out

    def names(self, layout: Layout) -> list[str]:
        return [f"{s}({layout.names[c]})" if s else layout.names[c] for c, s in self.selected]


class Plain:
    """The numeric columns as they are, missing ones as 0: a state without anything fitted."""

    def features(self, block: Block, at: int, chosen=None) -> np.ndarray:
        return np.nan_to_num(block.x)


States = Mapping[tuple[str, int], "FoldState | Plain"]


def plain(packed: Packed) -> dict[tuple[str, int], Plain]:
    return {(d, h): Plain() for d, layout in packed.layout.items() for h in layout.folds}


def _or_one(scale: np.ndarray) -> np.ndarray:
    return np.where(scale > 0, scale, 1.0)


def _moments_of(packed: Packed, values) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Mean and population standard deviation, over the training rows of each held-out fold."""

    def kernel(block: Block, layout: Layout):
        for at, held_out in enumerate(layout.folds):
            v = values(block, at, held_out)[block.fold != held_out]
            yield held_out, 0, "sum", np.stack((np.full(v.shape[1], len(v)), v.sum(0), (v * v).sum(0)))

    out = {}
    for (d, h, _, _), (n, s, ss) in collected(keyed_sums(packed, kernel)).items():
        mean = s / np.maximum(n, 1)
        out[d, h] = mean, np.sqrt(np.maximum(ss / np.maximum(n, 1) - mean * mean, 0))
    return out


def fit_clean(packed: Packed) -> dict[tuple[str, int], FoldState]:
    """Cleaning state: four passes, whatever the number of datasets and folds."""

    def cells(block: Block, layout: Layout):
        known = ~np.isnan(block.x)
        for held_out in np.unique(block.fold):
            own = block.fold == held_out
            yield held_out, 0, "sum", np.stack((known[own].sum(0), np.where(known, block.x, 0.0)[own].sum(0)))

    # the training part of a fold is the total less the fold, here as elsewhere
    parts = {(d, h): v for (d, h, _, _), v in collected(keyed_sums(packed, cells)).items()}
    states: dict[tuple[str, int], FoldState] = {}
    for d, layout in packed.layout.items():
        for h in layout.folds:
            rest = [parts[d, o] for o in layout.folds if o != h]
            n, s = sum(rest) if rest else np.zeros((2, len(layout.numeric)))
            modes = packed.modes.get((d, h), np.zeros(len(layout.text)))
            states[d, h] = FoldState(np.concatenate((np.where(n > 0, s / np.maximum(n, 1), 0.0), np.maximum(modes, 0))))

    # deviations from the fill keep the digits
    for key, (mean, std) in _moments_of(
        packed, lambda b, at, h: states[b.dataset, h].filled(b, at) - states[b.dataset, h].fill
    ).items():
        s = states[key]
        steady = std <= 1e-12 * np.maximum(1.0, np.abs(s.fill))
        s.center, s.scale = s.fill + mean, _or_one(np.where(steady, 0.0, std))
        s.kept = tuple(np.flatnonzero(~steady).tolist())
    for key, (mean, std) in _moments_of(packed, lambda b, at, h: states[b.dataset, h].logged(b, at)).items():
        states[key].log_center, states[key].log_scale = mean, _or_one(np.where(std > 1e-12, std, 0.0))

    def lowest(block: Block, layout: Layout):
        for at, held_out in enumerate(layout.folds):
            rows = block.take(np.flatnonzero(block.fold != held_out))
            if len(rows.y):
                yield held_out, 0, "min", states[block.dataset, held_out].scaled(rows, at).min(0)[None, :]

    for (d, h, _, _), low in collected(keyed_sums(packed, lowest)).items():
        states[d, h].low = low[0]
    for s in states.values():
        width = len(s.fill)
        if not len(s.low):  # a dataset whose only fold is held out has no training rows
            s.center = s.log_center = s.low = np.zeros(width)
            s.scale = s.log_scale = np.ones(width)
        s.selected = tuple((c, "") for c in s.kept)
    return states


def row_blocks(row_id: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a row, by the shuffle that also deals folds."""
    return np.mod(np.mod(np.mod(row_id, 10007) * 7919, 10007), blocks)


def gram(packed: Packed, states: States, chosen=None, parts=None) -> DataFrame:
    """Sums of products of (1, features, y) over labelled rows: a part per row of the matrix.

    Without ``parts`` the sums are those of all training rows of a held-out fold.  ``parts`` gives every row of a
    block its number, and a task per number holds its rows' sums; rows of number -1 are left out.
    """

    def kernel(block: Block, layout: Layout):
        for at, held_out in enumerate(layout.folds):
            s = states[block.dataset, held_out]
            own = None if chosen is None else chosen[block.dataset, held_out]
            number = np.where(block.fold != held_out, 0, -1) if parts is None else parts(block, layout, held_out)
            number = np.where(np.isnan(block.y), -1, number)
            rows = block.take(np.flatnonzero(number >= 0))
            number = number[number >= 0]
            v = s.features(rows, at, own)
            v = np.concatenate((np.ones((len(v), 1)), v, rows.y[:, None]), axis=1)
            for n in np.unique(number):
                yield held_out, n, "sum", v[number == n].T @ v[number == n]

    return keyed_sums(packed, kernel)


def matrices(rows: pa.Table) -> dict[int, np.ndarray]:
    """The matrices of a group of sums, by task."""
    found: dict[int, list] = {}
    for r in sorted(rows.select(["task", "part", "numbers"]).to_pylist(), key=lambda r: r["part"]):
        found.setdefault(r["task"], []).append(r["numbers"])
    return {t: np.array(m) for t, m in sorted(found.items())}


def moments_of(matrix: np.ndarray, names) -> Moments:
    """A Gram matrix of (1, features, y) as the moments that the linear solvers read, about the means."""
    n = max(matrix[0, 0], 1.0)
    mean = matrix[0, 1:] / n
    return Moments(tuple(names), mean, {0: (n, np.zeros(len(mean)), matrix[1:, 1:] - n * np.outer(mean, mean))})


def importance(matrix: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every candidate: weight in an L1 model on standardised columns, correlation, whether it varies."""
    m = moments_of(matrix, range(len(matrix) - 2))
    n, _, products = m.parts[0]
    spread = np.sqrt(np.maximum(np.diag(products) / n, 0))
    varying = spread > 1e-12 * np.maximum(1.0, np.abs(m.center))
    unit = _or_one(np.where(varying, spread, 0.0))
    z = products / np.outer(unit, unit)
    weight = solve_lasso(Moments(m.features, np.zeros(len(unit)), {0: (n, np.zeros(len(unit)), z)}), alpha)
    return np.abs(weight[:-1]), np.abs(z[:-1, -1]) / n, varying[:-1]


def stable_choice(blocks: Mapping[int, np.ndarray], names, cap: int, alpha: float, runs: int) -> list[int]:
    """Places of the selected candidates: votes of the runs, then mean weight, then correlation.

    Run r leaves out every block b with b % runs = r, by subtracting its sums from the total.
    """
    total = sum(blocks.values())
    samples = [total - sum(m for b, m in blocks.items() if b % runs == r) for r in range(runs)] if runs > 1 else [total]
    found = [importance(m, alpha) for m in samples if m[0, 0] > 0] or [importance(total, alpha)]
    votes = sum((w > 0).astype(int) for w, _, _ in found)
    weight = sum(w for w, _, _ in found) / len(found)
    _, corr, varying = importance(total, alpha)
    live = np.flatnonzero(varying).tolist()
    return sorted(live, key=lambda i: (-votes[i], -weight[i], -corr[i], names[i]))[:cap]


def select(
    packed: Packed, states: States, cap: int = FEATURE_CAP, alpha: float = SELECTION_ALPHA, runs: int = SELECTION_RUNS
) -> None:
    """Choose features per (dataset, held-out fold) from its training labels.

    One pass adds up the products by row block; all runs are solved from those sums, where they meet.
    """
    chosen = {k: s.candidates() for k, s in states.items()}

    def parts(block: Block, layout: Layout, held_out: int) -> np.ndarray:
        return np.where(block.fold != held_out, row_blocks(block.row_id, RUN_BLOCKS * runs), -1)

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        dataset, held_out = (k.as_py() for k in key)
        places = stable_choice(matrices(rows), chosen[dataset, held_out], cap, alpha, runs)
        return pa.table({"dataset": [dataset], "held_out": pa.array([held_out], pa.int32()), "places": pa.array([places], pa.list_(pa.int32()))})

    # a group is one matrix per block, as large as the square of the dataset's columns
    sums = gram(packed, states, chosen, parts)
    found = sums.groupBy("dataset", "held_out").applyInArrow(solve, "dataset string, held_out int, places array<int>")
    for r in found.collect():
        key = (r["dataset"], r["held_out"])
        states[key].selected = tuple(chosen[key][i] for i in r["places"])


def engineered(packed: Packed, states: States) -> DataFrame:
    """dataset, held_out, fold, row_id, y, features: every row with the state of every held-out fold."""
    names = ["dataset", "held_out", "fold", "row_id", "y", "features"]

    def work(block: Block, layout: Layout) -> Iterator[pa.RecordBatch]:
        for at, held_out in enumerate(layout.folds):
            v = states[block.dataset, held_out].features(block, at)
            n, width = v.shape
            offsets = np.arange(n + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.dataset] * n, pa.string()), pa.array(np.full(n, held_out, np.int32)),
                    pa.array(block.fold.astype(np.int32)), pa.array(block.row_id.astype(np.int64)),
                    pa.array(block.y, mask=np.isnan(block.y)), pa.ListArray.from_arrays(offsets, pa.array(v.ravel())),
                ],
                names,
            )

    schema = "dataset string, held_out int, fold int, row_id long, y double, features array<double>"
    return mapped(packed, work, schema, names)


def described(packed: Packed, states: States) -> DataFrame:
    """The cleaning state as rows: dataset, held_out, column, fill, center, scale, constant."""
    rows = [
        (d, h, c, float(s.fill[i]), float(s.center[i]), float(s.scale[i]), i not in s.kept)
        for (d, h), s in sorted(states.items())
        for i, c in enumerate(packed.layout[d].names)
    ]
    schema = "dataset string, held_out int, column string, fill double, center double, scale double, constant boolean"
    return packed.rows.sparkSession.createDataFrame(rows, schema)
