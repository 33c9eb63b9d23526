"""Hyper-parameter search over datasets, algorithms, trials and folds as one grid.

Features, weights and trees of a held-out fold come from the other folds only.  Linear trials are solved
where the sums of a (dataset, fold) meet; tree trials grow together, level by level; the scores of
all trials are added up in one pass over the held-out rows.  The driver holds states, models and
one metric row per (dataset, trial, fold).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators import grown, linear
from foldloom.operators.packed import Block, Layout, Packed, collected, keyed_sums, mapped
from foldloom.plans import grouped

LINEAR = ("ridge", "lasso", "linear_regression")
FORESTS = {"decision_tree": "tree", "random_forest": "forest", "gradient_boosting": "boosted", "xgboost": "boosted", "lightgbm": "boosted"}
# Search parameter -> field of a tree trial.
TREE_PARAMS = {
    "n_estimators": "trees", "max_depth": "depth", "min_samples_leaf": "min_leaf", "min_data_in_leaf": "min_leaf",
    "min_child_weight": "min_leaf", "min_samples_split": "min_split", "max_features": "subset",
    "colsample_bytree": "subset", "subsample": "sample", "learning_rate": "rate",
}
WHOLE = ("trees", "depth")
RESULT = (
    "dataset string, trial long, algorithm string, params map<string,string>, fold int, n long, mse double, "
    "mae double, r2 double, rmse double"
)


@dataclass(frozen=True)
class Trial:
    trial: int
    algorithm: str
    params: Mapping[str, str]


def trials_of(rows: DataFrame) -> list[Trial]:
    """A trial list of (trial, algorithm, params) as objects; it is a list of settings, not data."""
    return [Trial(r["trial"], r["algorithm"], dict(r["params"] or {})) for r in rows.collect()]


def tree_spec(trial: Trial, place: int) -> tuple[grown.TreeSpec, tuple[str, ...]]:
    """The trial as trees, and the parameters that have no counterpart."""
    fields, ignored = {}, []
    for name, value in trial.params.items():
        to = TREE_PARAMS.get(name)
        if to is None:
            ignored.append(name)
        elif to in WHOLE:
            fields[to] = int(float(value))
        elif to == "subset" and str(value) in ("all", "sqrt", "log2"):
            fields[to] = str(value)
        else:
            fields[to] = float(value)
    return grown.TreeSpec(place, FORESTS[trial.algorithm], **fields), tuple(ignored)


@dataclass
class Fitted:
    """Models of all trials for every (dataset, held-out fold)."""

    trials: Sequence[Trial]
    states: grouped.States
    weights: Mapping[tuple[str, int], np.ndarray]
    forests: grown.Grown | None

    def predict(self, block: Block, at: int, held_out: int, places: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Predictions of the trials at ``places``; a fold without labelled training rows has none."""
        key = (block.dataset, held_out)
        if key not in self.weights:
            return
        x = self.states[key].features(block, at)
        for i in places:
            if self.trials[i].algorithm in LINEAR:
                w = self.weights[key][i]
                yield i, x @ w[:-1] + w[-1]
            else:
                yield i, self.forests.predict(*key, i, x)


def fit(packed: Packed, states: grouped.States, trials: Sequence[Trial], bins: int = grown.BINS) -> Fitted:
    unknown = sorted({t.algorithm for t in trials} - set(LINEAR) - set(FORESTS))
    if unknown:
        raise ValueError(f"no grouped form of {unknown}; known: {sorted([*LINEAR, *FORESTS])}")
    specs = [tree_spec(t, i)[0] for i, t in enumerate(trials) if t.algorithm in FORESTS]
    forests = None
    if specs:
        forests = grown.grow(
            packed, lambda block, at, held_out: states[block.dataset, held_out].features(block, at), specs, bins
        )
    return Fitted(trials, states, _linear(packed, states, trials), forests)


def _solved(trial: Trial, moments: linear.Moments) -> np.ndarray:
    """Coefficients then intercept of a linear trial."""
    alpha = float(trial.params.get("alpha", 0.0))
    if trial.algorithm == "lasso":
        return linear.solve_lasso(moments, alpha)
    return linear.solve_ridge(moments, alpha, None, trial.params.get("fit_intercept", "true") == "true")


def _linear(packed: Packed, states: grouped.States, trials: Sequence[Trial]) -> dict[tuple[str, int], np.ndarray]:
    """A row of weights and intercept per trial (zeros for trees), solved where the sums of a fold meet."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        dataset, held_out = (k.as_py() for k in key)
        matrix = grouped.matrices(rows)[0]
        moments = grouped.moments_of(matrix, range(len(matrix) - 2))
        out = [_solved(t, moments) if t.algorithm in LINEAR else np.zeros(len(matrix) - 1) for t in trials]
        return pa.table(
            {
                "dataset": [dataset], "held_out": pa.array([held_out], pa.int32()), "n": [float(matrix[0, 0])],
                "weights": pa.array([[[float(v) for v in w] for w in out]], pa.list_(pa.list_(pa.float64()))),
            }
        )

    schema = "dataset string, held_out int, n double, weights array<array<double>>"
    # a group is one matrix of at most the feature cap
    found = grouped.gram(packed, states).groupBy("dataset", "held_out").applyInArrow(solve, schema)
    return {(r["dataset"], r["held_out"]): np.array(r["weights"]) for r in found.filter("n > 0").collect()}


NESTED = "dataset string, fold int, trial long, inner_r2 double, n long, mse double, r2 double"


def _errors(matrix: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Rows, squared error and total squares of a linear model on rows that are known by their sums alone."""
    n = matrix[0, 0]
    full = np.concatenate(([-weights[-1]], -weights[:-1], [1.0]))
    return n, max(float(full @ matrix @ full), 0.0), float(matrix[-1, -1] - matrix[0, -1] ** 2 / n)


def nested_linear(packed: Packed, states: grouped.States, trials: Sequence[Trial]) -> DataFrame:
    """Tuning inside every outer fold: the trial chosen there, and its score on the outer fold; columns of ``NESTED``.

    The features of an outer fold come from the other folds, the inner folds are those, and the training sums
    of an inner fold are the total less the outer and the inner fold.  Fits and scores of all trials follow
    from one pass, by sums of products per fold; the outer fold's sums are read once, to score the choice.
    """
    places = {d: {f: i for i, f in enumerate(layout.folds)} for d, layout in packed.layout.items()}

    def parts(block: Block, layout: Layout, held_out: int) -> np.ndarray:
        return np.searchsorted(np.array(layout.folds), block.fold)

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        dataset, outer = (k.as_py() for k in key)
        by_fold = grouped.matrices(rows)
        own = by_fold.pop(places[dataset][outer], None)
        out = []
        if own is not None and len(by_fold) > 1:
            total = sum(by_fold.values())
            inner = []
            for t in trials:
                scores = []
                for part in by_fold.values():
                    _, sse, sst = _errors(part, _solved(t, grouped.moments_of(total - part, range(len(part) - 2))))
                    scores.append(1 - sse / sst if sst > 0 else 0.0)
                inner.append(float(np.mean(scores)))
            best = max(range(len(trials)), key=lambda i: inner[i])
            n, sse, sst = _errors(own, _solved(trials[best], grouped.moments_of(total, range(len(own) - 2))))
            out = [(dataset, outer, trials[best].trial, inner[best], int(n), sse / n, 1 - sse / sst if sst > 0 else 0.0)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in NESTED.split(", ")]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    if any(t.algorithm not in LINEAR for t in trials):
        raise ValueError("nested tuning from sums is for linear models")
    # a group has one matrix per fold
    return grouped.gram(packed, states, None, parts).groupBy("dataset", "held_out").applyInArrow(solve, NESTED)


def scores(packed: Packed, fitted: Fitted) -> DataFrame:
    """Metrics of every trial on every held-out fold, from one pass: the columns of ``RESULT``."""
    places = range(len(fitted.trials))

    def kernel(block: Block, layout: Layout):
        for at, held_out in enumerate(layout.folds):
            rows = block.take(np.flatnonzero((block.fold == held_out) & ~np.isnan(block.y)))
            if not len(rows.y):
                continue
            # deviations from the training mean keep the digits of the sum of squares
            y = rows.y - centers.get((block.dataset, held_out), 0.0)
            for i, p in fitted.predict(rows, at, held_out, places):
                e = rows.y - p
                yield held_out, i, "sum", np.array([[len(e), (e * e).sum(), np.abs(e).sum(), y.sum(), (y * y).sum()]])

    centers = _label_means(packed)
    out = []
    for (d, h, i, _), v in sorted(collected(keyed_sums(packed, kernel)).items()):
        n, sse, sae, s, ss = (float(x) for x in v[0])
        sst, t = max(ss - s * s / n, 0.0), fitted.trials[i]
        r2 = 1 - sse / sst if sst > 0 else float(sse == 0)
        out.append((d, t.trial, t.algorithm, dict(t.params), h, int(n), sse / n, sae / n, r2, (sse / n) ** 0.5))
    return packed.rows.sparkSession.createDataFrame(out, RESULT)


def _label_means(packed: Packed) -> dict[tuple[str, int], float]:
    means = packed.rows.groupBy("dataset", "fold").agg(F.avg("y").alias("m")).collect()
    return {(r["dataset"], r["fold"]): r["m"] or 0.0 for r in means}


def predictions(packed: Packed, fitted: Fitted, chosen: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """dataset, trial, fold, row_id, y_true, y_pred: every row by the model that did not see its fold.

    ``chosen`` has the trials wanted of each dataset (all by default).  Rows without a label are predicted too.
    """
    names = ["dataset", "trial", "fold", "row_id", "y_true", "y_pred"]
    numbers = [t.trial for t in fitted.trials]

    def work(block: Block, layout: Layout) -> Iterator[pa.RecordBatch]:
        wanted = numbers if chosen is None else chosen.get(block.dataset, ())
        places = [i for i, t in enumerate(numbers) if t in wanted]
        for at, held_out in enumerate(layout.folds):
            rows = block.take(np.flatnonzero(block.fold == held_out))
            n = len(rows.y)
            for i, p in fitted.predict(rows, at, held_out, places) if n else ():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.dataset] * n), pa.array(np.full(n, numbers[i], np.int64)),
                        pa.array(np.full(n, held_out, np.int32)), pa.array(rows.row_id.astype(np.int64)),
                        pa.array(rows.y, mask=np.isnan(rows.y)), pa.array(p),
                    ],
                    names,
                )

    return mapped(packed, work, "dataset string, trial long, fold int, row_id long, y_true double, y_pred double", names)


def best_trials(fold_rows: DataFrame) -> DataFrame:
    """Best trial per (dataset, algorithm) in the log form, with its per-fold details."""
    per_trial = fold_rows.groupBy("dataset", "trial", "algorithm").agg(
        F.first("params").alias("params"),
        F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.coalesce(F.avg("r2"), F.lit(0.0)).alias("r2"),
        # one entry per fold of the trial
        F.sort_array(F.collect_list(F.struct("fold", "mse", "mae", "r2"))).alias("folds"),
    )
    best = F.max_by(F.struct("trial", "params", "mse", "mae", "r2", "folds"), F.struct(F.col("r2"), -F.col("trial")))
    detail = F.transform(
        "b.folds", lambda f: F.struct(f["mse"].alias("mse"), f["mae"].alias("mae"), f["r2"].alias("r2"), f["r2"].alias("composite_score"))
    )
    grouped_rows = per_trial.groupBy("dataset", "algorithm").agg(best.alias("b"), F.count(F.lit(1)).cast("int").alias("n_trials"))
    return grouped_rows.select(
        "dataset", "algorithm", F.col("b.params").alias("best_params"), F.col("b.r2").alias("best_score"),
        F.struct(
            F.col("b.r2").alias("composite_score"), F.col("b.mse").alias("mse"), F.col("b.mae").alias("mae"),
            F.col("b.r2").alias("r2"), detail.alias("fold_details"),
        ).alias("best_metrics"),
        "n_trials", F.col("b.trial").alias("trial"),
    )
