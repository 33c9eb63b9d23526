"""Linear models from second moments.

Everything least squares needs is the Gram matrix of (1, x, y).  One scan sums
it per fold; the training matrix of a fold is the total minus that fold's part.
All folds and all penalties of a search are then solved from p x p numbers,
without touching the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.operators import gram

PRODUCTS_PER_AGGREGATE = 400


@dataclass(frozen=True)
class Moments:
    """Sums over rows per fold, taken about ``center`` to keep the digits."""

    features: tuple[str, ...]
    center: np.ndarray  # p + 1 values, the target last
    parts: dict  # fold -> (count, sums (p+1), products (p+1, p+1))

    def total(self, without=None) -> tuple[float, np.ndarray, np.ndarray]:
        """Sums of all parts but one, or but a set of them."""
        left_out = without if isinstance(without, (set, frozenset)) else {without} if without is not None else ()
        chosen = [m for f, m in self.parts.items() if f not in left_out]
        return (
            sum(m[0] for m in chosen),
            sum(m[1] for m in chosen),
            sum(m[2] for m in chosen),
        )


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None) -> Moments:
    """One aggregate for the centre, one for the products (partial sums per task).

    A frame of more pairs than one aggregate takes is read once and multiplied batch by batch.
    """
    names = [*features, target]
    rows = df.filter(F.col(target).isNotNull())
    if len(names) * (len(names) + 1) // 2 > PRODUCTS_PER_AGGREGATE:
        return _wide_moments(rows, names, fold)
    center = np.array(rows.agg(*[F.avg(F.col(c).cast("double")) for c in names]).first(), dtype=float)
    x = [
        F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0))
        for c, m in zip(names, center, strict=True)
    ]
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    by = [F.lit(0).alias("__f") if fold is None else F.col(fold).alias("__f")]
    centred = rows.select(*by, *[e.alias(f"x{i}") for i, e in enumerate(x)])
    parts: dict = {}
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    sums += [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)] + [F.count(F.lit(1)).alias("n")]
    for row in centred.groupBy("__f").agg(*sums).collect():
        m = np.zeros((p, p))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"p{i}_{j}"]
        parts[row["__f"]] = row["n"], np.array([row[f"s{i}"] for i in range(p)]), m
    return Moments(tuple(features), center, parts)


def _wide_moments(rows: DataFrame, names: Sequence[str], fold: str | None) -> Moments:
    center = gram.sample_center(rows, names)
    found = gram.products(rows, names, center, fold)
    kind = "string" if fold is None else rows.schema[fold].dataType.simpleString()

    def as_fold(text: str):
        if kind == "string":
            return text
        return int(text) if text else None

    parts = {
        (0 if fold is None else as_fold(f)): (float(m[0, 0]), m[0, 1:], m[1:, 1:]) for f, m in found.items()
    }
    return Moments(tuple(names[:-1]), center, parts)


def _normal_equations(moments: Moments, without, intercept: bool):
    n, s, m = moments.total(without)
    p = len(moments.features)
    if intercept:
        c = m - np.outer(s, s) / n
        return n, c[:p, :p], c[:p, p], s / n + moments.center
    # undo the centring: sums of raw products
    raw = m + np.outer(s, moments.center) + np.outer(moments.center, s) + n * np.outer(
        moments.center, moments.center
    )
    return n, raw[:p, :p], raw[:p, p], np.zeros(p + 1)


def solve_ridge(moments: Moments, alpha: float = 0.0, without=None, intercept: bool = True) -> np.ndarray:
    """Coefficients then intercept for ``|y - Xw|^2 + alpha |w|^2`` (alpha 0: least squares)."""
    _, gram, xy, mean = _normal_equations(moments, without, intercept)
    p = len(xy)
    w = np.linalg.lstsq(gram + alpha * np.eye(p), xy, rcond=None)[0]
    return np.append(w, mean[p] - mean[:p] @ w if intercept else 0.0)


def solve_lasso(
    moments: Moments, alpha: float, without=None, sweeps: int = 1000, tol: float = 1e-8
) -> np.ndarray:
    """Coordinate descent on the Gram matrix for ``|y - Xw|^2 / 2n + alpha |w|_1``."""
    n, gram, xy, mean = _normal_equations(moments, without, True)
    p, w = len(xy), np.zeros(len(xy))
    limit = alpha * n
    for _ in range(sweeps):
        moved = 0.0
        for j in range(p):
            if gram[j, j] <= 0:
                continue
            rho = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - limit, 0.0) / gram[j, j]
            moved = max(moved, abs(new - w[j]) * np.sqrt(gram[j, j] / n))
            w[j] = new
        if moved < tol:
            break
    return np.append(w, mean[p] - mean[:p] @ w)


def linear_prediction(features: Sequence[str], weights: Sequence[float]) -> Column:
    score = F.lit(float(weights[-1]))
    for c, w in zip(features, weights[:-1], strict=True):
        score = score + F.col(c).cast("double") * F.lit(float(w))
    return score


def predict_by_fold(
    df: DataFrame, features: Sequence[str], fold: str, weights: dict, name: str = "y_pred"
) -> DataFrame:
    """Predict every row with the model that was trained without its fold."""
    rows = [(f, [float(v) for v in w]) for f, w in weights.items()]
    schema = f"{fold} {df.schema[fold].dataType.simpleString()}, __w array<double>"
    # one row per fold
    models = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    score = F.col("__w")[len(features)]
    for i, c in enumerate(features):
        score = score + F.col(c).cast("double") * F.col("__w")[i]
    return df.join(models, fold).withColumn(name, score).drop("__w")


def single_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of y on one feature, built-in aggregates only."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
