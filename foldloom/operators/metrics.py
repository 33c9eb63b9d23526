"""Regression and classification metrics and their summaries across folds and datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("mse", "mae", "r2", "rmse")


def metric_columns(y: str, p: str) -> dict[str, Column]:
    """Aggregates over labelled rows. R2 of a constant truth is 1 when exact, else 0."""
    error = F.col(y).cast("double") - F.col(p).cast("double")
    sse = F.sum(error * error)
    sst = F.var_pop(F.col(y).cast("double")) * F.count(y)
    constant = F.when(sse == 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "n": F.count(y),
        "mse": F.avg(error * error),
        "mae": F.avg(F.abs(error)),
        "r2": F.coalesce(F.lit(1.0) - F.try_divide(sse, sst), constant),
        "rmse": F.sqrt(F.avg(error * error)),
    }


def regression_metrics(
    predictions: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """One row per group; rows without a label give none."""
    labelled = predictions.filter(F.col(y).isNotNull())
    return labelled.groupBy(*by).agg(*[e.alias(n) for n, e in metric_columns(y, p).items()])


def accuracy(
    predictions: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    labelled = predictions.filter(F.col(y).isNotNull())
    hit = (F.col(y) == F.col(p)).cast("double")
    return labelled.groupBy(*by).agg(F.count(y).alias("n"), F.avg(hit).alias("accuracy"))


def cross_fold_summary(
    fold_metrics: DataFrame, by: Sequence[str] = ("dataset",), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean and population standard deviation of every metric over the folds."""
    cells = [
        e
        for m in metrics
        for e in (F.avg(m).alias(f"avg_{m}"), F.stddev_pop(m).alias(f"std_{m}"))
    ]
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("total_folds"), *cells)


def mean_over_folds(
    trials: DataFrame, fold_metrics: DataFrame, trial: str = "trial", metrics: Sequence[str] = ("mse", "mae", "r2")
) -> DataFrame:
    """Trial score = mean fold R2; a trial without any fold scores 0."""
    means = fold_metrics.groupBy(trial).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return trials.join(means, trial, "left").withColumn("score", F.coalesce("mean_r2", F.lit(0.0)))


def robust_score(
    scores: DataFrame, by: Sequence[str], score: str = "score", penalty: float = 0.1, failed: float = -1.0
) -> DataFrame:
    """Mean over datasets minus ``penalty`` times their population std; failures count ``failed``."""
    value = F.coalesce(F.col(score), F.lit(failed))
    return scores.groupBy(*by).agg(
        (F.avg(value) - F.lit(penalty) * F.stddev_pop(value)).alias("robust_score"),
        F.count(F.lit(1)).alias("datasets"),
    )


def reference_gap(results: DataFrame, reference: DataFrame, score: str = "r2") -> DataFrame:
    """Gap to a reference score per dataset with its band; unknown datasets compare to 0."""
    joined = results.join(reference, "dataset", "left")
    ref = F.coalesce(F.col("reference"), F.lit(0.0))
    gap = ref - F.col(score)
    band = (
        F.when(gap < 0.05, "excellent").when(gap < 0.1, "good").when(gap < 0.2, "ok").otherwise("needs work")
    )
    return joined.select(
        "dataset", F.col(score), ref.alias("reference"), gap.alias("gap"), band.alias("status")
    )


def average_gap(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count(F.lit(1)).alias("datasets"), F.avg(F.abs("gap")).alias("average_gap"))


def fit_mean_model(
    df: DataFrame, target: str, fold: str | None = None
) -> DataFrame:
    """Mean target of the training rows; with ``fold``, of all rows outside each fold.

    The other-fold means come from one pass of per-fold sums.
    """
    y = F.col(target).cast("double")
    if fold is None:
        return df.agg(F.avg(y).alias("y_pred"))
    parts = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(target).alias("c")).collect()
    total, count = sum(r["s"] or 0.0 for r in parts), sum(r["c"] for r in parts)
    rows = [
        (r[fold], (total - (r["s"] or 0.0)) / (count - r["c"]) if count > r["c"] else None)
        for r in parts
    ]
    schema = f"{fold} {df.schema[fold].dataType.simpleString()}, y_pred double"
    return df.sparkSession.createDataFrame(rows, schema)
