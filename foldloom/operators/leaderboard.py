"""Queries over an experiment log ``(dataset, algorithm, fold, score, params, seq)``.

Best-of questions are ``max_by`` aggregates (combined map-side, no sort); only
tables already reduced to one row per (dataset, algorithm) are ranked by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.orderstats import grouped_quantiles


def _first_best(score: str, seq: str) -> Column:
    """Ordering key: highest score, earliest entry on ties."""
    return F.struct(F.col(score), -F.col(seq))


def best_per_fold(log: DataFrame) -> DataFrame:
    """Best algorithm of every (dataset, fold)."""
    best = F.max_by(F.struct("algorithm", "score"), _first_best("score", "seq"))
    return (
        log.groupBy("dataset", "fold")
        .agg(best.alias("b"))
        .select(
            "dataset",
            "fold",
            F.col("b.algorithm").alias("best_algorithm"),
            F.col("b.score").alias("best_score"),
            F.concat_ws("_fold_", F.col("dataset"), F.col("fold")).alias("dataset_fold"),
        )
    )


def mean_scores(log: DataFrame) -> DataFrame:
    return log.groupBy("dataset", "algorithm").agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("entries")
    )


def best_params(log: DataFrame) -> DataFrame:
    """Parameters of the highest-scoring entry per (dataset, algorithm)."""
    best = F.max_by(F.struct("params", "score"), _first_best("score", "seq"))
    return (
        log.groupBy("dataset", "algorithm")
        .agg(best.alias("b"))
        .select("dataset", "algorithm", F.col("b.params").alias("params"), F.col("b.score").alias("score"))
    )


def best_per_dataset(log: DataFrame) -> DataFrame:
    """Algorithm with the highest mean score per dataset, with its best parameters.

    One aggregate yields mean and best parameters per (dataset, algorithm), a
    second one picks the winner: the log is read once.
    """
    per_algorithm = log.groupBy("dataset", "algorithm").agg(
        F.avg("score").alias("mean_score"),
        F.max_by("params", _first_best("score", "seq")).alias("params"),
        F.min("seq").alias("seq"),
    )
    best = F.max_by(
        F.struct("algorithm", "mean_score", "params"), _first_best("mean_score", "seq")
    )
    return per_algorithm.groupBy("dataset").agg(best.alias("b")).select("dataset", "b.*")


def ranked(scores: DataFrame, score: str = "mean_score", tie: str = "algorithm") -> DataFrame:
    """Rank within each dataset. ``scores`` has one row per (dataset, algorithm)."""
    order = Window.partitionBy("dataset").orderBy(F.desc(score), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(order))


def global_best(scores: DataFrame, score: str = "mean_score", ties: Sequence[str] = ("dataset", "algorithm")) -> DataFrame:
    return scores.orderBy(F.desc(score), *ties).limit(1)


def trials_by_value(trials: DataFrame, value: str = "score", tie: str = "seq") -> DataFrame:
    """All trials, best first (a range-partitioned sort)."""
    return trials.orderBy(F.desc(value), F.asc(tie))


def algorithm_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"))


def five_numbers(results: DataFrame, value: str = "score", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Minimum, quartiles and maximum per group (the data of a box plot)."""
    q = grouped_quantiles(results, list(by), value, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ("minimum", "q1", "median", "q3", "maximum")
    return q.select(*by, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(names)])


def softmax_choice(scores: DataFrame, by: Sequence[str] = ("dataset",), value: str = "score") -> DataFrame:
    """Arg-max algorithm and its softmax probability; ties go to the smaller name.

    exp(x - max) is summed in a second aggregate, so large scores cannot overflow.
    """
    top = scores.groupBy(*by).agg(
        F.max(value).alias("top"),
        F.min_by("algorithm", F.struct(-F.col(value), F.col("algorithm"))).alias("algorithm"),
    )
    weights = (
        scores.join(top.select(*by, "top"), list(by))
        .groupBy(*by)
        .agg(F.sum(F.exp(F.col(value) - F.col("top"))).alias("total"))
    )
    return top.join(weights, list(by)).select(
        *by, "algorithm", (F.lit(1.0) / F.col("total")).alias("confidence")
    )


def early_stop(
    series: DataFrame,
    patience: int,
    step: str = "step",
    loss: str = "loss",
    by: Sequence[str] = (),
    block: int = 100_000,
) -> DataFrame:
    """First step with ``patience`` steps since the last strict improvement.

    ``step`` counts 0, 1, 2, ... per series.  The running minimum is taken over
    blocks of steps: block minima first, their prefix minimum (one row per block)
    next, then a window inside each block.  A series of any length therefore
    spreads over many tasks.  Series that never stop end at their last step.
    """
    by = list(by)
    x = series.select(
        *by, F.col(step).cast("long").alias("__s"), F.col(loss).cast("double").alias("__l"),
        F.floor(F.col(step) / F.lit(block)).alias("__b"),
    )
    minima = x.groupBy(*by, "__b").agg(F.min("__l").alias("__m"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = minima.select(*by, "__b", F.min("__m").over(earlier).alias("__carry"))
    inside = (
        Window.partitionBy(*by, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    )
    best = F.least(F.min("__l").over(inside), F.col("__carry"))
    steps = x.join(carried, [*by, "__b"])
    improved = steps.withColumn("__best", best).filter(
        F.col("__best").isNull() | (F.col("__l") < F.col("__best"))
    )
    following = Window.partitionBy(*by, "__b").orderBy("__s")
    gaps = improved.withColumn("__next", F.lead("__s").over(following))
    # per block: first and last improvement and the first wait inside that is long enough
    long_wait = F.col("__next") - F.col("__s") > patience
    per_block = gaps.groupBy(*by, "__b").agg(
        F.min("__s").alias("__first"),
        F.max("__s").alias("__last"),
        F.min(F.when(long_wait, F.col("__s"))).alias("__inner"),
    )
    blocks = Window.partitionBy(*by).orderBy("__b")
    crossing = per_block.withColumn("__after", F.lead("__first").over(blocks))
    joined = _with_end(crossing, x, by)
    outer = F.when(
        F.coalesce(F.col("__after") - F.col("__last") > patience,
                   F.col("__end") - F.col("__last") >= patience),
        F.col("__last"),
    )
    found = joined.groupBy(*by).agg(
        F.min(F.coalesce(F.col("__inner"), outer)).alias("__stop"), F.max("__end").alias("__end"),
        F.max("__last").alias("__latest"),
    )
    # the improvement that was current at the stop
    stop = F.col("__stop") + F.lit(patience)
    return found.select(
        *by,
        F.coalesce(F.col("__stop"), F.col("__latest")).alias("best_step"),
        F.coalesce(stop, F.col("__end")).alias("stop_step"),
        F.col("__stop").isNotNull().alias("stopped_early"),
    )


def _with_end(blocks: DataFrame, steps: DataFrame, by: Sequence[str]) -> DataFrame:
    ends = steps.groupBy(*by).agg(F.max("__s").alias("__end"))
    if by:
        return blocks.join(ends, list(by))
    return blocks.withColumn("__end", F.lit(ends.first()[0]))


def dense_steps(df: DataFrame, order: str, by: Sequence[str] = (), block: int = 1_000_000, name: str = "step") -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by the unique integer ``order``.

    Key ranges of ``block`` width are counted, the counts before a range are its
    offset, and only rows of one range meet in a window.
    """
    by = list(by)
    ranged = df.withColumn("__r", F.floor(F.col(order) / F.lit(block)))
    counts = ranged.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, "__r").orderBy(order)
    return (
        ranged.join(offsets, [*by, "__r"])
        .withColumn(name, F.col("__off") + F.row_number().over(inside) - 1)
        .drop("__r", "__off")
    )
