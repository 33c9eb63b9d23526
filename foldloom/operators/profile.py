"""Dataset profiling: shapes, missing cells, moments, correlations, entropy, quality reports.

A full profile is three scans per dataset whatever the number of columns: shapes,
moments and limits; pairwise sums; histograms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.functions.numeric import half_even, ratio
from foldloom.operators import gram
from foldloom.operators.clean import infinite_cells, missing_cells
from foldloom.operators.columns import column_kinds
from foldloom.operators.state import settle_row

PAIRS_PER_AGGREGATE = 6


def shapes(df: DataFrame, dataset: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Row count, column counts by kind and share of missing cells."""
    kinds = column_kinds(df, exclude)
    p = len(kinds.numeric) + len(kinds.categorical) + len(kinds.other)
    return df.agg(F.lit(dataset).alias("dataset"), *_shape_columns(kinds, p))


def _shape_columns(kinds, p: int) -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("n_samples"),
        F.lit(p).cast("long").alias("n_features"),
        F.lit(p - len(kinds.numeric)).cast("long").alias("n_categorical"),
        F.lit(len(kinds.numeric)).cast("long").alias("n_numerical"),
        F.coalesce(ratio(missing_cells(kinds), n * F.lit(p)), F.lit(0.0)).alias("missing_ratio"),
    ]


def target_variance(df: DataFrame, target: str) -> Column:
    return F.var_pop(F.col(target).cast("double"))


def adjusted_skewness(c: Column, n: Column) -> Column:
    """Sample (bias-adjusted) skewness, NULL below 3 rows."""
    x = n.cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(x * (x - 1)) / F.nullif(x - 2, F.lit(0.0)))


def adjusted_kurtosis(c: Column, n: Column) -> Column:
    """Sample (bias-adjusted) excess kurtosis, NULL below 4 rows."""
    x = n.cast("double")
    scale = (x - 1) / F.nullif((x - 2) * (x - 3), F.lit(0.0))
    return F.when(n >= 4, scale * ((x + 1) * F.kurtosis(c) + 6))


def _row_mean(columns: Sequence[Column]) -> Column:
    """Mean over columns that have a value; 0 without any."""
    total, seen = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
        seen = seen + c.isNotNull().cast("int")
    return F.coalesce(F.try_divide(total, seen), F.lit(0.0))


def _moment_columns(columns: Sequence[str]) -> list[Column]:
    """Adjusted skewness ``s<i>`` and kurtosis ``k<i>``; a constant column has 0, not NaN."""
    stats = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        n = F.count(x)
        constant = F.min(x) == F.max(x)
        stats += [
            F.when(constant & (n >= 3), 0.0).otherwise(adjusted_skewness(x, n)).alias(f"s{i}"),
            F.when(constant & (n >= 4), 0.0).otherwise(adjusted_kurtosis(x, n)).alias(f"k{i}"),
        ]
    return stats


def _mean_moments(columns: Sequence[str]) -> list[Column]:
    return [
        _row_mean([F.col(f"{m}{i}") for i in range(len(columns))]).alias(name)
        for m, name in (("s", "skewness_mean"), ("k", "kurtosis_mean"))
    ]


def moments(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Mean adjusted skewness and kurtosis over the numeric columns."""
    stats = df.agg(F.count(F.lit(1)).alias("__n"), *_moment_columns(columns))
    return stats.select(F.lit(dataset).alias("dataset"), *_mean_moments(columns))


def _pair_array(columns: Sequence[str]) -> Column:
    """Pairwise correlations over the rows that have both; NULL (corr() raises an error) where a column is constant."""

    def corr(a: str, b: str) -> str:
        x, y = sql.double(a), sql.double(b)
        spread = f"stddev_pop(if({y} is null, null, {x})) * stddev_pop(if({x} is null, null, {y}))"
        return f"try_divide(covar_pop({x}, {y}), {spread})"

    cells = [corr(a, b) for a, b in combinations(columns, 2)]
    return F.expr(f"cast(array({', '.join(cells)}) as array<double>)")


def _pair_summary() -> list[Column]:
    """Mean and population std of the array ``r``; 0 when it is empty."""
    values = F.filter("r", lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n)
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return [
        F.coalesce(mean, F.lit(0.0)).alias("correlation_mean"),
        F.coalesce(F.sqrt(F.try_divide(spread, n)), F.lit(0.0)).alias("correlation_std"),
    ]


def correlations(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Mean and population std of the pairwise correlations; 0 with fewer than two columns."""
    if len(columns) < 2:
        return df.groupBy().agg(
            F.lit(dataset).alias("dataset"),
            F.lit(0.0).alias("correlation_mean"),
            F.lit(0.0).alias("correlation_std"),
        )
    if len(columns) * (len(columns) - 1) // 2 <= PAIRS_PER_AGGREGATE:
        pairs = df.agg(_pair_array(columns).alias("r"))
        return pairs.select(F.lit(dataset).alias("dataset"), *_pair_summary())
    pairs = gram.correlation_rows(df, columns).select(F.explode("r").alias("r")).filter(~F.isnan("r"))
    return pairs.agg(
        F.lit(dataset).alias("dataset"),
        F.coalesce(F.avg("r"), F.lit(0.0)).alias("correlation_mean"),
        F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("correlation_std"),
    )


def _limits(columns: Sequence[str]) -> list[Column]:
    """Minimum and maximum of every column, NaN left out."""
    return [
        F.expr(f"{f}({sql.not_nan(c)}) as {f}_{i}") for i, c in enumerate(columns) for f in ("min", "max")
    ]


def _histogram_entropy(df: DataFrame, dataset: str, columns: Sequence[str], limits, bins: int) -> DataFrame:
    """Bins are computed before the melt; at most columns x bins rows leave a map task."""
    cells = []
    for i, c in enumerate(columns):
        lo, hi = limits[f"min_{i}"], limits[f"max_{i}"]
        if lo is None:
            continue
        x = sql.not_nan(c)
        width = (hi - lo) / bins or 1.0
        cells.append(f"{i}, int(least({bins - 1}, floor(({x} - {lo!r}D) / {width!r}D)))")
    if not cells:
        return df.groupBy().agg(F.lit(dataset).alias("dataset"), F.lit(0.0).alias("feature_entropy"))
    counts = (
        df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (c, bin)")
        .filter("bin is not null")
        .groupBy("c", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_column = counts.groupBy("c").agg(
        # -sum(p log2 p) with p = n/N equals log2 N - sum(n log2 n)/N
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h")
    )
    return per_column.agg(
        F.lit(dataset).alias("dataset"),
        (F.coalesce(F.sum("h"), F.lit(0.0)) / F.lit(len(columns))).alias("feature_entropy"),
    )


def entropy(df: DataFrame, dataset: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean Shannon entropy (bits) of an equal-width histogram per numeric column: two scans."""
    limits = df.agg(*_limits(columns)).first() if columns else {}
    return _histogram_entropy(df, dataset, columns, limits, bins)


def expansion(original: int, engineered: int) -> float:
    """Relative growth of the feature count."""
    return (engineered - original) / original


def profile(
    df: DataFrame,
    dataset: str,
    target: str,
    engineered_features: int | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """The 12 meta-features of one dataset as one row."""
    skip = [target, *exclude]
    kinds = column_kinds(df, skip)
    numeric = list(kinds.numeric)
    p = len(kinds.numeric) + len(kinds.categorical) + len(kinds.other)
    growth = expansion(p, engineered_features if engineered_features is not None else p)
    # shapes, moments and limits share a scan; the pairwise sums keep their own, since one
    # aggregate over everything outgrows the size a generated method is compiled at
    first = df.agg(
        *_shape_columns(kinds, p),
        target_variance(df, target).alias("target_variance"),
        *_moment_columns(numeric),
        *_limits(numeric),
    )
    settled = settle_row(first)
    limits = settled.first()
    facts = settled.select(
        F.lit(dataset).alias("dataset"), "n_samples", "n_features", "n_categorical", "n_numerical", "missing_ratio",
        "target_variance", *_mean_moments(numeric),
    )
    parts = [
        facts, _histogram_entropy(df, dataset, numeric, limits, 10), correlations(df, dataset, numeric),
    ]
    joined = reduce(lambda a, b: a.join(b, "dataset"), parts)
    return joined.select(
        "dataset", "n_samples", "n_features", "n_categorical", "n_numerical", "missing_ratio", "feature_entropy",
        "target_variance", "correlation_mean", "correlation_std", "skewness_mean", "kurtosis_mean",
        F.lit(growth).alias("fe_impact_score"),
    )


def quality_report(df: DataFrame, task: str, exclude: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Missing and infinite cells per group in one aggregate."""
    kinds = column_kinds(df, [*exclude, *by])
    p = len(kinds.numeric) + len(kinds.categorical) + len(kinds.other)
    return df.groupBy(*by).agg(
        F.lit(task).alias("task"),
        F.count(F.lit(1)).alias("samples"),
        F.lit(p).cast("long").alias("features"),
        missing_cells(kinds).alias("missing"),
        infinite_cells(kinds).alias("infinite"),
    )


def compare_versions(original: DataFrame, engineered: DataFrame, keys: Sequence[str] = ("task", "fold")) -> DataFrame:
    """Original against engineered report rows per (task, fold)."""
    left = original.select(*keys, F.col("features").alias("original_features"))
    right = engineered.withColumnRenamed("features", "engineered_features")
    return left.join(right, list(keys)).withColumn(
        "expansion_ratio", ratio(F.col("engineered_features"), F.col("original_features"))
    )


def quality_issues(report: DataFrame) -> DataFrame:
    return report.filter((F.col("missing") > 0) | (F.col("infinite") > 0))


def quality_summary(
    report: DataFrame, metrics: Sequence[str], by: str = "task", fold: str = "fold"
) -> DataFrame:
    """Mean of each metric and the number of folds per task, two decimals."""
    return report.groupBy(by).agg(
        *[half_even(F.avg(m), 2).alias(m) for m in metrics], F.count(fold).alias("folds")
    )


def acceptable(
    datasets: DataFrame, min_rows: int = 100, rows: str = "n_samples", numeric_target: str = "numeric_target"
) -> DataFrame:
    """Datasets that hold data, enough rows and a numeric target."""
    return datasets.filter((F.col(rows) >= min_rows) & F.col(numeric_target))


def largest_dataset(shapes_: DataFrame) -> DataFrame:
    """Widest feature set and the dataset with most rows (smallest name on ties)."""
    return shapes_.agg(
        F.max("n_features").alias("max_features"),
        F.min_by("dataset", F.struct(-F.col("n_samples"), F.col("dataset"))).alias("largest_dataset"),
    )


def class_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(label).alias("classes"))
