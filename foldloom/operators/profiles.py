"""Profiles of many datasets at once.

Every dataset's rows share one frame: the numeric cells as an array, the number of missing cells of any
kind, the target.  Facts of datasets, moments and limits of columns, histograms and pairwise sums are one
scan each; the limits travel to the histogram as state looked up by (dataset, column).  The plan is
as large for a thousand datasets as for one, once their frames are united.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.functions.numeric import ratio
from foldloom.operators import gram
from foldloom.operators.columns import column_kinds
from foldloom.operators.profile import adjusted_kurtosis, adjusted_skewness, expansion
from foldloom.operators.state import lookup, settle

BINS = 10


@dataclass(frozen=True)
class Width:
    numeric: int
    other: int
    #: columns after feature engineering
    engineered: int

    @property
    def columns(self) -> int:
        return self.numeric + self.other


def profile_rows(
    frames: Mapping[str, tuple[DataFrame, str]], engineered: Mapping[str, int] | None = None, exclude: tuple = ()
) -> tuple[DataFrame, dict[str, Width]]:
    """dataset, x, missing, y of every row of the frames (name -> frame, target), and the datasets' widths."""
    parts, widths = [], {}
    for name, (df, target) in sorted(frames.items()):
        kinds = column_kinds(df, [target, *exclude])
        gaps = [f"int({sql.name(c)} is null or isnan({sql.double(c)}))" for c in kinds.numeric]
        gaps += [f"int({sql.name(c)} is null)" for c in (*kinds.categorical, *kinds.other)]
        cells = ", ".join(sql.double(c) for c in kinds.numeric)
        parts.append(
            df.select(
                F.lit(name).alias("dataset"), F.expr(f"cast(array({cells}) as array<double>)").alias("x"),
                F.expr(f"bigint({' + '.join(gaps) or '0'})").alias("missing"), F.col(target).cast("double").alias("y"),
            )
        )
        p = len(kinds.numeric) + len(kinds.categorical) + len(kinds.other)
        widths[name] = Width(len(kinds.numeric), p - len(kinds.numeric), (engineered or {}).get(name, p))
    return reduce(DataFrame.unionByName, parts), widths


def profiles(rows: DataFrame, widths: Mapping[str, Width], bins: int = BINS) -> DataFrame:
    """The 12 meta-features of every dataset: a row each."""
    spark = rows.sparkSession
    facts = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("missing").alias("missing"), F.var_pop("y").alias("target_variance")
    )
    cells = rows.select("dataset", F.posexplode("x").alias("pos", "x"))
    known = F.when(~F.isnan("x"), F.col("x"))
    finite = F.when(F.abs(known) != F.lit(float("inf")), known)
    n, constant = F.count("x"), F.min("x") == F.max("x")
    columns = settle(
        cells.groupBy("dataset", "pos").agg(
            n.alias("n"), F.min(known).alias("lo"), F.max(known).alias("hi"), F.avg(finite).alias("center"),
            F.when(constant & (n >= 3), 0.0).otherwise(adjusted_skewness(F.col("x"), n)).alias("skewness"),
            F.when(constant & (n >= 4), 0.0).otherwise(adjusted_kurtosis(F.col("x"), n)).alias("kurtosis"),
        )
    )
    moments = columns.table.groupBy("dataset").agg(
        F.coalesce(F.avg("skewness"), F.lit(0.0)).alias("skewness_mean"),
        F.coalesce(F.avg("kurtosis"), F.lit(0.0)).alias("kurtosis_mean"),
    )
    width = F.coalesce(F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0)), F.lit(1.0))
    at = F.least(F.lit(bins - 1), F.floor((known - F.col("lo")) / width))
    placed = lookup(cells, columns, ["dataset", "pos"]).select("dataset", "pos", at.cast("int").alias("bin"))
    counts = placed.filter("bin is not null").groupBy("dataset", "pos", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_column = counts.groupBy("dataset", "pos").agg(
        # -sum(p log2 p) with p = n/N equals log2 N - sum(n log2 n)/N
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h")
    )
    entropy = per_column.groupBy("dataset").agg(F.sum("h").alias("entropy"))
    centers = {d: np.zeros(w.numeric) for d, w in widths.items()}
    for r in columns.table.select("dataset", "pos", "center").collect():
        centers[r["dataset"]][r["pos"]] = r["center"] or 0.0
    pairs = gram.correlations_of(rows.select(F.col("dataset").alias("key"), "x"), centers)
    pairs = pairs.select("dataset", F.explode("r").alias("r")).filter(~F.isnan("r"))
    pairs = pairs.groupBy("dataset").agg(F.avg("r").alias("correlation_mean"), F.stddev_pop("r").alias("correlation_std"))
    shapes = spark.createDataFrame(
        [(d, w.columns, w.other, w.numeric, expansion(w.columns, w.engineered)) for d, w in widths.items()],
        "dataset string, n_features long, n_categorical long, n_numerical long, fe_impact_score double",
    )
    # a row per dataset on every side
    out = reduce(lambda a, b: a.join(b, "dataset", "left"), (facts, shapes, moments, entropy, pairs))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(
        "dataset", "n_samples", "n_features", "n_categorical", "n_numerical",
        F.coalesce(ratio(F.col("missing"), F.col("n_samples") * F.col("n_features")), F.lit(0.0)).alias("missing_ratio"),
        F.coalesce(ratio(F.col("entropy"), F.col("n_numerical")), F.lit(0.0)).alias("feature_entropy"),
        "target_variance", zero("correlation_mean"), zero("correlation_std"), zero("skewness_mean"), zero("kurtosis_mean"),
        "fe_impact_score",
    )
