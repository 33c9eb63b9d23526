"""Synthetic regression data: a linear target over standard normal features plus noise.

Every cell is a function of the row key, so any task can produce any row and a
repeated task produces the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.numeric import normal


def coefficient(j: int, seed: int) -> float:
    """Weight of feature ``j``: 1 to 100, arithmetic in (j, seed)."""
    return 1.0 + ((j * 7919 + seed * 104729) % 9901) / 9901 * 99.0


def synthetic_regression(
    keys: DataFrame,
    key: str,
    features: int = 10,
    informative: int = 6,
    noise: float = 0.2,
    bias: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """``feature_0 .. feature_{p-1}, target`` for every row of ``keys``."""
    x = {f"feature_{j}": normal(F.col(key), seed + j) for j in range(features)}
    base = keys.select(F.col(key).alias("row_id"), *[e.alias(n) for n, e in x.items()])
    target = F.lit(float(bias))
    for j in range(informative):
        target = target + F.lit(coefficient(j, seed)) * F.col(f"feature_{j}")
    target = target + F.lit(float(noise)) * normal(F.col("row_id"), seed + 1000)
    return base.withColumn("target", target)


def synthetic_datasets(spark: SparkSession, count: int, seed: int = 42) -> dict[str, DataFrame]:
    """Several datasets of differing size, width, noise and bias."""
    # fixed values: sizes and widths drawn from
    sizes, widths = [500, 1000, 2000, 5000, 8000], [5, 10, 15, 20, 30, 50]
    out = {}
    for i in range(count):
        u = [((i * 7919 + seed * 31 + s * 104729) % 10007) / 10007 for s in range(5)]
        rows, p = sizes[int(u[0] * len(sizes))], widths[int(u[1] * len(widths))]
        informative = max(3, int(p * (0.5 + 0.4 * u[2])))
        out[f"synthetic_reg_{i + 1:02d}"] = synthetic_regression(
            spark.range(rows), "id", p, informative, 0.1 + 0.2 * u[3], -10 + 20 * u[4], seed + i
        )
    return out
