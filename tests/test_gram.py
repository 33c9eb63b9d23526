import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import gram, linear, profile


def wide(spark, columns, rows=300, gaps=False):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(rows, columns)) * 10.0 ** draw.integers(-2, 3, columns) + draw.integers(-50, 50, columns)
    x[:, 1] = x[:, 0] * 3 + draw.normal(size=rows)
    cells = [[None if gaps and draw.random() < 0.1 else float(v) for v in row] for row in x]
    schema = "fold int, " + ", ".join(f"c{i} double" for i in range(columns))
    return spark.createDataFrame([(i % 3, *row) for i, row in enumerate(cells)], schema)


def brute(df, names):
    x = np.array([[np.nan if v is None else v for v in r] for r in df.select(names).collect()])
    out = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            out.append(np.corrcoef(x[both, i], x[both, j])[0, 1] if both.sum() > 1 else np.nan)
    return np.array(out)


@pytest.mark.parametrize("gaps", [False, True])
def test_pairs_equal_numpy(spark, gaps):
    names = [f"c{i}" for i in range(30)]
    df = wide(spark, 30, gaps=gaps).repartition(3)
    rows = sorted(gram.correlation_rows(df, names).collect())
    got = np.array([r for row in rows for r in row["r"]])
    assert got == pytest.approx(brute(df, names), abs=1e-9)
    summary = profile.correlations(df, "d", names).first()
    assert summary["correlation_mean"] == pytest.approx(got.mean()) and summary["correlation_std"] == pytest.approx(got.std())


def test_columns_without_a_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, float("nan"), 2.0), (2.0, 5.0, None, 1.0, 1.0), (4.0, 5.0, 3.0, 2.0, 0.0)],
        "a double, b double, c double, d double, e double",
    )
    rows = sorted(gram.correlation_rows(df, ["a", "b", "c", "d", "e"]).collect())
    found = {(r["i"], r["i"] + 1 + k): v for r in rows for k, v in enumerate(r["r"])}
    assert found.pop((0, 4)) == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 0])[0, 1])
    assert len(found) == 9 and all(np.isnan(v) for v in found.values())


@pytest.mark.parametrize("fold", [None, "fold"])
def test_wide_moments_equal_narrow_ones(spark, fold, monkeypatch):
    df, names = wide(spark, 12), [f"c{i}" for i in range(11)]
    narrow = linear.fold_moments(df, names, "c11", fold)
    monkeypatch.setattr(linear, "PRODUCTS_PER_AGGREGATE", 1)
    broad = linear.fold_moments(df, names, "c11", fold)
    assert broad.parts.keys() == narrow.parts.keys()
    for without in (None, 1) if fold else (None,):
        a, b = (linear.solve_ridge(m, 1.0, without) for m in (narrow, broad))
        assert a == pytest.approx(b)


def test_440_columns_are_one_scan(spark):
    names = [f"c{i}" for i in range(440)]
    df = spark.range(200).select([F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)])
    plan = gram.correlation_rows(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
    group = "wide"
    spark.sparkContext.setJobGroup(group, group)
    try:
        moments = linear.fold_moments(df, names[:-1], names[-1])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the sample for the centre, and one pass
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 4
    assert moments.parts[0][2].shape == (440, 440)
