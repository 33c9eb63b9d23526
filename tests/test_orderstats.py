import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import orderstats
from foldloom.operators.derive import assign_tiles, ntile_cuts


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(orderstats, "BUCKETS", 16)


def _values(kind, n=400):
    rng = random.Random(7)
    if kind == "uniform":
        return [rng.uniform(-5, 5) for _ in range(n)]
    if kind == "heavy":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(n)]
    if kind == "ties":
        return [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(n)]
    if kind == "third":
        return [3.25 if i % 3 == 0 else rng.gauss(0, 1) for i in range(n)]
    return [math.inf if i % 10 == 0 else -math.inf if i % 11 == 0 else rng.random() for i in range(n)]


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "third", "infinite"])
def test_hot_group_quantiles_equal_numpy(spark, kind):
    values = _values(kind)
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[:40]], "g string, x double")
    out = orderstats.grouped_quantiles(df, ["g"], "x", PROBS, hot_rows=100, small=20).collect()
    got = {r["g"]: r["q"] for r in out}
    for g, part in (("a", values), ("b", values[:40])):
        if kind == "infinite":
            ordered = sorted(part)
            assert got[g][0] == ordered[0] and got[g][-1] == ordered[-1]
            assert got[g][3] == pytest.approx(np.quantile(part, 0.5))
        else:
            assert got[g] == pytest.approx(list(np.quantile(part, PROBS)), rel=1e-12, abs=1e-300)


def test_wide_path_equals_one_aggregate(spark):
    df = spark.range(500).select(
        (F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.sin("id")).alias("b"),
        F.lit(None).cast("double").alias("empty"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(1.0).alias("c"),
    )
    names = ["a", "b", "empty", "c"]
    one = orderstats.column_quantiles(df, names, [0.25, 0.5]).first()
    many = orderstats.column_quantiles(df, names, [0.25, 0.5], cells=10, hot_rows=50, small=20).first()
    for c in names:
        assert (one[f"{c}__q"] or None) == pytest.approx(many[f"{c}__q"] or None)


def test_quantiles_by_group(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("g"), (F.col("id") * 31 % 101).cast("double").alias("x"))
    one = {r["g"]: tuple(r["x__q"]) for r in orderstats.column_quantiles(df, ["x"], [0.1, 0.5], ["g"]).collect()}
    many = orderstats.column_quantiles(df, ["x"], [0.1, 0.5], ["g"], cells=1, hot_rows=10, small=10)
    got = {r["g"]: tuple(r["x__q"]) for r in many.collect()}
    assert set(got) == set(one)
    for g, q in got.items():
        assert q == pytest.approx(one[g])


@pytest.mark.parametrize("small", [5, 100_000])
def test_ranks_over_two_keys(spark, small):
    rng = random.Random(3)
    # a third of the rows tie on the first key
    rows = [(0 if i % 3 == 0 else rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, id long")
    wanted = [1, 2, 100, 133, 134, 399, 400]
    sizes, found = orderstats.select_ranks(df, ["k", "id"], lambda n: wanted, small=small)
    ordered = sorted(rows)
    assert sizes[()] == 400
    assert found[()] == {r: ordered[r - 1] for r in wanted}


@pytest.mark.parametrize("small", [5, 100_000])
def test_ranks_by_group_with_named_ranks(spark, small):
    rows = [("x" if i % 3 == 0 else "y", (i * 7919) % 211, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, id long")
    wanted = {("x",): [1, 50, 100], ("y",): [200]}
    _, found = orderstats.select_ranks(df, ["k", "id"], wanted, by=["g"], small=small)
    for (g,), ranks in wanted.items():
        ordered = sorted((k, i) for h, k, i in rows if h == g)
        assert found[(g,)] == {r: ordered[r - 1] for r in ranks}


@pytest.mark.parametrize("n,k", [(10, 3), (3, 5), (7, 7), (100, 10), (101, 10), (1, 4)])
def test_tiles_equal_ntile(spark, n, k):
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 31).alias("key"))
    got = {r["id"]: r["t"] for r in assign_tiles(df, ["key", "id"], k, "t").collect()}
    ordered = sorted(((i * 7919) % 31, i) for i in range(n))
    size, extra = divmod(n, k)
    expected, at = {}, 0
    for tile in range(k):
        for _ in range(size + (tile < extra)):
            expected[ordered[at][1]] = tile + 1
            at += 1
    assert got == expected
    assert len(ntile_cuts(n, k)) == k - 1


def test_no_window_without_partition(spark):
    """Fold assignment is a projection: no exchange, no sort, no global window."""
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 10007).alias("key"))
    plan = assign_tiles(df, ["key", "id"], 10, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan
