import pytest
from pyspark.sql import functions as F

from foldloom.operators import encode
from foldloom.operators.state import lookup, settle, with_state
from foldloom.session import checkpointed


def test_local_and_large_state_join_alike(spark):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k")
    ).withColumn("k", F.when(F.col("id") % 50 == 1, "new").otherwise(F.col("k")))
    state = df.filter("k <> 'new'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    small = settle(state)
    large = settle(state, limit=10)
    assert small.local and not large.local
    a = {tuple(r) for r in lookup(df, small, ["k"]).select("id", "k", "n", "s").collect()}
    b = {tuple(r) for r in lookup(df, large, ["k"], hot_share=10).select("id", "k", "n", "s").collect()}
    assert a == b and len(a) == 3000


def test_codes_beyond_one_task(spark):
    values = spark.range(500).select(
        F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("column"),
        F.format_string("%05d", F.col("id") * 7919 % 10007).alias("key"), F.lit(1).cast("long").alias("n"),
    )
    one = {(r["column"], r["key"]): r["code"] for r in encode.order_codes(values, "column", "key").collect()}
    many = {(r["column"], r["key"]): r["code"] for r in encode.order_codes(values, "column", "key", limit=20).collect()}
    assert one == many
    assert sorted(c for (g, _), c in many.items() if g == "b") == list(range(400))


def test_encoders_with_large_state(spark):
    df = spark.range(400).select(
        F.col("id"), F.concat(F.lit("v"), F.col("id") % 97).alias("c"), (F.col("id") % 11).alias("y")
    )
    kwargs = dict(label="code", target_mean="m", frequency="f", count="n")
    small = encode.encode(df, encode.fit_categories(df, ["c"], "y"), "c", **kwargs)
    large = encode.encode(df, encode.fit_categories(df, ["c"], "y", limit=10), "c", **kwargs)
    key = lambda rows: sorted((r["id"], r["code"], round(r["m"], 9), r["f"], r["n"]) for r in rows)
    assert key(small.collect()) == key(large.collect())


def test_state_values_survive_as_literals(spark):
    state = spark.createDataFrame(
        [(0.1, float("inf"), "it's \\ ok", [1.5, float("nan")], None, 3)],
        "a double, b double, c string, d array<double>, e double, f long",
    )
    row = with_state(spark.range(1), state).first()
    assert row["a"] == 0.1 and row["b"] == float("inf") and row["c"] == "it's \\ ok"
    assert row["d"][0] == 1.5 and row["d"][1] != row["d"][1] and row["e"] is None and row["f"] == 3


def test_checkpoint_keeps_rows(spark):
    assert checkpointed(spark.range(10)).count() == 10


def test_out_of_fold_means_ignore_own_fold(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 2, 40.0), ("b", 1, 5.0)], "c string, fold int, y double")
    out = encode.out_of_fold_target_encode(df, "c", "y", "fold", "m").collect()
    got = {(r["c"], r["fold"]): r["m"] for r in out}
    assert got[("a", 1)] == 30.0 and got[("a", 2)] == 10.0
    assert got[("b", 1)] == 30.0  # only in fold 1: mean of all other-fold rows


def test_lookup_is_not_a_cross_join(spark):
    state = settle(spark.createDataFrame([("x", 1)], "k string, n long"))
    plan = lookup(spark.createDataFrame([("x",)], "k string"), state, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan


@pytest.mark.parametrize("unseen,expected", [("first", 0), ("mode", 1), ("null", None)])
def test_unseen_categories(spark, unseen, expected):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    known = encode.fit_categories(train, ["c"])
    out = encode.encode(spark.createDataFrame([("zz",)], "c string"), known, "c", label="code", unseen=unseen)
    assert out.first()["code"] == expected
