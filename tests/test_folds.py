import pytest
from pyspark.sql import functions as F

from foldloom.operators import folds


@pytest.mark.parametrize("n", [7, 100, 1003])
def test_kfold_is_complete_and_balanced(spark, n):
    df = folds.shuffled_kfold(spark.range(n).withColumnRenamed("id", "row_id"), "row_id", 10)
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_seed_changes_the_assignment(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    a = {r["row_id"]: r["fold"] for r in folds.shuffled_kfold(df, "row_id", 5).collect()}
    b = {r["row_id"]: r["fold"] for r in folds.shuffled_kfold(df, "row_id", 5, seed=99).collect()}
    assert a != b


def test_stratified_keeps_shares(spark):
    df = spark.range(403).select(F.col("id").alias("row_id"), F.when(F.col("id") % 9 == 0, "rare").otherwise("common").alias("y"))
    out = folds.stratified_kfold(df, "y", "row_id", 5)
    for y in ("rare", "common"):
        sizes = [r["count"] for r in out.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_expansion_has_every_row_once_per_fold(spark):
    df = folds.shuffled_kfold(spark.range(30).withColumnRenamed("id", "row_id"), "row_id", 5)
    out = folds.expand_folds(df, k=5)
    assert out.count() == 150
    assert out.filter("split = 'test'").groupBy("row_id").count().filter("count <> 1").count() == 0


def test_holdouts(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    assert folds.holdout(df, "row_id").filter("split = 'test'").count() == 21
    last = folds.sequential_holdout(df, "row_id").filter("split = 'test'")
    assert sorted(r["row_id"] for r in last.collect()) == list(range(91, 101))


def test_sample_cap(spark):
    df = spark.range(100)
    assert folds.sample_cap(df, ["id"], above=100, keep=10).count() == 100
    assert folds.sample_cap(df, ["id"], above=99, keep=10).count() == 10
