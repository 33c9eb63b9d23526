"""Many classes, many fold folders."""

import pytest
from pyspark.sql import functions as F

from foldloom.operators import folds
from foldloom.sources import folds as source


def test_many_classes_get_the_folds_of_few(spark):
    df = spark.range(4000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 97 == 1, None).otherwise(F.col("id") * 7919 % 331).alias("label"),
    )
    rows = lambda d: sorted((r["row_id"], r["label"], r["fold"]) for r in d.fillna(-9, ["label", "fold"]).collect())
    want = rows(folds.stratified_kfold(df, "label", "row_id", 5))
    assert rows(folds.stratified_kfold(df, "label", "row_id", 5, few=3)) == want
    assert rows(folds.stratified_kfold(df, "label", "row_id", 5, few=3, hot_rows=500)) == want
    assert {f for _, label, f in want if label == -9} == {-9}


def test_a_million_classes(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("row_id"), (F.col("id") * 7 % 1_000_003).alias("label"))
    sizes = folds.stratified_kfold(df, "label", "row_id", 4).groupBy("fold").count().collect()
    assert sorted(tuple(r) for r in sizes) == [(f, 250_000) for f in range(1, 5)]


def test_fold_folders_are_read_in_a_fixed_number_of_jobs(spark, tmp_path):
    df = spark.range(60).select(
        F.col("id"), (F.col("id") * 3).cast("double").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).otherwise(float("nan")).alias("b"),
        (F.col("id") + 100).alias("y"),
    )

    def jobs(dataset, k):
        folded = df.withColumn("fold", (F.col("id") % k).cast("int"))
        for fold in range(k):
            source.write_fold_files(folded, f"{tmp_path}/r", dataset, fold, "y", "id")
        group = f"read-{dataset}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = source.read_dataset(spark, f"{tmp_path}/r", dataset).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(rows) == 60 * k
        for r in rows:
            assert r["target"] == r["a"] / 3 + 100 and (r["split"] == "test") == (r["a"] / 3 % k == r["fold"])
            assert r["b"] is None or r["b"] == r["a"] / 3
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs("wide", 12) <= jobs("slim", 2) + 1
    assert source.fold_layout(spark, f"{tmp_path}/r") == {"slim": [0, 1], "wide": list(range(12))}


@pytest.mark.parametrize("labels", ["none", "train"])
def test_folds_without_targets(spark, tmp_path, labels):
    x = spark.range(5).select(F.col("id").cast("double").alias("a")).coalesce(1)
    for split in ("train", "test"):
        x.write.parquet(f"{tmp_path}/e/1/X_{split}.parquet")
    if labels == "train":
        x.write.parquet(f"{tmp_path}/e/1/y_train.parquet")
    rows = source.read_dataset(spark, str(tmp_path), "e").collect()
    assert len(rows) == 10
    assert all((r["target"] == r["a"]) if labels == "train" and r["split"] == "train" else r["target"] is None for r in rows)


def test_fold_files_in_parts_match_by_position(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "FILE_ROWS", 50)
    df = spark.range(300).select(
        (F.col("id") * 7919 % 300).alias("id"), F.col("id").cast("double").alias("a"), (F.col("id") + 100).alias("y"), (F.col("id") % 2).alias("fold")
    ).repartition(7)
    source.write_fold_files(df, str(tmp_path), "d", 1, "y", "id")
    files = spark.read.parquet(f"{tmp_path}/d/1/X_train.parquet").inputFiles()
    assert len(files) > 3 and len(spark.read.parquet(f"{tmp_path}/d/1/y_train.parquet").inputFiles()) == len(files)
    found = source.read_dataset(spark, str(tmp_path), "d")
    # the targets of a large dataset are no table to send to every task
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    for rows in (found.collect(), source.read_fold_directory(spark, str(tmp_path), "d", 1).collect()):
        assert len(rows) == 300 == len({(r["split"], r["row_id"]) for r in rows})
        assert all(r["target"] == r["a"] + 100 and (r["split"] == "test") == (r["a"] % 2 == 1) for r in rows)
