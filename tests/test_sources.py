import json

import pytest
from pyspark.sql import functions as F

from foldloom.operators import metrics
from foldloom.sources import folds as src
from foldloom.sources import logs, synthetic
from foldloom.operators import leaderboard


def _write(spark, df, path):
    df.coalesce(1).toPandas().to_parquet(path)


@pytest.fixture()
def root(spark, tmp_path):
    for dataset, labelled in (("houses", True), ("exam_dataset", False)):
        for fold in (1, 2) if labelled else (1,):
            folder = tmp_path / dataset / str(fold)
            folder.mkdir(parents=True)
            for split, n in (("train", 20), ("test", 5)):
                i = F.col("id")
                x = spark.range(n).select((i + fold).cast("double").alias("a"), F.concat(F.lit("k"), i % 3).alias("c"))
                _write(spark, x, folder / f"X_{split}.parquet")
                if split == "train" or labelled:
                    _write(spark, spark.range(n).select((i * 10).alias("y")), folder / f"y_{split}.parquet")
    flat = tmp_path / "flat"
    flat.mkdir()
    for split in ("train", "test"):
        _write(spark, spark.range(7).select(F.col("id").alias("a"), (F.col("id") * 2).alias("price")), flat / f"{split}.parquet")
    return str(tmp_path)


def test_fold_directory(spark, root):
    df = src.read_fold_directory(spark, root, "houses", 2)
    assert set(df.columns) == {"dataset", "fold", "split", "row_id", "a", "c", "target"}
    assert df.count() == 25 and df.filter("target is null").count() == 0
    # features and target stay aligned by position
    assert df.filter("a - 2 <> target / 10").count() == 0


def test_unlabelled_dataset_keeps_missing_target(spark, root):
    df = src.read_fold_directory(spark, root, "exam_dataset", 7)
    assert df.filter("split = 'test' and target is not null").count() == 0
    assert df.filter("split = 'train' and target is null").count() == 0
    scored = metrics.regression_metrics(df.withColumn("y_pred", F.lit(1.0)).filter("split = 'test'"), ["dataset"], "target")
    assert scored.count() == 0


def test_discovery(spark, root):
    assert src.discover(spark, root) == ["exam_dataset", "flat", "houses"]
    assert src.discover_folds(spark, root, "houses") == [1, 2]
    found = src.load_all(spark, root)
    assert sorted(found) == ["exam_dataset", "flat", "houses"]
    assert found["flat"].filter("target <> a * 2").count() == 0


def test_partitioned_table_prunes_folds(spark, root, tmp_path):
    df = src.read_fold_directory(spark, root, "houses", 1).unionByName(src.read_fold_directory(spark, root, "houses", 2))
    src.write_folds(df, f"{tmp_path}/table")
    back = src.read_folds(spark, f"{tmp_path}/table", "houses", 2)
    assert back.count() == 25
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_metadata(spark, root, tmp_path):
    df = src.read_fold_directory(spark, root, "houses", 1)
    logs.write_json(src.metadata(df, "houses", ["a", "c"], "target", 10), f"{tmp_path}/meta")
    row = spark.read.json(f"{tmp_path}/meta").first()
    assert (row["name"], row["n_samples"], row["n_features"], row["feature_names"]) == ("houses", 25, 2, ["a", "c"])


def _entry(dataset, algorithm, score, params, folds=2):
    detail = [{"mse": 1.0, "mae": 0.5, "r2": score, "composite_score": score}] * folds
    return {
        "dataset": dataset, "algorithm": algorithm, "best_params": params, "best_score": score,
        "best_metrics": {"composite_score": score, "mse": 1.0 if folds else None, "mae": None, "r2": score if folds else None, "fold_details": detail},
        "n_trials": 50,
    }


def test_logs(spark, tmp_path):
    files = {
        "a_optimization_results.json": [_entry("a", "knn", 0.5, {"p": 2, "weights": "uniform"}), _entry("a", "ridge", 0.7, {"alpha": 0.1})],
        "exam_optimization_results.json": [_entry("exam", "knn", 0.0, {}, folds=0)],
    }
    for name, rows in files.items():
        (tmp_path / name).write_text(json.dumps(rows, indent=2))
    (tmp_path / "bad_optimization_results.json").write_text("{not json")
    log = logs.read_logs(spark, f"{tmp_path}/*_optimization_results.json")
    assert log.count() == 3
    assert logs.unlabelled_results(log).first()["dataset"] == "exam"
    assert logs.scored(log).count() == 2
    assert logs.fold_entries(log).count() == 5
    best = leaderboard.best_per_dataset(logs.as_entries(logs.scored(log))).first()
    assert (best["dataset"], best["algorithm"], best["params"]) == ("a", "ridge", {"alpha": "0.1"})
    logs.write_text(logs.ranking_text(logs.scored(log)), f"{tmp_path}/text")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/text").collect()]
    assert lines[0] == "Dataset: a" and lines[1].startswith("1. ridge: 0.7000 (R2: 0.7000") and lines[3].startswith("Best Algorithm: ridge")
    logs.write_logs(log, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


def test_predictions_and_results(spark, tmp_path):
    rows = [("s", f, float(i), float(i) + 0.5) for f in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "dataset string, fold int, y_true double, y_pred double")
    logs.write_predictions(df, f"{tmp_path}/p")
    assert spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/p").count() == 20
    for f in (1, 2):
        df.filter(F.col("fold") == f).select("y_true", "y_pred").toPandas().to_csv(tmp_path / f"my_set_fold_{f}_predictions.csv", index=False)
    back = logs.read_predictions(spark, f"{tmp_path}/my_set_fold_*_predictions.csv")
    scored = metrics.regression_metrics(back, ["dataset", "fold"])
    assert {(r["dataset"], r["fold"], r["mse"]) for r in scored.collect()} == {("my_set", 1, 0.25), ("my_set", 2, 0.25)}
    shapes = scored.select("dataset", "fold", F.array(F.lit(90), F.lit(3)).alias("train_shape"), F.array(F.lit(10), F.lit(3)).alias("test_shape"))
    results = logs.fold_results(scored, "ridge", {"alpha": 0.1}, shapes)
    row = results.orderBy("fold").first()
    assert row["hyperparams"] == {"alpha": "0.1"} and row["metrics"]["rmse"] == 0.5 and row["is_exam_dataset"] is False
    logs.write_json(logs.summarise_results(results), f"{tmp_path}/summary")
    summary = spark.read.json(f"{tmp_path}/summary").first()
    assert summary["total_folds"] == 2 and summary["average_metrics"]["avg_mse"] == 0.25 and len(summary["all_results"]) == 2
    logs.write_prediction_vector(df.withColumn("row_id", F.monotonically_increasing_id()), f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").columns == ["row_id", "y_pred"]


def test_synthetic_data_is_repeatable_and_linear(spark):
    sets = synthetic.synthetic_datasets(spark, 2)
    assert sorted(sets) == ["synthetic_reg_01", "synthetic_reg_02"]
    df = sets["synthetic_reg_01"]
    assert df.exceptAll(synthetic.synthetic_datasets(spark, 1)["synthetic_reg_01"]).count() == 0
    big = synthetic.synthetic_regression(spark.range(5000), "id", 4, 3, 0.1)
    stats = big.agg(F.avg("feature_0"), F.stddev("feature_0"), F.corr("feature_0", "feature_1")).first()
    assert abs(stats[0]) < 0.1 and abs(stats[1] - 1) < 0.1 and abs(stats[2]) < 0.1
