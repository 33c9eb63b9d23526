import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import leaderboard, linear, metrics, models
from foldloom.plans import pipeline, recommend, search
from foldloom.sources import logs, synthetic


def _frame(spark, n=120):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.gauss(1000, 3), rng.gauss(0, 1)
        rows.append((i, i % 4, a, b, 2 * a - 3 * b + rng.gauss(0, 0.1)))
    return rows, spark.createDataFrame(rows, "row_id long, fold int, a double, b double, y double")


def test_ridge_equals_normal_equations(spark):
    rows, df = _frame(spark)
    sums = linear.fold_moments(df, ["a", "b"], "y", "fold")
    for alpha in (0.0, 5.0):
        for fold in range(4):
            part = np.array([r[2:] for r in rows if r[1] != fold])
            x, y = part[:, :2], part[:, 2]
            xc, yc = x - x.mean(0), y - y.mean()
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
            expected = [*w, y.mean() - x.mean(0) @ w]
            assert linear.solve_ridge(sums, alpha, fold) == pytest.approx(expected, rel=1e-7)


def test_no_intercept(spark):
    rows, df = _frame(spark)
    part = np.array([r[2:] for r in rows])
    expected = np.linalg.lstsq(part[:, :2], part[:, 2], rcond=None)[0]
    got = linear.solve_ridge(linear.fold_moments(df, ["a", "b"], "y"), intercept=False)
    assert got == pytest.approx([*expected, 0.0], rel=1e-6)


def test_lasso_satisfies_its_conditions(spark):
    rows, df = _frame(spark)
    alpha = 0.5
    w = linear.solve_lasso(linear.fold_moments(df, ["a", "b"], "y"), alpha)
    part = np.array([r[2:] for r in rows])
    x, y = part[:, :2] - part[:, :2].mean(0), part[:, 2] - part[:, 2].mean()
    gradient = x.T @ (x @ w[:2] - y) / len(x)
    for g, v in zip(gradient, w[:2], strict=True):
        assert abs(g) <= alpha + 1e-6 if v == 0 else abs(g + alpha * np.sign(v)) < 1e-5


def test_estimator_parameters():
    made = models.make_estimator("xgboost", {"n_estimators": "7", "max_depth": 40, "learning_rate": 0.1, "reg_alpha": 1})
    assert made.ignored == ("reg_alpha",)
    assert made.estimator.getMaxIter() == 7 and made.estimator.getMaxDepth() == 30
    ridge = models.make_estimator("ridge", {"alpha": 50}, rows=100).estimator
    assert ridge.getRegParam() == 0.5 and ridge.getElasticNetParam() == 0.0
    with pytest.raises(ValueError, match="unknown"):
        models.make_estimator("mystery")


def test_early_stop_equals_a_loop(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for g in range(6):
        losses = [rng.random() / (1 + (i if g % 2 else 0)) for i in range(60 + g)]
        rows += [(g, i, v) for i, v in enumerate(losses)]
        best, at, stop = None, 0, None
        for i, v in enumerate(losses):
            if best is None or v < best:
                best, at = v, i
            elif i - at >= 8:
                stop = i
                break
        expected[g] = (at, stop if stop is not None else len(losses) - 1, stop is not None)
    df = spark.createDataFrame(rows, "g int, step long, loss double")
    for block in (5, 1000):
        out = leaderboard.early_stop(df, 8, by=["g"], block=block).collect()
        assert {r["g"]: (r["best_step"], r["stop_step"], r["stopped_early"]) for r in out} == expected


def test_search_keeps_fold_details(spark):
    df = synthetic.synthetic_regression(spark.range(200), "id", 3, 3, 0.1).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    names = ["feature_0", "feature_1", "feature_2"]
    out = search.search_dataset(df, "made", names, "target", ["ridge", "knn"], 2)
    rows = {r["algorithm"]: r for r in out.collect()}
    assert set(rows) == {"ridge", "knn"}
    for r in rows.values():
        details = r["best_metrics"]["fold_details"]
        assert len(details) == 3 and r["n_trials"] == 2
        assert r["best_score"] == pytest.approx(sum(d["r2"] for d in details) / 3)
    assert rows["ridge"]["best_score"] > 0.9


def test_shared_configuration_never_sees_test_labels(spark):
    df = synthetic.synthetic_regression(spark.range(100), "id", 2, 2, 0.1)
    train, test = df.filter("row_id < 80"), df.filter("row_id >= 80")
    config = {"algorithm": "ridge", "params": {"alpha": "0.1"}}
    names = ["feature_0", "feature_1"]
    a = search.fit_shared(train, test, names, "target", config)
    b = search.fit_shared(train, test.withColumn("target", F.lit(0.0)), names, "target", config)
    key = lambda x: {r["row_id"]: r["y_pred"] for r in x.collect()}
    assert key(a) == pytest.approx(key(b)) and len(key(a)) == 20


def test_constrain():
    assert recommend.constrain("knn", {"n_neighbors": "90", "weights": "odd", "p": "-2.7"}) == {
        "n_neighbors": "20", "weights": "uniform", "p": "2"}
    assert recommend.constrain("knn", {})["n_neighbors"] == "5"
    assert recommend.constrain("xgboost", {"max_depth": "99", "learning_rate": "0.9"}) == {"max_depth": "15", "learning_rate": "0.3"}


def test_pipeline_runs_all_stages(spark):
    sets = {}
    for i in range(2):
        df = synthetic.synthetic_regression(spark.range(90), "id", 3, 2, 0.1, seed=7 + i)
        sets[f"set_{i}"] = (df, "target")
    out = pipeline.run_pipeline(sets, algorithms=("ridge", "lasso"), trials=1, k=3)
    status = {r["step"]: r["status"] for r in out.status.collect()}
    assert status == dict.fromkeys(("feature_engineering", "search", "recommendation", "final_training"), "SUCCESS")
    assert out.fold_metrics.count() == 6 and out.gaps.count() == 2
    assert out.predictions.count() == 180


def test_a_failing_stage_is_recorded(spark):
    df = synthetic.synthetic_regression(spark.range(30), "id", 2, 2, 0.1)
    out = pipeline.run_pipeline({"s": (df, "no_such_column")}, algorithms=("ridge",), trials=1, k=3)
    status = [r["status"] for r in out.status.collect()]
    assert status[0].startswith("FAILED") and len(status) == 4


# Stored best search scores and the winner per dataset.
STORED = [
    ("bike_sharing_demand", "random_forest", 0.414317), ("bike_sharing_demand", "knn", 0.577231),
    ("bike_sharing_demand", "xgboost", 0.265222), ("bike_sharing_demand", "mlp", 0.592543),
    ("brazilian_houses", "random_forest", 0.708314), ("brazilian_houses", "knn", 0.847108),
    ("brazilian_houses", "xgboost", 0.736631), ("brazilian_houses", "mlp", 0.870925),
    ("superconductivity", "random_forest", 0.810702), ("superconductivity", "knn", 0.885223),
    ("superconductivity", "xgboost", 0.731418), ("superconductivity", "mlp", 0.876587),
    ("wine_quality", "random_forest", 0.366090), ("wine_quality", "knn", 0.362961),
    ("wine_quality", "xgboost", 0.375505), ("wine_quality", "mlp", 0.299795),
    ("yprop_4_1", "random_forest", 0.056328), ("yprop_4_1", "knn", -0.030818),
    ("yprop_4_1", "xgboost", 0.035164), ("yprop_4_1", "mlp", -0.015617),
]
WINNERS = {
    "bike_sharing_demand": "mlp", "brazilian_houses": "mlp", "superconductivity": "knn",
    "wine_quality": "xgboost", "yprop_4_1": "random_forest",
}


def test_winners_of_the_stored_search(spark):
    rows = [(d, a, 1, s, {"x": "1"}, i) for i, (d, a, s) in enumerate(STORED)]
    log = spark.createDataFrame(rows, "dataset string, algorithm string, fold int, score double, params map<string,string>, seq long")
    assert {r["dataset"]: r["algorithm"] for r in leaderboard.best_per_dataset(log).collect()} == WINNERS


@pytest.fixture()
def stored():
    """Folder with stored predictions, summaries and search logs; not part of this repository."""
    folder = os.environ.get("FOLDLOOM_STORED_DIR")
    if not folder or not Path(folder).exists():
        pytest.skip("no stored results")
    return folder


def test_metrics_of_stored_predictions(spark, stored):
    predictions = logs.read_predictions(spark, f"{stored}/*/*_fold_*_predictions.csv")
    scored = metrics.regression_metrics(predictions, ["dataset", "fold"])
    results = (
        spark.read.schema(f"dataset string, all_results array<struct<{'dataset:string,fold:int,metrics:struct<mse:double,mae:double,r2_score:double,rmse:double>'}>>, "
                          "average_metrics map<string,double>")
        .option("multiLine", True).json(f"{stored}/*/*_summary.json").filter("dataset is not null")
    )
    per_fold = results.select(F.inline("all_results")).select("dataset", "fold", "metrics.*")
    joined = scored.withColumnRenamed("mse", "m").withColumnRenamed("mae", "a").withColumnRenamed("rmse", "s").join(per_fold, ["dataset", "fold"])
    rows = joined.collect()
    assert len(rows) == 41
    for r in rows:
        assert (r["m"], r["a"], r["r2"], r["s"]) == pytest.approx((r["mse"], r["mae"], r["r2_score"], r["rmse"]), rel=1e-9)
    stored_means = {r["dataset"]: r["average_metrics"] for r in results.collect()}
    for r in metrics.cross_fold_summary(scored).collect():
        want = stored_means[r["dataset"]]
        for m, s in (("mse", "mse"), ("mae", "mae"), ("r2", "r2_score"), ("rmse", "rmse")):
            assert r[f"avg_{m}"] == pytest.approx(want[f"avg_{s}"], rel=1e-9)
            assert r[f"std_{m}"] == pytest.approx(want[f"std_{s}"], rel=1e-9, abs=1e-12)


def test_stored_search_logs(spark, stored):
    log = logs.read_logs(spark, f"{stored}/*/*_optimization_results.json")
    assert log.count() == 24
    best = leaderboard.best_per_dataset(logs.as_entries(logs.scored(log)))
    assert {r["dataset"]: r["algorithm"] for r in best.collect()} == WINNERS
    assert {r["dataset"] for r in logs.unlabelled_results(log).collect()} == {"exam_dataset"}
    means = logs.fold_entries(logs.scored(log)).groupBy("dataset", "algorithm").agg(F.avg("score").alias("m"))
    for r in means.join(log, ["dataset", "algorithm"]).collect():
        assert r["m"] == pytest.approx(r["best_score"], rel=1e-9)
