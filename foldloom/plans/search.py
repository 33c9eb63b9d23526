"""Hyper-parameter search: candidates as rows, one distributed fit per (trial, fold).

Linear trials cost no fit at all: their folds are solved from per-fold second
moments.  The driver only holds the trial list and metric rows; the engineered
frame is persisted once and read by every fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.operators import folds, hyperparams, knn, linear, metrics, models

PARALLEL_FITS = 4
# Score of a dataset on which a configuration fails.
FAILED = {"regression": -1.0, "classification": 0.0}
RESULT = (
    "trial long, algorithm string, params map<string,string>, fold int, n long, mse double, "
    "mae double, r2 double, rmse double"
)


def trial_grid(
    spark: SparkSession, algorithms: Sequence[str], trials: int, spaces=hyperparams.SEARCH_SPACES, seed: int = 42
) -> DataFrame:
    """``(trial, algorithm, params)`` for ``trials`` seeded candidates per algorithm."""
    names = spark.createDataFrame([(a, i) for i, a in enumerate(algorithms)], "algorithm string, __at int")
    grid = spark.range(trials).select(F.col("id").alias("__n"), F.explode(F.array(*[F.lit(i) for i in range(len(algorithms))])).alias("__at"))
    ids = grid.join(names, "__at").select(
        (F.col("__at") * F.lit(trials) + F.col("__n") + F.lit(seed)).cast("long").alias("trial"), "algorithm"
    )
    drawn = hyperparams.candidates(ids, hyperparams.space_table(spark, spaces))
    return hyperparams.as_params(drawn, ["trial", "algorithm"])


def evaluate_trial(
    packed: DataFrame,
    frame: DataFrame,
    features: Sequence[str],
    target: str,
    algorithm: str,
    params: dict[str, str],
    fold: str = "fold",
    row_id: str = "row_id",
    task: str = "regression",
    moments: linear.Moments | None = None,
) -> DataFrame:
    """Out-of-fold predictions of one configuration."""
    if task == "regression" and algorithm in ("ridge", "lasso", "linear_regression"):
        sums = moments or linear.fold_moments(frame, features, target, fold)
        alpha = float(params.get("alpha", 0.0))
        intercept = params.get("fit_intercept", "true") == "true"
        weights = {
            f: linear.solve_lasso(sums, alpha, f) if algorithm == "lasso" else linear.solve_ridge(sums, alpha, f, intercept)
            for f in sums.parts
        }
        scored = linear.predict_by_fold(frame, features, fold, weights)
        return scored.select(row_id, fold, F.col(target).cast("double").alias("y_true"), "y_pred")
    if algorithm == "knn":
        rows = frame.select(row_id, fold, F.col(target).cast("double").alias("y_true"), knn.feature_vector(features).alias("vector"))
        known = rows.filter(F.col("y_true").isNotNull())
        near = knn.knn_join(
            rows, known, int(params.get("n_neighbors", 5)), row_id, "vector", "y_true", fold,
            p=float(params.get("p", 2)),
        )
        predict = knn.knn_regress if task == "regression" else knn.knn_classify
        out = predict(near, params.get("weights", "uniform")).withColumnRenamed("query_id", row_id)
        return rows.drop("vector").join(out, row_id)
    return models.fit_predict_by_fold(packed, algorithm, params, fold, task, [row_id])


def run_trials(
    frame: DataFrame,
    features: Sequence[str],
    target: str,
    grid: DataFrame,
    fold: str = "fold",
    row_id: str = "row_id",
    task: str = "regression",
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Fold metrics of every trial: ``(trial, algorithm, params, fold, n, mse, mae, r2, rmse)``.

    ``grid`` is a trial list, not data.  Trials run ``parallel`` at a time so that
    small tail stages of one fit overlap with another.  Rows without a target are
    left out; their dataset is scored by cross-validation on what is labelled.
    """
    spark = frame.sparkSession
    labelled = frame.filter(F.col(target).isNotNull()).persist()
    moments = None
    trials = grid.collect()
    closed = ("ridge", "lasso", "linear_regression", "knn")
    packed = None
    if any(task == "classification" or t["algorithm"] not in closed for t in trials):
        packed = models.spread_out(models.assemble(labelled, features, target, [row_id, fold]))
    if task == "regression" and any(t["algorithm"] in ("ridge", "lasso", "linear_regression") for t in trials):
        moments = linear.fold_moments(labelled, features, target, fold)

    def one(trial):
        predictions = evaluate_trial(
            packed, labelled, features, target, trial["algorithm"], trial["params"], fold, row_id, task, moments
        )
        if task == "classification":
            rows = metrics.accuracy(predictions, [fold]).collect()
            return [
                (trial["trial"], trial["algorithm"], trial["params"], r[fold], r["n"], None, None, r["accuracy"], None)
                for r in rows
            ]
        rows = metrics.regression_metrics(predictions, [fold]).collect()
        return [
            (trial["trial"], trial["algorithm"], trial["params"], r[fold], r["n"], r["mse"], r["mae"], r["r2"], r["rmse"])
            for r in rows
        ]

    try:
        with ThreadPoolExecutor(parallel) as pool:
            found = [row for rows in pool.map(one, trials) for row in rows]
    finally:
        if packed is not None:
            packed.unpersist()
        labelled.unpersist()
    return spark.createDataFrame(found, RESULT)


def best_trials(fold_rows: DataFrame, dataset: str) -> DataFrame:
    """Best trial per algorithm in the log form, with its per-fold details."""
    per_trial = fold_rows.groupBy("trial", "algorithm").agg(
        F.first("params").alias("params"),
        F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.coalesce(F.avg("r2"), F.lit(0.0)).alias("r2"),
        # one entry per fold of the trial
        F.sort_array(F.collect_list(F.struct("fold", "mse", "mae", "r2"))).alias("folds"),
    )
    best = F.max_by(
        F.struct("params", "mse", "mae", "r2", "folds"), F.struct(F.col("r2"), -F.col("trial"))
    )
    detail = F.transform(
        "b.folds", lambda f: F.struct(f["mse"].alias("mse"), f["mae"].alias("mae"), f["r2"].alias("r2"), f["r2"].alias("composite_score"))
    )
    return per_trial.groupBy("algorithm").agg(best.alias("b"), F.count(F.lit(1)).cast("int").alias("n_trials")).select(
        F.lit(dataset).alias("dataset"), "algorithm", F.col("b.params").alias("best_params"),
        F.col("b.r2").alias("best_score"),
        F.struct(
            F.col("b.r2").alias("composite_score"), F.col("b.mse").alias("mse"), F.col("b.mae").alias("mae"),
            F.col("b.r2").alias("r2"), detail.alias("fold_details"),
        ).alias("best_metrics"),
        "n_trials",
    )


def search_dataset(
    frame: DataFrame,
    dataset: str,
    features: Sequence[str],
    target: str,
    algorithms: Sequence[str],
    trials: int,
    fold: str = "fold",
    row_id: str = "row_id",
) -> DataFrame:
    """Best configuration per algorithm for one dataset."""
    grid = trial_grid(frame.sparkSession, algorithms, trials)
    return best_trials(run_trials(frame, features, target, grid, fold, row_id), dataset)


def search_unlabelled(
    train: DataFrame, dataset: str, features: Sequence[str], target: str, algorithms: Sequence[str],
    trials: int, row_id: str = "row_id",
) -> DataFrame:
    """No test labels: score by contiguous 3-fold cross-validation on the training rows."""
    folded = folds.contiguous_kfold(train.filter(F.col(target).isNotNull()), row_id, 3)
    return search_dataset(folded, dataset, features, target, algorithms, trials, "fold", row_id)


def search_all(
    datasets: dict[str, tuple[DataFrame, Sequence[str], str]], algorithms: Sequence[str], trials: int, save=None
) -> DataFrame:
    """Every dataset and algorithm, datasets in name order; ``save`` is called per dataset."""
    out = None
    for name in sorted(datasets):
        frame, features, target = datasets[name]
        part = search_dataset(frame, name, features, target, algorithms, trials)
        if save is not None:
            save(part)
        out = part if out is None else out.unionByName(part)
    return out


def cross_dataset_scores(
    datasets: dict[str, tuple[DataFrame, Sequence[str], str]],
    grid: DataFrame,
    fold: str = "fold",
    row_id: str = "row_id",
    task: str = "regression",
) -> DataFrame:
    """Mean fold score of every shared configuration on every dataset; NULL where it failed."""
    spark = next(iter(datasets.values()))[0].sparkSession
    configs = grid.select("trial", "algorithm", "params").collect()
    out = []
    for name, (frame, features, target) in sorted(datasets.items()):
        rows = run_trials(frame, features, target, grid, fold, row_id, task)
        means = {r["trial"]: r["s"] for r in rows.groupBy("trial").agg(F.avg("r2").alias("s")).collect()}
        out += [(c["trial"], c["algorithm"], c["params"], name, means.get(c["trial"])) for c in configs]
    return spark.createDataFrame(
        out, "trial long, algorithm string, params map<string,string>, dataset string, score double"
    )


def best_shared(scores: DataFrame, task: str = "regression") -> DataFrame:
    """One configuration for all datasets: mean score minus a spread penalty."""
    robust = metrics.robust_score(scores, ["trial", "algorithm"], failed=FAILED[task])
    params = scores.groupBy("trial").agg(F.first("params").alias("params"))
    return (
        robust.join(params, "trial")
        .agg(
            F.max_by(
                F.struct("trial", "algorithm", "params", "robust_score", "datasets"),
                F.struct(F.col("robust_score"), -F.col("trial")),
            ).alias("b")
        )
        .select("b.*")
    )


def fit_shared(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, config, task: str = "regression", row_id: str = "row_id"
) -> DataFrame:
    """Fit the shared configuration on the training split of a new dataset and score its test split."""
    both = train.withColumn("fold", F.lit(0)).unionByName(test.withColumn("fold", F.lit(1)))
    width = len(features)
    if not width:
        raise ValueError("no features")
    algorithm, params = config["algorithm"], dict(config["params"])
    if algorithm == "knn" or (task == "regression" and algorithm in ("ridge", "lasso", "linear_regression")):
        out = evaluate_trial(None, both, features, target, algorithm, params, "fold", row_id, task)
        return out.filter(F.col("fold") == 1)
    rows = train.count()
    made = models.make_estimator(algorithm, params, task, rows)
    model = made.estimator.fit(models.assemble(train, features, target, [row_id]))
    packed = models.assemble(test, features, target, [row_id])
    return model.transform(packed).select(row_id, F.col(models.LABEL).alias("y_true"), models.PREDICTION)
