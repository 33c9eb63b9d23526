"""The four stages as one driver function: features, search, recommendation, final models."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators import columns, folds, metrics, models, profiles
from foldloom.operators.packed import Packed, pack
from foldloom.plans import grid, grouped, recommend, search
from foldloom.sources import logs
from foldloom.sources.folds import metadata

# Published reference scores (test R2).
REFERENCE_SCORES = [
    ("bike_sharing_demand", 0.9457),
    ("brazilian_houses", 0.9896),
    ("superconductivity", 0.9311),
    ("wine_quality", 0.4410),
    ("yprop_4_1", 0.0778),
]


@dataclass(frozen=True)
class Outcome:
    engineered: DataFrame | None
    log: DataFrame | None
    recommended: DataFrame | None
    predictions: DataFrame | None
    fold_metrics: DataFrame | None
    summary: DataFrame | None
    gaps: DataFrame | None
    status: DataFrame


def final_predictions(
    frame: DataFrame, names: Sequence[str], target: str, algorithm: str, params: dict[str, str], row_id: str = "row_id"
) -> DataFrame:
    """Constrained configuration, fitted once per fold on the other folds; unlabelled rows are predicted too."""
    legal = recommend.constrain(algorithm, params)
    packed = None
    if algorithm not in ("ridge", "lasso", "linear_regression", "knn"):
        packed = models.spread_out(models.assemble(frame, names, target, [row_id, "fold"]))
    return search.evaluate_trial(packed, frame, names, target, algorithm, legal, "fold", row_id)


def engineer(
    datasets: Mapping[str, tuple[DataFrame, str]], row_id: str = "row_id", k: int = 10, cap: int = grouped.FEATURE_CAP
) -> tuple[Packed, grouped.States]:
    """Folded rows of all datasets, and the cleaning and selection state of every (dataset, held-out fold)."""
    folded = {name: (folds.shuffled_kfold(raw, row_id, k), target) for name, (raw, target) in datasets.items()}
    packed = pack(folded, row_id)
    states = grouped.fit_clean(packed)
    grouped.select(packed, states, cap)
    return packed, states


def run_pipeline(
    datasets: dict[str, tuple[DataFrame, str]],
    algorithms: Sequence[str] = ("ridge", "decision_tree"),
    trials: int = 2,
    k: int = 10,
    clock: Callable[[], float] = time.time,
) -> Outcome:
    """Run all stages; a failing stage is recorded and the next one still starts.

    Every feature, weight and tree that scores or predicts a fold comes from the other folds.

    ``datasets``: name -> (frame with ``row_id``, target column).
    """
    spark = next(iter(datasets.values()))[0].sparkSession
    steps: list[tuple[str, str, float]] = []
    made: dict = {}

    def stage(name: str, work: Callable[[], object]):
        start = clock()
        try:
            result = work()
            steps.append((name, "SUCCESS", clock() - start))
            return result
        except Exception as error:  # recorded, not hidden: the status row carries the message
            steps.append((name, f"FAILED: {error}", clock() - start))
            return None

    def features_stage():
        packed, states = engineer(datasets, k=k)
        made.update(packed=packed, states=states)
        return grouped.engineered(packed, states)

    def search_stage():
        made["trials"] = grid.trials_of(search.trial_grid(spark, algorithms, trials))
        made["fitted"] = grid.fit(made["packed"], made["states"], made["trials"])
        return grid.best_trials(grid.scores(made["packed"], made["fitted"]))

    def recommend_stage():
        widths = {d: len(state.selected) for (d, _), state in made["states"].items()}
        metas = profiles.profiles(*profiles.profile_rows(datasets, widths, ("row_id",)))
        ids = metas.withColumn("dataset_id", F.xxhash64("dataset")).persist()
        targets = logs.as_entries(log)
        best = recommend.leaderboard.best_per_dataset(targets).withColumn("dataset_id", F.xxhash64("dataset"))
        near = recommend.nearest_datasets(ids, ids, recommend.META_FEATURES, k=1)
        voted = recommend.vote(near, best).join(ids.select("dataset_id", "dataset"), "dataset_id")
        return voted

    def final_stage():
        # a constrained configuration per dataset: all of them are fitted together, each predicts its own dataset
        rows = recommended.collect()
        configs = [
            grid.Trial(i, r["algorithm"], recommend.constrain(r["algorithm"], dict(r["hyperparams"]))) for i, r in enumerate(rows)
        ]
        fitted = grid.fit(made["packed"], made["states"], configs)
        return grid.predictions(made["packed"], fitted, {r["dataset"]: [i] for i, r in enumerate(rows)})

    engineered = stage("feature_engineering", features_stage)
    log = stage("search", search_stage)
    recommended = stage("recommendation", recommend_stage)
    predictions = stage("final_training", final_stage)
    fold_metrics = summary = gaps = None
    if predictions is not None:
        fold_metrics = metrics.regression_metrics(predictions, ["dataset", "fold"])
        summary = metrics.cross_fold_summary(fold_metrics)
        reference = spark.createDataFrame(REFERENCE_SCORES, "dataset string, reference double")
        gaps = metrics.reference_gap(summary.select("dataset", F.col("avg_r2").alias("r2")), reference)
    return Outcome(
        engineered, log, recommended, predictions, fold_metrics, summary, gaps, logs.run_status(spark, steps)
    )


def describe(df: DataFrame, name: str, target: str, folds_: int = 10) -> DataFrame:
    """Dataset metadata row for a raw frame."""
    kinds = columns.column_kinds(df, [target, "row_id"])
    names = [c for c in df.columns if c in {*kinds.numeric, *kinds.categorical, *kinds.other}]
    return metadata(df, name, names, target, folds_)
