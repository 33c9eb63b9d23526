"""Tree, ensemble and linear classifiers as Spark ML estimators behind one factory.

``make_estimator(algorithm, params)`` maps the search-space parameters to Spark ML
and reports the ones that have no Spark counterpart instead of guessing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
FEATURES = "features"
LABEL = "target"
PREDICTION = "y_pred"

REGRESSORS = {
    "decision_tree": DecisionTreeRegressor,
    "random_forest": RandomForestRegressor,
    "gradient_boosting": GBTRegressor,
    "xgboost": GBTRegressor,
    "lightgbm": GBTRegressor,
    "linear_regression": LinearRegression,
    "ridge": LinearRegression,
    "lasso": LinearRegression,
}
CLASSIFIERS = {
    "decision_tree": DecisionTreeClassifier,
    "random_forest": RandomForestClassifier,
    "gradient_boosting": GBTClassifier,
    "logistic_regression": LogisticRegression,
    "svm": LinearSVC,
}

# Search parameter -> Spark ML parameter, per estimator family.
_TREE = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode"}
_FOREST = {**_TREE, "n_estimators": "numTrees", "max_features": "featureSubsetStrategy", "subsample": "subsamplingRate"}
_BOOST = {**_TREE, "n_estimators": "maxIter", "learning_rate": "stepSize", "subsample": "subsamplingRate",
          "min_child_weight": "minInstancesPerNode"}
_LINEAR = {"fit_intercept": "fitIntercept", "max_iter": "maxIter"}
PARAM_NAMES = {
    "decision_tree": _TREE,
    "random_forest": _FOREST,
    "gradient_boosting": _BOOST,
    "xgboost": _BOOST,
    "lightgbm": _BOOST,
    "linear_regression": _LINEAR,
    "ridge": _LINEAR,
    "lasso": _LINEAR,
    "logistic_regression": _LINEAR,
    "svm": _LINEAR,
}
WHOLE = {"maxDepth", "minInstancesPerNode", "numTrees", "maxIter"}
MAX_TREE_DEPTH = 30
ROWS_PER_TASK = 5_000
SVM_TOLERANCE = 1e-3


@dataclass(frozen=True)
class Made:
    estimator: Estimator
    ignored: tuple[str, ...]


def make_estimator(
    algorithm: str, params: Mapping[str, object] | None = None, task: str = "regression", rows: int | None = None
) -> Made:
    """Spark ML estimator with the accepted parameters set.

    ``rows`` is needed for ridge: a penalty on the summed squares becomes one on
    their mean.  Linear-kernel is the only SVM.
    """
    registry = REGRESSORS if task == "regression" else CLASSIFIERS
    if algorithm not in registry:
        raise ValueError(f"unknown {task} algorithm {algorithm!r}; known: {sorted(registry)}")
    settings: dict[str, object] = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    ignored = []
    for name, value in (params or {}).items():
        spark_name = PARAM_NAMES[algorithm].get(name)
        if spark_name is not None:
            settings[spark_name] = _convert(spark_name, value)
        elif name == "alpha" and algorithm == "ridge" and rows:
            settings.update(regParam=float(value) / rows, elasticNetParam=0.0, standardization=False)
        elif name == "alpha" and algorithm == "lasso":
            settings.update(regParam=float(value), elasticNetParam=1.0, standardization=False)
        elif name == "C" and rows:
            # the penalty on the summed loss becomes one on its mean
            settings.update(regParam=1.0 / (float(value) * rows))
        else:
            ignored.append(name)
    cls = registry[algorithm]
    if cls not in (LinearRegression, LogisticRegression, LinearSVC):
        settings["seed"] = SEED
        if "maxDepth" in settings:
            settings["maxDepth"] = min(settings["maxDepth"], MAX_TREE_DEPTH)
    if cls is LinearSVC:
        settings["tol"] = SVM_TOLERANCE
    estimator = cls(**settings)
    return Made(estimator, tuple(ignored))


def _convert(name: str, value: object) -> object:
    if name in WHOLE:
        return int(float(value))
    if name == "featureSubsetStrategy":
        return "all" if value in (None, "all") else str(value)
    if name == "fitIntercept":
        return str(value).lower() == "true"
    return float(value)


def assemble(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, the feature vector and the label: nothing else leaves the scan."""
    numeric = df.select(
        *keep, F.col(target).cast("double").alias(LABEL), *[F.col(c).cast("double").alias(f"__{c}") for c in features]
    )
    packed = VectorAssembler(
        inputCols=[f"__{c}" for c in features], outputCol=FEATURES, handleInvalid="error"
    ).transform(numeric)
    return packed.select(*keep, LABEL, FEATURES)


def spread_out(packed: DataFrame) -> DataFrame:
    """Persist the training frame, in one partition per core when it has the rows for it.

    Iterative fits read it many times.  A frame that already fills the cluster is
    left as it is; only one that sits in too few partitions is shuffled once.
    """
    cores = packed.sparkSession.sparkContext.defaultParallelism
    held = packed.persist()
    # one count per partition
    sizes = held.groupBy(F.spark_partition_id().alias("part")).count()
    used, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    wanted = min(cores, max(1, rows // ROWS_PER_TASK))
    if used >= wanted:
        return held
    spread = held.repartition(wanted).persist()
    spread.count()
    held.unpersist()
    return spread


def multiclass_svm(params: Mapping[str, object] | None = None, rows: int | None = None) -> OneVsRest:
    made = make_estimator("svm", params, "classification", rows)
    return OneVsRest(classifier=made.estimator, featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION)


def fit_by_fold(
    packed: DataFrame,
    algorithm: str,
    params: Mapping[str, object] | None = None,
    fold: str = "fold",
    task: str = "regression",
) -> dict:
    """For each fold the model fitted on all labelled rows of the others: one distributed fit per fold.

    ``packed`` is read by every fit: see :func:`spread_out`.
    """
    rows = packed.groupBy(fold).agg(F.count(LABEL).alias("n")).collect()
    counts = {r[fold]: r["n"] for r in rows}
    total = sum(counts.values())
    out = {}
    for f in sorted(counts):
        made = make_estimator(algorithm, params, task, total - counts[f])
        out[f] = made.estimator.fit(packed.filter((F.col(fold) != F.lit(f)) & F.col(LABEL).isNotNull()))
    return out


def predict_with(
    fitted: Mapping, packed: DataFrame, fold: str = "fold", keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Out-of-fold predictions ``(keep, fold, y_true, y_pred)`` of one model per fold; unlabelled rows too."""
    out = None
    for f in sorted(fitted):
        part = fitted[f].transform(packed.filter(F.col(fold) == F.lit(f))).select(
            *keep, fold, F.col(LABEL).alias("y_true"), F.col(PREDICTION).alias("y_pred")
        )
        out = part if out is None else out.unionByName(part)
    return out


def fit_predict_by_fold(
    packed: DataFrame,
    algorithm: str,
    params: Mapping[str, object] | None = None,
    fold: str = "fold",
    task: str = "regression",
    keep: Sequence[str] = ("row_id",),
) -> DataFrame:
    return predict_with(fit_by_fold(packed, algorithm, params, fold, task), packed, fold, keep)
