"""Hyper-parameters as data: spaces, candidates, long/wide forms, legal ranges, decoding.

The natural form is long, ``(..., algorithm, hp, value)``; a missing parameter is
a missing row (or NULL after widening), which is also the training mask.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.numeric import or_one, unit
from foldloom.operators.encode import order_codes, threshold_label
from foldloom.operators.state import lookup, settle

# The searched ranges per algorithm.
# (parameter, kind, low, high) or (parameter, "choice", [values])
SEARCH_SPACES: dict[str, list[tuple]] = {
    "random_forest": [
        ("n_estimators", "int", 50, 500),
        ("max_depth", "int", 3, 20),
        ("min_samples_split", "int", 2, 20),
        ("min_samples_leaf", "int", 1, 10),
        ("max_features", "choice", ["sqrt", "log2"]),
    ],
    "gradient_boosting": [
        ("n_estimators", "int", 50, 300),
        ("learning_rate", "float", 0.01, 0.3),
        ("max_depth", "int", 3, 10),
        ("min_samples_split", "int", 2, 20),
        ("min_samples_leaf", "int", 1, 10),
        ("subsample", "float", 0.6, 1.0),
    ],
    "xgboost": [
        ("n_estimators", "int", 50, 500),
        ("max_depth", "int", 3, 15),
        ("learning_rate", "float", 0.01, 0.3),
        ("subsample", "float", 0.6, 1.0),
        ("colsample_bytree", "float", 0.6, 1.0),
        ("min_child_weight", "int", 1, 10),
        ("reg_alpha", "float", 0.0, 10.0),
        ("reg_lambda", "float", 0.0, 10.0),
    ],
    "lightgbm": [
        ("n_estimators", "int", 50, 500),
        ("max_depth", "int", 3, 15),
        ("learning_rate", "float", 0.01, 0.3),
        ("subsample", "float", 0.6, 1.0),
        ("colsample_bytree", "float", 0.6, 1.0),
        ("min_child_weight", "float", 0.1, 10.0),
        ("reg_alpha", "float", 0.0, 10.0),
        ("reg_lambda", "float", 0.0, 10.0),
        ("num_leaves", "int", 10, 300),
        ("min_data_in_leaf", "int", 5, 100),
    ],
    "ridge": [("alpha", "log", 0.01, 100.0)],
    "lasso": [("alpha", "log", 0.01, 100.0)],
    "decision_tree": [
        ("max_depth", "int", 3, 20),
        ("min_samples_split", "int", 2, 20),
        ("min_samples_leaf", "int", 1, 10),
        ("max_features", "choice", ["sqrt", "log2", "all"]),
        ("criterion", "choice", ["squared_error", "friedman_mse", "absolute_error"]),
    ],
    "knn": [
        ("n_neighbors", "int", 3, 20),
        ("weights", "choice", ["uniform", "distance"]),
        ("algorithm", "choice", ["auto", "ball_tree", "kd_tree", "brute"]),
        ("p", "int", 1, 2),
    ],
}

# The ranges of the cross-dataset search.
SHARED_SPACES: dict[str, list[tuple]] = {
    "random_forest": [
        ("n_estimators", "int", 50, 200),
        ("max_depth", "int", 5, 20),
        ("min_samples_split", "int", 2, 20),
        ("min_samples_leaf", "int", 1, 10),
        ("max_features", "choice", ["sqrt", "log2"]),
    ],
    "logistic_regression": [
        ("C", "log", 0.001, 100.0),
        ("solver", "choice", ["liblinear", "lbfgs"]),
        ("max_iter", "int", 100, 1000),
    ],
    "linear_regression": [("fit_intercept", "choice", ["true", "false"])],
    "svm": [("C", "log", 0.001, 100.0), ("kernel", "choice", ["linear"])],
    "knn": [
        ("n_neighbors", "int", 3, 20),
        ("weights", "choice", ["uniform", "distance"]),
        ("algorithm", "choice", ["auto", "ball_tree", "kd_tree", "brute"]),
        ("p", "int", 1, 3),
    ],
    "decision_tree": [
        ("max_depth", "int", 3, 20),
        ("min_samples_split", "int", 2, 20),
        ("min_samples_leaf", "int", 1, 10),
        ("max_features", "choice", ["sqrt", "log2"]),
    ],
    "gradient_boosting": [
        ("n_estimators", "int", 50, 200),
        ("learning_rate", "float", 0.01, 0.3),
        ("max_depth", "int", 3, 10),
        ("min_samples_split", "int", 2, 20),
        ("min_samples_leaf", "int", 1, 10),
        ("subsample", "float", 0.6, 1.0),
    ],
}

# Legal ranges of predicted parameters, (algorithm, hp, low, high, whole number).
LEGAL_RANGES: list[tuple[str, str, float, float | None, bool]] = [
    ("xgboost", "n_estimators", 50, 500, True),
    ("xgboost", "max_depth", 3, 15, True),
    ("xgboost", "min_child_weight", 1, 10, True),
    ("xgboost", "learning_rate", 0.01, 0.3, False),
    ("xgboost", "subsample", 0.6, 1.0, False),
    ("xgboost", "colsample_bytree", 0.6, 1.0, False),
    ("xgboost", "reg_alpha", 0.0, 10.0, False),
    ("xgboost", "reg_lambda", 0.0, 10.0, False),
    ("random_forest", "n_estimators", 10, 500, True),
    ("random_forest", "max_depth", 3, 20, True),
    ("random_forest", "min_samples_split", 1, None, True),
    ("random_forest", "min_samples_leaf", 1, None, True),
    ("knn", "n_neighbors", 3, 20, True),
    ("knn", "p", 1, 2, True),
    ("mlp", "n_layers", 1, 4, True),
    ("mlp", "layer_0_size", 50, 512, True),
    ("mlp", "layer_1_size", 50, 512, True),
    ("mlp", "layer_2_size", 50, 512, True),
    ("mlp", "layer_3_size", 50, 512, True),
    ("mlp", "learning_rate", 0.0001, 0.01, False),
    ("mlp", "max_iter", 100, 500, True),
    ("mlp", "alpha", 0.0001, 0.01, False),
]

# Categorical parameters decoded by thresholds on the absolute value.
DECODED: dict[tuple[str, str], tuple[list[tuple[float, str]], str]] = {
    ("random_forest", "max_features"): ([(0.5, "log2")], "sqrt"),
    ("mlp", "activation"): ([(0.5, "relu")], "tanh"),
    ("mlp", "batch_size"): ([(0.25, "32"), (0.5, "64"), (0.75, "128")], "256"),
    ("knn", "weights"): ([(0.5, "uniform")], "distance"),
    ("knn", "algorithm"): ([(0.25, "auto"), (0.5, "ball_tree"), (0.75, "kd_tree")], "brute"),
}
# Two-way choices switch only above the threshold, so 0.5 itself stays low.
INCLUSIVE_AT_HALF = {("random_forest", "max_features"), ("mlp", "activation"), ("knn", "weights")}

SPACE_SCHEMA = (
    "algorithm string, position int, hp string, kind string, lo double, hi double, choices array<string>"
)


def space_table(spark: SparkSession, spaces: dict[str, list[tuple]] = SEARCH_SPACES) -> DataFrame:
    """The search space as one row per (algorithm, parameter)."""
    rows = []
    for algorithm, params in spaces.items():
        for position, (hp, kind, *rest) in enumerate(params):
            if kind == "choice":
                rows.append((algorithm, position, hp, kind, 0.0, 0.0, rest[0]))
            else:
                rows.append((algorithm, position, hp, kind, float(rest[0]), float(rest[1]), None))
    return spark.createDataFrame(rows, SPACE_SCHEMA)


def candidates(trials: DataFrame, space: DataFrame, trial: str = "trial") -> DataFrame:
    """Draw every parameter of every ``(trial, algorithm)`` row from its space.

    The draw is a pure function of (trial, parameter position): any task can
    repeat it, and the same seed column gives the same candidates.
    """
    u = unit(F.col(trial), F.col("position"))
    lo, hi = F.col("lo"), F.col("hi")
    # greatest keeps ln defined for spaces that start at 0; only "log" rows use it
    ln = F.ln(F.greatest(lo, F.lit(1e-12)))
    log = F.exp(ln + u * (F.ln(F.greatest(hi, F.lit(1e-12))) - ln))
    number = (
        F.when(F.col("kind") == "int", F.floor(lo + u * (hi - lo + 1)).cast("double"))
        .when(F.col("kind") == "log", log)
        .when(F.col("kind") == "float", lo + u * (hi - lo))
    )
    choice = F.try_element_at("choices", (F.floor(u * F.size("choices")) + 1).cast("int"))
    # the space has one row per parameter of the code above, a fixed size
    return trials.join(F.broadcast(space), "algorithm").select(
        *trials.columns, "position", "hp", "kind", number.alias("number"),
        F.when(F.col("kind") == "choice", choice).alias("choice"),
    )


def as_params(drawn: DataFrame, by: Sequence[str]) -> DataFrame:
    """Collapse drawn parameters to one ``params map<string,string>`` per trial."""
    text = F.when(F.col("kind") == "int", F.col("number").cast("long").cast("string")).otherwise(
        F.coalesce("choice", F.col("number").cast("string"))
    )
    entries = F.collect_list(F.struct("hp", text.alias("v")))
    return drawn.groupBy(*by).agg(F.map_from_entries(entries).alias("params"))


def explode_params(log: DataFrame, params: str = "params") -> DataFrame:
    """Ragged parameter maps to long form, one row per parameter present."""
    keep = [c for c in log.columns if c != params]
    return log.select(*keep, F.explode(params).alias("hp", "value"))


def widen(long: DataFrame, by: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Long to wide ``hp_<name>`` columns with a ``mask_<name>`` flag each.

    ``names`` fixes the columns; without it the (few) parameter names are read first.
    """
    if names is None:
        names = [r["hp"] for r in long.select("hp").distinct().orderBy("hp").collect()]
    cells = []
    for hp in names:
        cell = F.max(F.when(F.col("hp") == hp, F.col("value")))
        cells += [cell.alias(f"hp_{hp}"), cell.isNotNull().alias(f"mask_{hp}")]
    return long.groupBy(*by).agg(*cells)


def categorical_codes(long: DataFrame, value: str = "value") -> DataFrame:
    """Text parameter values as sorted dictionary codes per parameter; numbers stay numbers."""
    parsed = long.withColumn("number", F.expr(f"try_cast(`{value}` AS double)"))
    words = parsed.filter(F.col("number").isNull() & F.col(value).isNotNull()).groupBy("hp", value).agg(
        F.count(F.lit(1)).alias("n")
    )
    codes = settle(order_codes(words, "hp", value))
    joined = lookup(parsed, codes, ["hp", value])
    return joined.withColumn("number", F.coalesce("number", F.col("code").cast("double"))).drop("n", "code")


def fit_hp_scalers(long: DataFrame, value: str = "value") -> DataFrame:
    """Mean and population std per parameter over the rows that have it (more than one)."""
    return long.groupBy("hp").agg(
        F.avg(value).alias("hp_mean"), F.stddev_pop(value).alias("hp_std"), F.count(value).alias("hp_n")
    )


def scale_hp(long: DataFrame, scalers: DataFrame, value: str = "value") -> DataFrame:
    """z-score per parameter; unscaled with one value; missing becomes 0 after scaling."""
    z = (F.col(value) - F.col("hp_mean")) / or_one(F.col("hp_std"))
    scaled = F.when(F.col("hp_n") > 1, z).otherwise(F.col(value))
    # one row per parameter name
    return long.join(scalers, "hp", "left").select(
        *long.columns, F.coalesce(scaled, F.lit(0.0)).alias("scaled")
    )


def unscale_hp(long: DataFrame, scalers: DataFrame, scaled: str = "scaled") -> DataFrame:
    original = F.when(
        F.col("hp_n") > 1, F.col(scaled) * or_one(F.col("hp_std")) + F.col("hp_mean")
    ).otherwise(F.col(scaled))
    return long.join(scalers, "hp", "left").select(*long.columns, original.alias("value"))


def bounds_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, h, float(lo), None if hi is None else float(hi), w) for a, h, lo, hi, w in LEGAL_RANGES],
        "algorithm string, hp string, lo double, hi double, whole boolean",
    )


def clamp(long: DataFrame, bounds: DataFrame, value: str = "value") -> DataFrame:
    """Absolute value, whole where required, inside the legal range; only relevant rows stay."""
    size = F.abs(value)
    size = F.when(F.col("whole"), F.floor(size).cast("double")).otherwise(size)
    legal = F.greatest(F.col("lo"), F.coalesce(F.least(F.col("hi"), size), size))
    # one row per legal (algorithm, parameter) of the table above, a fixed size
    return long.join(F.broadcast(bounds), ["algorithm", "hp"]).select(
        *[c for c in long.columns if c != value], legal.alias(value)
    )


def decode(algorithm: Column, hp: Column, value: Column) -> Column:
    """Number to category for the categorical parameters; NULL for the numeric ones."""
    result = None
    for (a, h), (steps, last) in DECODED.items():
        label = threshold_label(value, steps, last)
        if (a, h) in INCLUSIVE_AT_HALF:
            label = F.when(F.abs(value) > steps[0][0], F.lit(last)).otherwise(F.lit(steps[0][1]))
        hit = (algorithm == a) & (hp == h)
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result


def accepted_params(params: Column, names: Sequence[str]) -> Column:
    """Keep the map entries a model accepts."""
    allowed = F.array(*[F.lit(n) for n in names])
    return F.map_filter(params, lambda k, _: F.array_contains(allowed, k))


def strip_prefix(hp: Column, prefix: str = "hp_") -> Column:
    return F.regexp_replace(hp, f"^{prefix}", "")


def repair_knn(params: Column) -> Column:
    """Unknown ``weights`` become uniform; missing ``n_neighbors`` becomes 5."""
    weights = F.try_element_at(params, F.lit("weights"))
    fixed = F.transform_values(
        params,
        lambda k, v: F.when(
            (k == "weights") & ~F.coalesce(weights.isin("uniform", "distance"), F.lit(False)), F.lit("uniform")
        ).otherwise(v),
    )
    default = F.create_map(F.lit("n_neighbors"), F.lit("5"))
    return F.when(F.map_contains_key(fixed, "n_neighbors"), fixed).otherwise(F.map_concat(fixed, default))


def known_params(spaces: dict[str, list[tuple]] = SEARCH_SPACES) -> list[str]:
    return sorted({p[0] for p in chain.from_iterable(spaces.values())})
