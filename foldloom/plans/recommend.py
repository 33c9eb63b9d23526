"""Recommend algorithm and hyper-parameters for a dataset from its meta-features.

Default: vote of the nearest known datasets in z-scored meta-feature space.
Optional: learned heads, a classifier for the algorithm and one linear model per
hyper-parameter over the datasets that have it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators import encode, hyperparams, knn, leaderboard, linear, scale
from foldloom.sources.model_store import INDEX, KEYS, ModelStore

# The meta-features of a dataset, in order.
META_FEATURES = (
    "n_samples", "n_features", "n_categorical", "n_numerical", "missing_ratio", "feature_entropy",
    "target_variance", "correlation_mean", "correlation_std", "skewness_mean", "kurtosis_mean",
    "fe_impact_score",
)


def training_rows(meta: DataFrame, log: DataFrame, folds: int = 10) -> DataFrame:
    """Meta-features joined with each dataset's best algorithm, one row per fold."""
    best = leaderboard.best_per_dataset(log)
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in meta.columns if c != "dataset"]
    joined = meta.select("dataset", *numbers).join(
        best.select("dataset", F.col("algorithm").alias("best_algorithm"), "params"), "dataset"
    )
    copies = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    return joined.select("*", copies).withColumn(
        "dataset_fold", F.concat_ws("_fold_", F.col("dataset"), F.col("fold"))
    )


def nearest_datasets(
    known: DataFrame, new: DataFrame, features: Sequence[str], k: int = 3, row_id: str = "dataset_id", same: bool = False
) -> DataFrame:
    """The k known datasets closest to each new one; scaling is fitted on the known ones."""
    columns = list(features)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    a, b = known.select(row_id, *filled), new.select(row_id, *filled)
    stats = scale.fit_standard(a, columns)

    def vectors(df: DataFrame) -> DataFrame:
        scaled = scale.standard_scale(df, stats, columns)
        return scaled.select(row_id, knn.feature_vector(columns).alias("vector"))

    return knn.knn_join(vectors(b), vectors(a), k, row_id, "vector", skip_self=same)


def vote(neighbours: DataFrame, targets: DataFrame, row_id: str = "dataset_id") -> DataFrame:
    """Distance-weighted vote; confidence is the winner's share, params those of its nearest voter."""
    weight = F.lit(1.0) / (F.col("distance") + F.lit(1e-9))
    joined = neighbours.join(
        targets.select(F.col(row_id).alias("neighbour_id"), "algorithm", "params"), "neighbour_id"
    )
    votes = joined.groupBy("query_id", "algorithm").agg(
        F.sum(weight).alias("w"),
        F.min_by("params", F.struct("distance", "neighbour_id")).alias("hyperparams"),
    )
    total = F.sum("w").over(Window.partitionBy("query_id"))
    shares = votes.withColumn("confidence", F.col("w") / total)
    best = F.max_by(F.struct("algorithm", "hyperparams", "confidence"), F.struct("w", "algorithm"))
    return shares.groupBy("query_id").agg(best.alias("b")).select(
        F.col("query_id").alias(row_id), "b.*"
    )


@dataclass(frozen=True)
class Heads:
    """Learned recommendation: scaler state, label table, classifier, linear heads per parameter."""

    features: tuple[str, ...]
    scaler: DataFrame
    labels: list[str]
    classifier: object
    hp_scalers: DataFrame
    hp_weights: dict[str, list[float]]


def _packed(df: DataFrame, features: Sequence[str], scaler: DataFrame) -> DataFrame:
    scaled = scale.standard_scale(df, scaler, list(features))
    return VectorAssembler(inputCols=list(features), outputCol="__x").transform(scaled)


def fit_heads(
    rows: DataFrame, features: Sequence[str], algorithm: str = "algorithm", params: str = "params",
    row_id: str = "dataset_id", hidden: int = 8, seed: int = 42,
) -> Heads:
    """``rows``: one dataset per row with its best algorithm and ``params map<string,string>``."""
    names = list(features)
    data = rows.select(
        row_id, algorithm, params,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
    ).persist()
    scaler = scale.fit_standard(data, names)
    codes = encode.fit_categories(data, [algorithm])
    labels = [r["key"] for r in codes.of(algorithm).table.orderBy("code").collect()]
    coded = encode.encode(data, codes, algorithm, label="__label")
    packed = _packed(coded, names, scaler)
    network = MultilayerPerceptronClassifier(
        layers=[len(names), hidden, max(2, len(labels))], featuresCol="__x", labelCol="__label",
        predictionCol="__code", probabilityCol="__p", rawPredictionCol="__raw", maxIter=50, seed=seed,
    ).fit(packed)
    long = hyperparams.categorical_codes(
        hyperparams.explode_params(data.select(row_id, params), params)
    )
    scalers = hyperparams.fit_hp_scalers(long, "number")
    scaled_hp = hyperparams.scale_hp(long.withColumn("v", F.col("number")), scalers, "v")
    scaled_rows = scale.standard_scale(data.select(row_id, *names), scaler, names)
    joined = scaled_rows.join(scaled_hp.select(row_id, "hp", "scaled"), row_id)
    moments = linear.fold_moments(joined, names, "scaled", "hp")
    weights = {}
    for hp, part in moments.parts.items():
        own = linear.Moments(moments.features, moments.center, {hp: part})
        weights[hp] = [float(w) for w in linear.solve_ridge(own, alpha=1.0)]
    data.unpersist()
    return Heads(tuple(names), scaler, labels, network, scalers, weights)


def predict_heads(heads: Heads, rows: DataFrame, row_id: str = "dataset_id") -> DataFrame:
    """``(row_id, algorithm, confidence, hyperparams)`` with legal, relevant parameters."""
    names = list(heads.features)
    data = rows.select(row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    labels = F.array(*[F.lit(a) for a in heads.labels])
    scored = heads.classifier.transform(_packed(data, names, heads.scaler)).select(
        row_id, *names,
        F.try_element_at(labels, (F.col("__code") + 1).cast("int")).alias("algorithm"),
        F.array_max(vector_to_array("__p")).alias("confidence"),
    )
    heads_array = F.array(
        *[
            F.struct(F.lit(hp).alias("hp"), linear.linear_prediction(names, w).alias("scaled"))
            for hp, w in sorted(heads.hp_weights.items())
        ]
    )
    long = scale.standard_scale(scored, heads.scaler, names).select(
        row_id, "algorithm", "confidence", F.inline(heads_array)
    )
    values = hyperparams.unscale_hp(long, heads.hp_scalers)
    text = F.coalesce(
        hyperparams.decode(F.col("algorithm"), F.col("hp"), F.col("value")), F.col("value").cast("string")
    )
    legal = hyperparams.clamp(
        values.select(row_id, "algorithm", "hp", "value"), hyperparams.bounds_table(rows.sparkSession)
    ).select(row_id, "hp", F.col("value").cast("string").alias("text"))
    named = values.filter(
        hyperparams.decode(F.col("algorithm"), F.col("hp"), F.col("value")).isNotNull()
    ).select(row_id, "hp", text.alias("text"))
    collected = legal.unionByName(named).groupBy(row_id).agg(
        # one entry per legal parameter
        F.map_from_entries(F.collect_list(F.struct("hp", "text"))).alias("hyperparams")
    )
    empty = F.create_map().cast("map<string,string>")
    return scored.select(row_id, "algorithm", "confidence").join(collected, row_id, "left").withColumn(
        "hyperparams", F.coalesce("hyperparams", empty)
    )


def save_heads(store: ModelStore, name: str, heads: Heads) -> int:
    """Keep fitted heads in ``store``: scalers and weights as tables, the network by its writer; one commit shows all."""
    spark = store.spark
    folder = store.new_folder()
    heads.classifier.write().save(f"{store.root}/{folder}/network")
    weights = spark.createDataFrame(list(heads.hp_weights.items()), "hp string, weights array<double>")
    about = [(folder, list(heads.features), list(heads.labels))]
    about = spark.createDataFrame(about, "path string, features array<string>, labels array<string>")
    tables = {"scaler": heads.scaler, "hp_scalers": heads.hp_scalers, "hp_weights": weights, "about": about}
    entry = spark.createDataFrame(
        [("", None, f"heads/{name}", type(heads.classifier).__name__, f"{folder}/network", "{}")], INDEX
    )
    return store.merge("index", entry, KEYS, {f"heads/{name}/{t}": df for t, df in tables.items()})


def load_heads(store: ModelStore, name: str) -> Heads:
    version = store.version()
    tables = {t: store.read(f"heads/{name}/{t}", version) for t in ("scaler", "hp_scalers", "hp_weights", "about")}
    if tables["about"] is None:
        raise KeyError(name)
    about = tables["about"].first()
    network = DefaultParamsReader.loadParamsInstance(f"{store.root}/{about['path']}/network", store.spark)
    weights = {r["hp"]: list(r["weights"]) for r in tables["hp_weights"].collect()}
    return Heads(
        tuple(about["features"]), tables["scaler"], list(about["labels"]), network, tables["hp_scalers"], weights
    )


def constrain(algorithm: str, params: dict[str, str]) -> dict[str, str]:
    """Legal ranges for one configuration that is about to be fitted."""
    ranges = {h: (lo, hi, whole) for a, h, lo, hi, whole in hyperparams.LEGAL_RANGES if a == algorithm}
    out = dict(params)
    for hp, text in params.items():
        if hp in ranges:
            lo, hi, whole = ranges[hp]
            value = abs(float(text))
            value = max(lo, value if hi is None else min(hi, value))
            out[hp] = str(int(value)) if whole else str(value)
    if algorithm == "knn":
        out.setdefault("n_neighbors", "5")
        if out.get("weights", "uniform") not in ("uniform", "distance"):
            out["weights"] = "uniform"
    return out
