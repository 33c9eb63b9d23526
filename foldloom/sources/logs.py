"""Experiment logs, fold results, predictions, summaries and run status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.sources.snapshots import Snapshots

# The stored record formats.
LOG_SCHEMA = (
    "dataset string, algorithm string, best_params map<string,string>, best_score double, "
    "best_metrics struct<composite_score:double, mse:double, mae:double, r2:double, "
    "fold_details:array<struct<mse:double, mae:double, r2:double, composite_score:double>>>, "
    "n_trials int"
)
RESULT_SCHEMA = (
    "dataset string, fold int, algorithm string, hyperparams map<string,string>, "
    "metrics struct<mse:double, mae:double, r2_score:double, rmse:double>, "
    "model_path string, train_shape array<int>, test_shape array<int>, is_exam_dataset boolean"
)


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON arrays of search results; unreadable files give no rows.

    The schema is explicit: inference would merge the ragged parameters of all
    algorithms into one struct.
    """
    raw = (
        spark.read.schema(LOG_SCHEMA + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(paths)
    )
    return raw.filter(F.col("dataset").isNotNull()).drop("_corrupt_record")


def unlabelled_results(log: DataFrame) -> DataFrame:
    """Entries without any scored fold: their score means "every fold failed"."""
    return log.filter(F.coalesce(F.size("best_metrics.fold_details"), F.lit(0)) <= 0)


def scored(log: DataFrame) -> DataFrame:
    return log.filter(F.size("best_metrics.fold_details") > 0)


def as_entries(log: DataFrame) -> DataFrame:
    """Log rows in the leaderboard form, one row per result."""
    order = F.xxhash64("dataset", "algorithm")
    return log.select(
        "dataset", "algorithm", F.lit(1).alias("fold"), F.col("best_score").alias("score"),
        F.col("best_params").alias("params"), order.alias("seq"),
    )


def fold_entries(log: DataFrame) -> DataFrame:
    """One row per (dataset, algorithm, fold); an entry without folds counts as fold 1."""
    details = F.posexplode_outer("best_metrics.fold_details").alias("pos", "detail")
    flat = log.select("dataset", "algorithm", "best_score", F.col("best_params").alias("params"), "best_metrics", details)
    return flat.select(
        "dataset", "algorithm", (F.coalesce("pos", F.lit(0)) + 1).alias("fold"),
        F.coalesce("detail.composite_score", "detail.r2", "best_score").alias("score"),
        "params", F.xxhash64("dataset", "algorithm").alias("seq"),
    )


def write_logs(log: DataFrame, path: str, mode: str = "append") -> None:
    """One directory per dataset; appending saves each algorithm as soon as it is done."""
    log.write.mode(mode).partitionBy("dataset").json(path)


def merge_log(store: Snapshots, log: DataFrame) -> int:
    """Keep search results as a versioned table, one row per (dataset, algorithm).

    An interrupted search that is repeated replaces what it had already saved instead of adding it again.
    """
    return store.merge("log", log, ["dataset", "algorithm"])


def merge_trials(store: Snapshots, dataset: str, trials: DataFrame) -> int:
    """Fold metrics of trials, one row per (dataset, algorithm, trial, fold)."""
    return store.merge("trials", trials.withColumn("dataset", F.lit(dataset)), ["dataset", "algorithm", "trial", "fold"])


def read_predictions(spark: SparkSession, paths: str | list[str], labelled: bool = True) -> DataFrame:
    """Prediction CSVs with the dataset and fold taken from the file name."""
    schema = "y_true double, y_pred double" if labelled else "y_pred double"
    df = spark.read.schema(schema).option("header", True).csv(paths)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_fold_(\d+)_predictions", 1)
    fold = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_fold_(\d+)_predictions", 2)
    return df.select(name.alias("dataset"), fold.cast("int").alias("fold"), *df.columns)


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV per (dataset, fold); an all-NULL truth (unlabelled data) is left out by the caller's select."""
    predictions.write.mode(mode).option("header", True).partitionBy("dataset", "fold").csv(path)


def write_prediction_vector(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    predictions.select("row_id", "y_pred").write.mode(mode).parquet(path)


def fold_results(
    metrics: DataFrame, algorithm: str, hyperparams: dict[str, object], shapes: DataFrame, model_path: str | None = None
) -> DataFrame:
    """Metrics rows as fold-result records. ``shapes``: dataset, fold, train_shape, test_shape."""
    pairs = [F.lit(x) for kv in hyperparams.items() for x in (kv[0], str(kv[1]))]
    params = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    joined = shapes.join(metrics, ["dataset", "fold"], "left")
    return joined.select(
        "dataset", "fold", F.lit(algorithm).alias("algorithm"), params.alias("hyperparams"),
        F.when(
            F.col("mse").isNotNull(), F.struct("mse", "mae", F.col("r2").alias("r2_score"), "rmse")
        ).alias("metrics"),
        F.lit(model_path).cast("string").alias("model_path"), "train_shape", "test_shape",
        F.col("mse").isNull().alias("is_exam_dataset"),
    )


def summarise_results(results: DataFrame) -> DataFrame:
    """Per-dataset summary record: fold count, mean and population std of the metrics, all folds."""
    cells = [
        e
        for m in ("mse", "mae", "r2_score", "rmse")
        for e in (F.avg(f"metrics.{m}").alias(f"avg_{m}"), F.stddev_pop(f"metrics.{m}").alias(f"std_{m}"))
    ]
    per = (
        results.withColumn("hyperparams_json", F.to_json("hyperparams"))
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).cast("int").alias("total_folds"),
            *cells,
            # one entry per fold
            F.sort_array(
                F.collect_list(F.struct("fold", "algorithm", "hyperparams_json", "metrics"))
            ).alias("all_results"),
        )
    )
    names = [f"{s}_{m}" for m in ("mse", "mae", "r2_score", "rmse") for s in ("avg", "std")]
    return per.select("dataset", "total_folds", F.struct(*names).alias("average_metrics"), "all_results")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def ranking_text(log: DataFrame) -> DataFrame:
    """Ranked summary lines, ordered by dataset and rank: ``(dataset, rank, value)``."""
    order = Window.partitionBy("dataset").orderBy(F.desc("best_score"), "algorithm")
    ranked = log.withColumn("rank", F.row_number().over(order))
    line = F.format_string("%d. %s: %.4f", "rank", "algorithm", "best_score")
    detail = F.format_string(
        " (R2: %.4f, MSE: %.4f, MAE: %.4f)", "best_metrics.r2", "best_metrics.mse", "best_metrics.mae"
    )
    text = F.when(F.col("best_metrics.r2").isNotNull(), F.concat(line, detail)).otherwise(line)
    body = ranked.select("dataset", "rank", text.alias("value"))
    winners = ranked.filter(F.col("rank") == 1)
    head = winners.select("dataset", F.lit(0).alias("rank"), F.concat(F.lit("Dataset: "), "dataset").alias("value"))
    best = winners.select(
        "dataset",
        F.lit(1_000_000).alias("rank"),
        F.concat(
            F.lit("Best Algorithm: "), "algorithm", F.lit(", Best Params: "), F.to_json("best_params")
        ).alias("value"),
    )
    return head.unionByName(body).unionByName(best).orderBy("dataset", "rank")


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select("value").write.mode(mode).text(path)


def run_status(spark: SparkSession, steps: list[tuple[str, str, float]]) -> DataFrame:
    """Status of the driver's own stages (one row per stage)."""
    return spark.createDataFrame(steps, "step string, status string, seconds double")
