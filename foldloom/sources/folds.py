"""Reading and writing datasets laid out as folds.

Two layouts are read: one directory per dataset and fold with four parquet files
(features and targets of both splits; each may be a folder of numbered part files), and the partitioned table this package
writes (``dataset=/fold=/split=``), where a fold is found by partition pruning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.operators.columns import nan_to_null
from foldloom.session import checkpointed

LAYOUT = ("dataset", "fold", "split")
EXAM = "exam_dataset"
#: rows of a part file
FILE_ROWS = 100_000


def read_folds(spark: SparkSession, root: str, dataset: str | None = None, fold: int | None = None) -> DataFrame:
    """The partitioned table; the filters prune directories, NaN becomes NULL."""
    df = spark.read.parquet(root)
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    if fold is not None:
        df = df.filter(F.col("fold") == (1 if dataset == EXAM else fold))
    return nan_to_null(df)


def write_folds(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*LAYOUT).parquet(root)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True


def _position(df: DataFrame) -> Column:
    """Position of each row inside its file, the only row identity this layout has.

    Where a file is a folder of several parts, the number of the part comes first.
    """
    at = F.col("_metadata.row_index")
    folders = Counter(f.rsplit("/", 1)[0] for f in df.inputFiles() if "/part-" in f)
    if max(folders.values(), default=1) == 1:
        return at
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    return F.shiftleft(F.when(part == "", 0).otherwise(part).cast("long"), 33) + at


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", _position(df))


def read_fold_directory(
    spark: SparkSession, root: str, dataset: str, fold: int, suffix: str = ""
) -> DataFrame:
    """One dataset fold of the four-file layout as one frame, target NULL when unlabelled.

    Features and target are matched by row position within their files.
    ``suffix`` selects engineered features (``X_train_engineered.parquet``).
    """
    folder = f"{root}/{dataset}/{1 if dataset == EXAM else fold}"
    parts = []
    for split in ("train", "test"):
        x = nan_to_null(_numbered(spark.read.parquet(f"{folder}/X_{split}{suffix}.parquet")))
        target_path = f"{folder}/y_{split}.parquet"
        if split == "train" or _exists(spark, target_path):
            raw = spark.read.parquet(target_path)
            y = raw.select(
                _position(raw).alias("row_id"), F.col(f"`{raw.columns[0]}`").cast("double").alias("target")
            )
            joined = x.join(y, "row_id", "left")
        else:
            joined = x.withColumn("target", F.lit(None).cast("double"))
        parts.append(joined.withColumn("split", F.lit(split)))
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.withColumns({"dataset": F.lit(dataset), "fold": F.lit(fold)})


#: dataset, fold and split in a path of the four-file layout
PLACE = r"/([^/]+)/(\d+)/[Xy]_(train|test)[^/]*\.parquet"


def fold_layout(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """Datasets below ``root`` in the four-file layout, and their folds, from one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/X_train.parquet")
    found: dict[str, list[int]] = {}
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
        fold = status.getPath().getParent()
        if fold.getName().isdigit():
            found.setdefault(fold.getParent().getName(), []).append(int(fold.getName()))
    return {d: sorted(f) for d, f in sorted(found.items())}


def _placed(df: DataFrame, position: Column) -> DataFrame:
    """fold, split and row position from the file that a row comes from."""
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), PLACE, i)
    return df.withColumns(
        {"fold": part(2).cast("int"), "split": part(3), "row_id": position}
    )


def read_dataset(spark: SparkSession, root: str, dataset: str, suffix: str = "", ragged: bool = False) -> DataFrame:
    """All folds of a dataset in the four-file layout as one frame: two scans and one join, however many folds.

    Rows of features and targets are matched by fold, split and position.  The target is NULL where there is no
    file with targets.  ``suffix`` selects engineered features; ``ragged`` unites folds with different columns.
    """
    both = "{train,test}"
    x = spark.read.option("mergeSchema", ragged).parquet(f"{root}/{dataset}/*/X_{both}{suffix}.parquet")
    x = nan_to_null(_placed(x, _position(x)))
    try:
        raw = spark.read.parquet(f"{root}/{dataset}/*/y_{both}.parquet")
    except AnalysisException:
        joined = x.withColumn("target", F.lit(None).cast("double"))
    else:
        target = F.col(f"`{raw.columns[0]}`").cast("double").alias("target")
        y = _placed(raw.select(target, "_metadata"), _position(raw)).select("fold", "split", "row_id", "target")
        # targets are as many as features, which the size of their files hides
        joined = x.join(y.hint("merge"), ["fold", "split", "row_id"], "left")
    return joined.withColumn("dataset", F.lit(dataset))


def write_fold_files(df: DataFrame, root: str, dataset: str, fold: int, target: str, row_id: str) -> None:
    """One fold of the four-file layout: rows of ``fold`` are the test split; targets follow the features' order.

    Rows are in the order of ``row_id``, in part files of about ``FILE_ROWS`` rows of the dataset.
    """
    parts = max(1, -(-df.count() // FILE_ROWS))
    # written once, so that features and targets are cut and ordered alike
    ordered = checkpointed(df.repartitionByRange(parts, row_id).sortWithinPartitions(row_id))
    features = [c for c in df.columns if c not in (target, "fold", row_id)]
    for split, rows in (("train", ordered.filter(F.col("fold") != fold)), ("test", ordered.filter(F.col("fold") == fold))):
        rows.select(*features).write.mode("overwrite").parquet(f"{root}/{dataset}/{fold}/X_{split}.parquet")
        rows.select(target).write.mode("overwrite").parquet(f"{root}/{dataset}/{fold}/y_{split}.parquet")


def read_flat(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Train and test files whose last column is the target."""
    parts = []
    for split in ("train", "test"):
        df = nan_to_null(spark.read.parquet(f"{folder}/{split}.parquet"))
        last = df.columns[-1]
        parts.append(
            df.withColumn("target", F.col(f"`{last}`").cast("double")).drop(*([last] if last != "target" else []))
            .withColumn("split", F.lit(split))
        )
    return parts[0].unionByName(parts[1]).withColumns(
        {"dataset": F.lit(dataset), "fold": F.lit(1)}
    )


def discover(spark: SparkSession, root: str) -> list[str]:
    """Dataset directories below ``root``, sorted, through the Hadoop file system of the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def discover_folds(spark: SparkSession, root: str, dataset: str) -> list[int]:
    return sorted(int(n) for n in discover(spark, f"{root}/{dataset}") if n.isdigit())


def load_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every dataset below ``root``: fold 1 of the fold layout, else the flat layout."""
    found = {}
    for dataset in discover(spark, root):
        if discover_folds(spark, root, dataset):
            found[dataset] = read_fold_directory(spark, root, dataset, 1)
        elif _exists(spark, f"{root}/{dataset}/train.parquet"):
            found[dataset] = read_flat(spark, f"{root}/{dataset}", dataset)
    return found


def metadata(df: DataFrame, name: str, features: Sequence[str], target: str, folds: int) -> DataFrame:
    """One row describing a dataset."""
    return df.agg(
        F.lit(name).alias("name"),
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(features)).alias("n_features"),
        F.lit(target).alias("target_name"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.lit(folds).alias("n_folds"),
    )
