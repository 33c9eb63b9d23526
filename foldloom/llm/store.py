"""Written tables in the shared folder, and joins whose broadcast side has a checked size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.session import checkpointed

BROADCAST_ROWS = 200_000
#: bitmaps of 4 KB that are broadcast at most
MAPS = 1 << 14
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1_000


class Scratch:
    """Intermediate tables of one operator, as Parquet in the folder of ``spark.checkpoint.dir``.

    Every executor can read them, so a lost executor costs only its own tasks.  The tables
    are deleted when the block ends; a result that outlives it goes through ``kept``.

    Inside the block, Arrow batches have at most ``ARROW_ROWS`` rows, as rows hold whole texts.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []
        self.tables: list[str] = []
        self.rows: str | None = None

    def __enter__(self) -> Scratch:
        self.rows = self.spark.conf.get(ARROW_SETTING)
        self.spark.conf.set(ARROW_SETTING, min(int(self.rows), ARROW_ROWS))
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(ARROW_SETTING, self.rows)
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        for folder in self.folders:
            delete(self.spark, folder)

    def save(self, df: DataFrame) -> DataFrame:
        folder = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        self.folders.append(folder)
        df.write.option("compression", "zstd").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def bucketed(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """A written table in one bucket for each shuffle partition, so that joins by ``keys`` shuffle only their other side."""
        name = f"table_{uuid.uuid4().hex}"
        folder = f"{shared_folder(self.spark)}/{name}"
        self.folders.append(folder)
        self.tables.append(name)
        writer = df.write.bucketBy(partitions(self.spark), *keys).option("compression", "zstd").option("path", folder)
        writer.format("parquet").saveAsTable(name)
        return self.spark.table(name)

    @staticmethod
    def kept(df: DataFrame) -> DataFrame:
        """A checkpoint, which Spark removes once nothing refers to it any more."""
        return checkpointed(df)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        # only a local session gets here; checkpointed() refuses on a cluster
        checkpointed(spark.range(1))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted size allows it, else as it is (a shuffle join)."""
    return F.broadcast(df) if bounded(df, rows) else df


def sifted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``ids``: all that are, and at most about one in sixteen of the others.

    The ids are bits of a hash, two bytes an id, so that far more of them are broadcast than as rows.
    """
    at = F.pmod(F.xxhash64(key), F.lit(16 * max(1, ids.count()))) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket"))
    maps = Scratch.kept(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(at)).join(small_side(maps, MAPS), "_bucket")
    return joined.filter((byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1).select(*df.columns)


def first_by_hash(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """The ``most`` rows that come first by a hash of ``key``.

    Rows that cannot be among them are left out before the sort, so that all tasks together send
    little more than ``most`` rows to the one that merges.
    """
    order = F.xxhash64(F.lit(seed), key)
    total = rows.count()
    if total > most:
        share = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
        rows = rows.filter(share < 1.2 * most / total + 100 / total)
        order = share
    return rows.orderBy(order, key).limit(most)


def attach(
    df: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``df`` with a materialised table of one row per key.  Null keys equal each other.

    A table of up to ``rows`` rows is broadcast.  Of a larger one, the keys that hold over a
    thousandth of all rows (by ``weight``, so under a thousand keys) are broadcast and the others
    joined by shuffle, where no key is hot.  The table's ``weight`` column is not returned.
    """
    names = [c for c in table.columns if c not in (*keys, weight)]

    def joined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *names)
        on = [left[k].eqNullSafe(right[f"_key_{i}"]) for i, k in enumerate(keys)]
        out = left.join(right, on, kind)
        return out if kind == "left_anti" else out.drop(*[f"_key_{i}" for i in range(len(keys))])

    if bounded(table, rows):
        return joined(df, F.broadcast(table), how)
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) * 1000 > F.lit(total))
    cold = table.filter(F.col(weight) * 1000 <= F.lit(total))
    rest = joined(df, F.broadcast(hot), "left_anti")
    return joined(df, F.broadcast(hot), "inner").unionByName(joined(rest, cold, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
