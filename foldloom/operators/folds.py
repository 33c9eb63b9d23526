"""Fold assignment and hold-outs by rank selection, never by a global window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions.numeric import spread
from foldloom.operators.derive import assign_tiles, tile_of
from foldloom.operators.orderstats import HOT_GROUP_ROWS, select_ranks
from foldloom.operators.state import settle
from foldloom.session import checkpointed

SHUFFLE = "__shuffle"
#: classes whose cuts are broadcast
FEW_CLASSES = 10_000


def _with_shuffle(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    return df.withColumn(SHUFFLE, spread(F.col(row_id), shift=seed))


def shuffled_kfold(
    df: DataFrame, row_id: str, k: int = 10, name: str = "fold", seed: int = 0
) -> DataFrame:
    """Shuffled k-fold: folds 1..k, the first ``n mod k`` of them one row larger."""
    keyed = _with_shuffle(df, row_id, seed)
    return assign_tiles(keyed, [SHUFFLE, row_id], k, name).drop(SHUFFLE)


def contiguous_kfold(df: DataFrame, row_id: str, k: int, name: str = "fold") -> DataFrame:
    """Unshuffled k-fold: consecutive blocks in row order."""
    return assign_tiles(df, [row_id], k, name)


def stratified_kfold(
    df: DataFrame, label: str, row_id: str, k: int = 5, name: str = "fold", seed: int = 0,
    few: int = FEW_CLASSES, hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Shuffled folds 1..k that keep the class shares; a row without a class has no fold.

    With the classes laid end to end in order of first appearance, fold f takes
    every k-th position; only these counts matter, so each class is cut at the
    matching ranks of its shuffle order.

    The cuts of up to ``few`` classes are selected and broadcast.  With more classes their starts are a
    distributed table, classes of over ``hot_rows`` rows are cut like that, and the rows of
    all others are ranked by a sort in which no class is large.
    """
    keyed = _with_shuffle(df, row_id, seed)
    counts = keyed.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first")
    )
    found = counts.limit(few + 1).collect()
    if len(found) <= few:
        start, classes = 0, []
        for row in sorted(found, key=lambda r: r["first"]):
            classes.append((row[label], row["n"], start))
            start += row["n"]
        return _cut_classes(keyed, classes, label, row_id, k, name)
    starts = _starts(counts)
    # at most the row count over ``hot_rows``
    hot = [(r[label], r["n"], r["start"]) for r in starts.filter(F.col("n") > hot_rows).collect()]
    cold = keyed.filter(F.col(label).isNotNull())
    if hot:
        labels = F.broadcast(df.sparkSession.createDataFrame([(h[0],) for h in hot], T.StructType([keyed.schema[label]])))
        cold = cold.join(labels, label, "left_anti")
    rank = F.row_number().over(Window.partitionBy(label).orderBy(SHUFFLE, row_id))
    ranked = cold.withColumn("__rank", rank).join(
        starts.select(label, F.col("n").alias("__n"), F.col("start").alias("__start")), label
    )
    upto, passed = F.lit(0), F.lit(0)
    for f in range(k - 1):
        first = F.col("__start") + F.pmod(F.lit(f) - F.col("__start"), F.lit(k))
        upto = upto + F.greatest(F.lit(0), F.ceil((F.col("__start") + F.col("__n") - first) / k))
        passed = passed + (F.col("__rank") > upto).cast("int")
    out = ranked.withColumn(name, F.lit(1) + passed).drop(SHUFFLE, "__rank", "__n", "__start")
    none = keyed.filter(F.col(label).isNull()).withColumn(name, F.lit(None).cast("int")).drop(SHUFFLE)
    out = out.unionByName(none)
    if not hot:
        return out
    own = keyed.join(labels, label, "left_semi")
    return out.unionByName(_cut_classes(own, hot, label, row_id, k, name))


def _starts(counts: DataFrame) -> DataFrame:
    """Classes with ``start``, the rows of all classes that appear before: a running sum within range partitions."""
    placed = checkpointed(
        counts.repartitionByRange("first").sortWithinPartitions("first").withColumn("__at", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__at", 33))
    # one row per partition
    sums = placed.groupBy("__part").agg(F.sum("n").alias("s"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sums.select("__part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("__off"))).table
    before = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("__off")
    return checkpointed(placed.join(offsets, "__part").withColumn("start", start).drop("__part", "__at", "__off", "first"))


def _cut_classes(keyed: DataFrame, classes: Sequence[tuple], label: str, row_id: str, k: int, name: str) -> DataFrame:
    """Folds of the rows of ``classes`` (label, n, start), cut at ranks that are selected without a sort."""
    ends: dict[tuple, list[int]] = {}
    for value, n, start in classes:
        stop, at, cuts = start + n, 0, []
        for f in range(k - 1):
            first = start + (f - start) % k
            at += max(0, -(-(stop - first) // k))
            cuts.append(at)
        ends[(value,)] = cuts
    wanted = {g: sorted({c for c in cuts if c >= 1}) for g, cuts in ends.items()}
    _, found = select_ranks(
        keyed.select(label, SHUFFLE, row_id), [SHUFFLE, row_id], wanted, by=[label]
    )
    rows = []
    for group, cuts in ends.items():
        bounds = [found[group][c] for c in cuts if c >= 1]
        rows.append((group[0], len(cuts) - len(bounds), [tuple(b) for b in bounds]))
    schema = T.StructType(
        [
            keyed.schema[label],
            T.StructField("__skip", T.IntegerType()),
            T.StructField(
                "__cuts",
                T.ArrayType(
                    T.StructType(
                        [T.StructField(c, keyed.schema[c].dataType) for c in (SHUFFLE, row_id)]
                    )
                ),
            ),
        ]
    )
    cuts = keyed.sparkSession.createDataFrame(rows, schema)
    key = F.struct(F.col(SHUFFLE), F.col(row_id))
    passed = F.aggregate(
        "__cuts", F.lit(0), lambda a, c: a + F.when(key > c, F.lit(1)).otherwise(F.lit(0))
    )
    # one row per class, of which there are few
    joined = keyed.join(F.broadcast(cuts), label, "left")
    return joined.withColumn(name, F.lit(1) + F.col("__skip") + passed).drop(
        SHUFFLE, "__skip", "__cuts"
    )


def expand_folds(df: DataFrame, fold: str = "fold", k: int = 10, split: str = "split") -> DataFrame:
    """Every row once per fold, as test in its own fold and as train in the others.

    Only for exporting a fold layout: metrics and encoders work from per-fold
    sums and never need the k-fold copy.
    """
    assigned = df.withColumnRenamed(fold, "__assigned")
    copies = assigned.withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(k))))
    role = F.when(F.col("__assigned") == F.col(fold), "test").otherwise("train")
    return copies.withColumn(split, role).drop("__assigned")


def _cut_at(df: DataFrame, order: Sequence[str], test_rows) -> DataFrame:
    """``split``: the last ``test_rows(n)`` rows in ``order`` are test."""
    _, found = select_ranks(df.select(*order), list(order), lambda n: [max(1, n - test_rows(n))])
    cuts = [v for v in found.get((), {}).values()]
    tiled = tile_of(df, order, cuts, "__tile")
    return tiled.withColumn(
        "split", F.when(F.col("__tile") == 1, "train").otherwise("test")
    ).drop("__tile")


def holdout(df: DataFrame, row_id: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Seeded shuffled hold-out; the test part has ``ceil(share * n)`` rows."""
    keyed = _with_shuffle(df, row_id, seed)
    return _cut_at(keyed, [SHUFFLE, row_id], lambda n: math.ceil(share * n)).drop(SHUFFLE)


def sequential_holdout(df: DataFrame, row_id: str, share: float = 0.1) -> DataFrame:
    """The last ``floor(share * n)`` rows in row order are the validation part."""
    return _cut_at(df, [row_id], lambda n: math.floor(share * n))


def sample_cap(
    df: DataFrame, order: Sequence[str], above: int = 50_000, keep: int = 10_000
) -> DataFrame:
    """Down-sample to ``keep`` rows when there are more than ``above``: a top-k, not a sort."""
    if df.count() <= above:
        return df
    return df.orderBy(*order).limit(keep)
