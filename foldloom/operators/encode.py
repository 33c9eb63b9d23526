"""Categorical encoders: one counted category table per fit, one lookup per apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.columns import melt
from foldloom.operators.state import LOCAL_STATE_ROWS, Settled, lookup, settle
from foldloom.session import checkpointed


@dataclass(frozen=True)
class CategoryMap:
    """``(column, key, n, mean, code)``, one row per known category.

    ``n`` training rows hold the category and ``mean`` is their mean target;
    ``code`` is the 0-based position of the category in string order.  ``totals``
    keeps per column the rows, the overall mean target and the most frequent code.
    """

    state: Settled
    columns: tuple[str, ...]
    totals: dict[str, tuple[int, float | None, int | None]]

    def of(self, column: str) -> Settled:
        rows = self.state.table.filter(F.col("column") == column).drop("column")
        return Settled(rows, self.state.local)


def order_codes(values: DataFrame, group: str, key: str, limit: int = LOCAL_STATE_ROWS) -> DataFrame:
    """Add ``code``: 0-based position of ``key`` within ``group`` in key order.

    ``values`` holds distinct (group, key).  A bounded table is numbered by a
    window.  A larger one is range-partitioned by (group, key), numbered inside
    each partition and shifted by the counts of the partitions before it, so no
    task holds a whole column.
    """
    settled = settle(values, limit)
    if settled.local:
        by_key = Window.partitionBy(group).orderBy(key)
        return settled.table.withColumn("code", F.row_number().over(by_key) - 1)
    placed = checkpointed(
        settled.table.repartitionByRange(group, key)
        .sortWithinPartitions(group, key)
        .withColumn("__at", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__at", 33))
    # one row per (partition, group): bounded by partitions + groups
    runs = placed.groupBy("__part", group).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = (
        Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = settle(
        runs.select(
            "__part", group, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
        )
    ).table
    return placed.join(offsets, ["__part", group]).select(
        *settled.table.columns,
        (F.col("__at") - F.col("__first") + F.col("__off")).cast("int").alias("code"),
    )


def fit_categories(
    df: DataFrame,
    columns: Sequence[str],
    target: str | None = None,
    also: DataFrame | None = None,
    limit: int = LOCAL_STATE_ROWS,
) -> CategoryMap:
    """Count the categories of all ``columns`` in one pass over ``df``.

    ``also`` adds categories that only occur there (a test split) with ``n`` = 0;
    they receive codes but no statistics.
    """
    y = F.col(target).cast("double") if target else F.lit(None).cast("double")
    long = melt(df.withColumn("__y", y), columns, ["__y"], cast="string", value="key")
    counted = long.filter(F.col("key").isNotNull()).groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"), F.count("__y").alias("labelled")
    )
    if also is not None:
        extra = melt(also, columns, cast="string", value="key").filter(F.col("key").isNotNull())
        zero = F.lit(0).cast("long")
        counted = (
            counted.unionByName(
                extra.distinct().select(
                    "column", "key", zero.alias("n"), F.lit(None).cast("double").alias("mean"), zero.alias("labelled")
                )
            )
            .groupBy("column", "key")
            .agg(F.sum("n").alias("n"), F.max("mean").alias("mean"), F.sum("labelled").alias("labelled"))
        )
    state = settle(order_codes(counted, "column", "key", limit), limit)
    return CategoryMap(state, tuple(columns), category_totals(state.table))


def category_totals(table: DataFrame) -> dict[str, tuple[int, float | None, int | None]]:
    """Rows, overall mean target and most frequent code per column, from the category table alone."""
    rows = table.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.try_divide(F.sum(F.col("mean") * F.col("labelled")), F.sum("labelled")).alias("overall"),
        F.min_by("code", F.struct(-F.col("n"), F.col("key"))).alias("mode"),
    )
    return {r["column"]: (r["rows"], r["overall"], r["mode"]) for r in rows.collect()}


def _joined(df: DataFrame, column: str, categories: CategoryMap) -> DataFrame:
    known = categories.of(column)
    table = known.table.select(
        F.col("key").alias("__key"),
        *[F.col(c).alias(f"{column}__{c}") for c in ("n", "mean", "code")],
    )
    keyed = df.withColumn("__key", F.col(column).cast("string"))
    return lookup(keyed, Settled(table, known.local), ["__key"], f"{column}__n").drop("__key")


def encode(
    df: DataFrame,
    categories: CategoryMap,
    column: str,
    label: str | None = None,
    target_mean: str | None = None,
    frequency: str | None = None,
    count: str | None = None,
    unseen: str = "first",
) -> DataFrame:
    """Apply any of the encodings of one column with a single lookup.

    ``unseen`` categories get label 0 (``first``), the code of the most frequent
    training category (``mode``) or NULL (``null``); their target mean is the
    overall mean, their frequency and count are 0.
    """
    rows, overall, mode = categories.totals.get(column, (0, None, None))
    joined = _joined(df, column, categories)
    fallback = {"first": F.lit(0), "mode": F.lit(mode), "null": F.lit(None)}[unseen]
    n = F.coalesce(F.col(f"{column}__n"), F.lit(0).cast("long"))
    added: dict[str, Column] = {}
    if target_mean:
        added[target_mean] = F.coalesce(F.col(f"{column}__mean"), F.lit(overall).cast("double"))
    if frequency:
        added[frequency] = n / F.lit(float(rows or 1))
    if count:
        added[count] = n
    if label:
        added[label] = F.coalesce(F.col(f"{column}__code"), fallback.cast("int"))
    result = joined.withColumns(added)
    return result.drop(*[f"{column}__{c}" for c in ("n", "mean", "code")])


def unseen_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Categories of ``test`` that never occur in ``train``."""
    return test.select(column).distinct().join(train.select(column).distinct(), column, "left_anti")


def fit_out_of_fold_means(df: DataFrame, column: str, target: str, fold: str) -> Settled:
    """Mean target per (category, fold) over the rows of *other* folds.

    Sums per (category, fold) are enough: every other-fold mean is a total minus
    a part, so no row is replicated per fold.
    """
    part = df.groupBy(column, fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("__s")
    )
    per_category = Window.partitionBy(column)
    folds = part.groupBy(fold).agg(F.sum("n").alias("__fn"), F.sum("__s").alias("__fs"))
    total = part.agg(F.sum("n").alias("n"), F.sum("__s").alias("s")).first()
    rest_n = F.sum("n").over(per_category) - F.col("n")
    rest_s = F.sum("__s").over(per_category) - F.col("__s")
    overall = F.try_divide(F.lit(total["s"]) - F.col("__fs"), F.lit(total["n"]) - F.col("__fn"))
    table = part.join(settle(folds).table, fold).select(
        column, fold, "n",
        F.coalesce(F.try_divide(rest_s, rest_n), overall).alias("__oof"),
    )
    return settle(table)


def out_of_fold_target_encode(
    df: DataFrame, column: str, target: str, fold: str, name: str
) -> DataFrame:
    state = fit_out_of_fold_means(df, column, target, fold)
    joined = lookup(df, state, [column, fold])
    return joined.withColumn(name, F.col("__oof")).drop("__oof", "n")


def threshold_label(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """Category by thresholds on ``abs(value)``: first step with ``abs(value) < bound``."""
    size = F.abs(value)
    ladder = None
    for bound, name in steps:
        ladder = F.when(size < bound, F.lit(name)) if ladder is None else ladder.when(size < bound, F.lit(name))
    return ladder.otherwise(F.lit(last))
