"""Models and results that are stored and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldloom.catalog.base import query, rounded, table
from foldloom.catalog.evaluating import rounded_metrics
from foldloom.catalog.modelling import _numeric_orders, _ridge_sql, _two_features
from foldloom.operators import linear, metrics, models
from foldloom.session import shared_folder
from foldloom.sources import folds as fold_source
from foldloom.sources import logs
from foldloom.sources.model_store import Entry, ModelStore
from foldloom.sources.snapshots import Snapshots


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


@query(_ridge_sql(25.0))
def ridge_stored(spark, sf):
    """Ridge weights per fold, saved as rows, read back through a new store and joined to the rows they predict."""
    df, names, root = _two_features(spark, sf), ["c_acctbal", "c_nationkey"], _fresh(spark)
    sums = linear.fold_moments(df, names, "o_totalprice", "fold")
    rows = [("orders", f, "ridge", [float(w) for w in linear.solve_ridge(sums, 25.0, f)]) for f in sums.parts]
    ModelStore(spark, root).save_rows(
        "linear", spark.createDataFrame(rows, "dataset string, fold int, model string, weights array<double>")
    )
    stored = ModelStore(spark, root).rows("linear").filter("dataset = 'orders' and model = 'ridge'").collect()
    scored = linear.predict_by_fold(df, names, "fold", {r["fold"]: r["weights"] for r in stored})
    return rounded_metrics(metrics.regression_metrics(scored, ["fold"], "o_totalprice", "y_pred"))


@query("""with f as (
  select cast(ntile(3) over (order by ((o_orderkey % 10007) * 7919) % 10007, o_orderkey) as integer) as fold
  from orders where o_custkey in (select c_custkey from customer))
select fold, count(*) as n, 0 as n_different from f group by fold""")
def trees_stored(spark, sf):
    """Rows whose prediction by a reloaded decision tree differs from that of the tree that was saved, by fold."""
    frame, names = _numeric_orders(spark, sf)
    packed = models.spread_out(models.assemble(frame, names, "o_totalprice", ["row_id", "fold"]))
    fitted = models.fit_by_fold(packed, "decision_tree", {"max_depth": 4})
    root = _fresh(spark)
    ModelStore(spark, root).save(Entry("orders", int(f), "decision_tree", m) for f, m in fitted.items())
    again = models.predict_with(ModelStore(spark, root).folds("orders", "decision_tree"), packed)
    first = models.predict_with(fitted, packed).select("row_id", F.col("y_pred").alias("y_first"))
    differs = F.when(F.col("y_pred").eqNullSafe(F.col("y_first")), 0).otherwise(1)
    return again.join(first, "row_id").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(differs).cast("int").alias("n_different")
    )


@query("""with r as (select p_size::double as x, p_partkey::double as key, p_retailprice as y, p_partkey % 4 as fold from part),
f as (select h.f as fold, case when r.fold = h.f then 'test' else 'train' end as split, x, key, y from r join (select unnest([0, 1, 2, 3]) as f) h on true)
select 'part' as dataset, fold::integer as fold, split, count(*) as n, round(sum(x), 2) as size, round(sum(key * y), 0) as key_target
from f group by fold, split""")
def fold_files(spark, sf):
    """A dataset written as four files per fold, found and read back whole; features and targets match by position."""
    root = _fresh(spark)
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("key"),
        F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 4).cast("int").alias("fold"),
    )
    for fold in range(4):
        fold_source.write_fold_files(part, root, "part", fold, "y", "p_partkey")
    (dataset,) = fold_source.fold_layout(spark, root)
    rows = fold_source.read_dataset(spark, root, dataset)
    sums = rows.groupBy("dataset", "fold", "split").agg(
        F.count("target").alias("n"), F.sum("x").alias("size"), F.sum(F.col("key") * F.col("target")).alias("key_target")
    )
    return rounded(rounded(sums, ["size"], 2), ["key_target"], 0)


@query("""with e as (
  select 'd' || (user_id % 5) as dataset, event_type as algorithm, max(value) as best, count(*) as n from events group by 1, 2)
select dataset, algorithm, round(best, 6) as best_score, n::integer as n_trials from e""")
def restarted_log(spark, sf):
    """A search log that is saved by parts, fails half-way and is repeated: each result is there once."""
    results = table(spark, sf, "events").groupBy(
        F.concat(F.lit("d"), F.col("user_id") % 5).alias("dataset"), F.col("event_type").alias("algorithm")
    ).agg(F.max("value").alias("best_score"), F.count(F.lit(1)).cast("int").alias("n_trials"))
    store = Snapshots(spark, _fresh(spark))
    logs.merge_log(store, results.filter("dataset < 'd2'").withColumn("best_score", F.lit(-1.0)))
    logs.merge_log(store, results.filter("dataset < 'd4'"))
    logs.merge_log(store, results)
    return rounded(store.read("log"), ["best_score"])
