"""Models, nearest neighbours, search and recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import FOLDED_ORDERS, query, rounded, table
from foldloom.catalog.evaluating import rounded_metrics
from foldloom.operators import folds, knn, linear, metrics, models
from foldloom.plans import features as fe
from foldloom.plans import recommend, search
from foldloom.plans.pipeline import final_predictions


@query("""select p_brand, round(regr_slope(p_retailprice, p_size), 6) + 0.0 as slope, round(regr_intercept(p_retailprice, p_size), 6) as intercept,
  count(*) as n from part group by 1""")
def linreg_single(spark, sf):
    out = linear.single_regression(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"])
    return rounded(out, ["slope", "intercept"])


def _two_features(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    folded = folds.shuffled_kfold(df, "o_orderkey", 10)
    return folded.join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("row_id"), "fold", "c_acctbal", "c_nationkey", "o_totalprice"
    )


def _ridge_sql(alpha: float) -> str:
    return f"""with {FOLDED_ORDERS},
x as (select f.o_orderkey as row_id, f.fold, c.c_acctbal as a, c.c_nationkey as b, f.o_totalprice as y
      from folded f join orders o using (o_orderkey) join customer c on o.o_custkey = c.c_custkey),
m as (select t.fold, count(*) as n, avg(a) ma, avg(b) mb, avg(y) my,
        var_pop(a) * count(*) + {alpha} as saa, var_pop(b) * count(*) + {alpha} as sbb, covar_pop(a, b) * count(*) as sab,
        covar_pop(a, y) * count(*) as say, covar_pop(b, y) * count(*) as sby
      from (select distinct fold from x) t join x on x.fold <> t.fold group by 1),
w as (select *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) as wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) as wb from m),
p as (select x.fold, y, my + wa * (a - ma) + wb * (b - mb) as yp from x join w using (fold))
select fold, count(*) as n, round(avg(pow(y - yp, 2)), 0) as mse, round(avg(abs(y - yp)), 4) as mae,
  round(1 - sum(pow(y - yp, 2)) / (var_pop(y) * count(*)), 9) + 0.0 as r2, round(sqrt(avg(pow(y - yp, 2))), 4) as rmse from p group by 1"""


def _ridge(spark, sf, alpha: float):
    df = _two_features(spark, sf)
    names = ["c_acctbal", "c_nationkey"]
    sums = linear.fold_moments(df, names, "o_totalprice", "fold")
    weights = {f: linear.solve_ridge(sums, alpha, f) for f in sums.parts}
    scored = linear.predict_by_fold(df, names, "fold", weights)
    return rounded_metrics(metrics.regression_metrics(scored, ["fold"], "o_totalprice", "y_pred"))


@query(_ridge_sql(0.0))
def linreg_cv(spark, sf):
    """Least squares on two features, all folds solved from one scan."""
    return _ridge(spark, sf, 0.0)


@query(_ridge_sql(25.0))
def ridge_cv(spark, sf):
    return _ridge(spark, sf, 25.0)


def _lasso_sql(alpha: float) -> str:
    """The least objective among the stationary points of every choice of signs."""
    ridge = _ridge_sql(0.0)
    head, tail = ridge.split("\nw as ", 1)[0], ridge.split("\np as ", 1)[1]
    soft = "sign({0}) * greatest(abs({0}) - t, 0) / {1}"
    return f"""{head}
s as (select *, {alpha} * n as t from m),
c as (
  select s.*, 0.0::double as wa, 0.0::double as wb from s
  union all select s.*, {soft.format("say", "saa")}, 0.0 from s
  union all select s.*, 0.0, {soft.format("sby", "sbb")} from s
  union all
  select * from (
    select s.*, (sbb * (say - t * i) - sab * (sby - t * j)) / (saa * sbb - sab * sab) as wa,
           (saa * (sby - t * j) - sab * (say - t * i)) / (saa * sbb - sab * sab) as wb
    from s, (values (1, 1), (1, -1), (-1, 1), (-1, -1)) as v(i, j)
    where sign((sbb * (say - t * i) - sab * (sby - t * j)) / (saa * sbb - sab * sab)) = i
      and sign((saa * (sby - t * j) - sab * (say - t * i)) / (saa * sbb - sab * sab)) = j)),
w as (
  select fold, any_value(ma) as ma, any_value(mb) as mb, any_value(my) as my, arg_min(wa, o) as wa, arg_min(wb, o) as wb
  from (select *, (saa * wa * wa + 2 * sab * wa * wb + sbb * wb * wb) / 2 - wa * say - wb * sby + t * (abs(wa) + abs(wb)) as o from c)
  group by fold),
p as {tail}"""


@query(_lasso_sql(10.0))
def lasso_cv(spark, sf):
    df = _two_features(spark, sf)
    names = ["c_acctbal", "c_nationkey"]
    sums = linear.fold_moments(df, names, "o_totalprice", "fold")
    weights = {f: linear.solve_lasso(sums, 10.0, f) for f in sums.parts}
    scored = linear.predict_by_fold(df, names, "fold", weights)
    return rounded_metrics(metrics.regression_metrics(scored, ["fold"], "o_totalprice", "y_pred"))


_KNN = """with e as (select vec_id, label, vec_id % 10 as fold, list_transform(embedding, lambda x: x::double) as v from embeddings),
d as (select a.vec_id as q, a.label as y, b.vec_id as i, b.label as l, {distance} as dist
      from e a join e b on {match}),
r as (select *, row_number() over (partition by q order by dist, i) as rn from d),
n as (select * from r where rn <= {k})
"""
_EUCLID = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))))"
_MANHATTAN = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label",
        (F.col("vec_id") % 10).alias("fold"),
    )


def _neighbours(spark, sf, k: int, p: float = 2):
    df = _vectors(spark, sf)
    return knn.knn_join(df, df, k, label="label", fold="fold", p=p)


@query(_KNN.format(distance=_EUCLID, match="a.fold <> b.fold", k=5)
       + "select q as query_id, i as neighbour_id, round(dist, 6) as distance, l::double as label from n")
def knn_neighbours(spark, sf):
    """Five nearest vectors of other folds for every vector."""
    return rounded(_neighbours(spark, sf, 5), ["distance"])


@query(_KNN.format(distance=_EUCLID, match="a.fold <> b.fold", k=5)
       + "select q as query_id, round(avg(l), 6) as y_pred from n group by 1")
def knn_regress(spark, sf):
    return rounded(knn.knn_regress(_neighbours(spark, sf, 5)), ["y_pred"])


@query(_KNN.format(distance=_MANHATTAN, match="a.fold <> b.fold", k=7)
       + "select q as query_id, round(case when min(dist) = 0 then avg(l) filter (where dist = 0) else sum(l / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) end, 6) as y_pred from n group by 1")
def knn_regress_weighted(spark, sf):
    """Manhattan distance, neighbours weighted by one over the distance."""
    return rounded(knn.knn_regress(_neighbours(spark, sf, 7, 1), "distance"), ["y_pred"])


@query(_KNN.format(distance=_EUCLID, match="a.fold <> b.fold", k=5)
       + """, c as (select q, l, count(*) as n from n group by 1, 2), t as (select *, row_number() over (partition by q order by n desc, l) as rn from c)
select q as query_id, l::double as y_pred from t where rn = 1""")
def knn_classify(spark, sf):
    return knn.knn_classify(_neighbours(spark, sf, 5))


@query(_KNN.format(distance=_EUCLID, match="a.fold <> b.fold", k=5)
       + "select q as query_id, i as neighbour_id, round(dist, 6) as distance, l::double as label from n")
def knn_by_cells(spark, sf):
    """The same join through cells and blocks, the form used when points do not fit a task."""
    df = _vectors(spark, sf)
    out = knn.knn_join(
        df, df, 5, label="label", fold="fold", local_values=0, pivots=8, block_points=250, group_queries=250
    )
    return rounded(out, ["distance"])


META = ["n", "mean_value", "std_value", "users"]


def _groups(spark, sf):
    """Customers of one nation as a dataset: a few statistics each."""
    customer = table(spark, sf, "customer")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return customer.join(orders, "c_custkey").groupBy(F.col("c_nationkey").cast("long").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_value"),
        F.stddev_pop("o_totalprice").alias("std_value"), F.count_distinct("c_custkey").alias("users"),
    )


_GROUPS = """g as (select c_nationkey::bigint as id, count(*)::double as a, avg(o_totalprice) as b, stddev_pop(o_totalprice) as c,
  count(distinct c_custkey)::double as d from customer join orders on o_custkey = c_custkey group by 1),
s as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc, avg(d) md, stddev_pop(d) sd from g),
z as (select id, (a - ma) / sa as a, (b - mb) / sb as b, (c - mc) / sc as c, (d - md) / sd as d from g, s),
p as (select x.id as query_id, y.id as neighbour_id, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) + pow(x.d - y.d, 2)) as distance
      from z x join z y on x.id <> y.id),
r as (select *, row_number() over (partition by query_id order by distance, neighbour_id) as rn from p)
"""


@query(f"with {_GROUPS} select query_id, neighbour_id, round(distance, 6) as distance from r where rn <= 3")
def nearest_dataset(spark, sf):
    groups = _groups(spark, sf).persist()
    out = recommend.nearest_datasets(groups, groups, META, 3, same=True)
    return rounded(out.select("query_id", "neighbour_id", "distance"), ["distance"])


@query(f"""with {_GROUPS}, b as (select id, case id % 3 when 0 then 'knn' when 1 then 'ridge' else 'random_forest' end as algorithm from g),
v as (select query_id, algorithm, sum(1.0 / (distance + 1e-9)) as w from r join b on id = neighbour_id where rn <= 5 group by 1, 2),
t as (select *, sum(w) over (partition by query_id) as total, row_number() over (partition by query_id order by w desc, algorithm desc) as k from v)
select query_id as dataset_id, algorithm, round(w / total, 6) as confidence from t where k = 1""")
def recommend_by_vote(spark, sf):
    groups = _groups(spark, sf).persist()
    algorithms = F.array(F.lit("knn"), F.lit("ridge"), F.lit("random_forest"))
    targets = groups.select(
        "dataset_id", F.element_at(algorithms, (F.col("dataset_id") % 3 + 1).cast("int")).alias("algorithm"),
        F.create_map(F.lit("alpha"), F.col("n").cast("string")).alias("params"),
    )
    near = recommend.nearest_datasets(groups, groups, META, 5, same=True)
    out = recommend.vote(near, targets)
    return rounded(out.select("dataset_id", "algorithm", "confidence"), ["confidence"])


def _numeric_orders(spark, sf, k: int = 3):
    """Cleaned numeric frame of orders and customers with folds, for the model queries."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey", "c_mktsegment")
    df = table(spark, sf, "orders").drop("o_orderdate").join(customer, "o_custkey").drop("o_custkey")
    # the join result is read by every fit below
    joined = df.withColumnRenamed("o_orderkey", "row_id").persist()
    cleaned = fe.clean_for_folds(joined, "o_totalprice", ["row_id"])
    names = [c for c in cleaned.columns if c not in ("row_id", "o_totalprice")]
    return folds.shuffled_kfold(cleaned, "row_id", k), names


def _cv(spark, sf, algorithm: str, params: dict):
    frame, names = _numeric_orders(spark, sf)
    packed = models.spread_out(models.assemble(frame, names, "o_totalprice", ["row_id", "fold"]))
    out = models.fit_predict_by_fold(packed, algorithm, params)
    return metrics.regression_metrics(out, ["fold"])


@query()
def tree_cv(spark, sf):
    return _cv(spark, sf, "decision_tree", {"max_depth": 5, "min_samples_leaf": 4})


@query()
def forest_cv(spark, sf):
    return _cv(spark, sf, "random_forest", {"n_estimators": 10, "max_depth": 5, "max_features": "sqrt"})


@query()
def boosted_cv(spark, sf):
    return _cv(spark, sf, "gradient_boosting", {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1})


def _quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    df = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id").withColumnRenamed("doc_id", "row_id")
    cleaned = fe.clean_for_search(df, "quality", ["row_id"])
    return folds.stratified_kfold(cleaned, "quality", "row_id", 3), ["n_chars", "lang", "source"]


def _classify(spark, sf, algorithm: str, params: dict):
    frame, names = _quality(spark, sf)
    packed = models.spread_out(models.assemble(frame, names, "quality", ["row_id", "fold"]))
    out = models.fit_predict_by_fold(packed, algorithm, params, task="classification")
    return metrics.accuracy(out, ["fold"])


@query()
def logistic_cv(spark, sf):
    return _classify(spark, sf, "logistic_regression", {"C": 1.0, "max_iter": 50})


@query()
def svm_cv(spark, sf):
    return _classify(spark, sf, "svm", {"C": 1.0, "max_iter": 10})


@query()
def tree_classify_cv(spark, sf):
    return _classify(spark, sf, "decision_tree", {"max_depth": 4})


@query()
def search_best(spark, sf):
    """Best seeded candidate per algorithm over the folds of orders."""
    frame, names = _numeric_orders(spark, sf)
    out = search.search_dataset(frame, "orders", names, "o_totalprice", ["ridge", "lasso", "decision_tree"], 2)
    return out.select("dataset", "algorithm", "best_score", F.to_json("best_params").alias("best_params"), "n_trials")


@query()
def search_unlabelled(spark, sf):
    """Contiguous 3-fold cross-validation when no test labels exist."""
    frame, names = _numeric_orders(spark, sf)
    out = search.search_unlabelled(frame.drop("fold"), "orders", names, "o_totalprice", ["ridge", "lasso"], 3)
    return out.select("dataset", "algorithm", "best_score", "n_trials")


@query()
def cross_dataset_search(spark, sf):
    """One configuration for three datasets, mean score minus a spread penalty."""
    orders, order_names = _numeric_orders(spark, sf)
    part = table(spark, sf, "part").drop("p_name").withColumnRenamed("p_partkey", "row_id")
    part_clean = fe.clean_for_folds(part, "p_retailprice", ["row_id"])
    events = table(spark, sf, "events").drop("ts", "props").withColumnRenamed("event_id", "row_id")
    event_clean = fe.clean_for_folds(events, "value", ["row_id"])
    sets = {
        "orders": (orders, order_names, "o_totalprice"),
        "part": (folds.shuffled_kfold(part_clean, "row_id", 3), ["p_brand", "p_type", "p_size"], "p_retailprice"),
        "events": (folds.shuffled_kfold(event_clean, "row_id", 3), ["user_id", "event_type"], "value"),
    }
    grid = search.trial_grid(spark, ["ridge", "lasso"], 2)
    out = search.best_shared(search.cross_dataset_scores(sets, grid))
    return out.select("trial", "algorithm", "robust_score", "datasets")


@query()
def recommend_heads(spark, sf):
    """Learned heads over per-user statistics: algorithm, confidence, legal parameters."""
    events = table(spark, sf, "events")
    meta = events.groupBy(F.col("user_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
        F.stddev_pop("value").alias("std_value"), F.count_distinct("event_type").alias("types"),
        F.max_by("event_type", F.struct("value", "event_id")).alias("best"), F.sum("value").alias("s"),
    )
    algorithm = F.when(F.col("best").isin("click", "view"), "random_forest").when(F.col("best") == "error", "knn").otherwise("xgboost")
    rows = meta.select(
        "dataset_id", "n", "mean_value", "std_value", "types", algorithm.alias("algorithm"),
        F.create_map(
            F.lit("n_estimators"), (F.col("n") * 3 + 50).cast("string"), F.lit("max_depth"), (F.col("types") + 4).cast("string"),
            F.lit("weights"), F.when(F.col("n") % 2 == 0, "uniform").otherwise("distance"),
        ).alias("params"),
    ).persist()
    names = ["n", "mean_value", "std_value", "types"]
    out = recommend.predict_heads(recommend.fit_heads(rows, names), rows)
    return out.select("dataset_id", "algorithm", "confidence", F.to_json("hyperparams").alias("hyperparams"))


@query()
def final_train(spark, sf):
    """Constrain a recommended configuration, fit it per fold, predict, score, summarise."""
    frame, names = _numeric_orders(spark, sf)
    out = final_predictions(frame, names, "o_totalprice", "random_forest", {"n_estimators": "4", "max_depth": "4"})
    scored = metrics.regression_metrics(out.withColumn("dataset", F.lit("orders")), ["dataset", "fold"])
    return metrics.cross_fold_summary(scored)

