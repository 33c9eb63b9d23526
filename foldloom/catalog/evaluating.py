"""Metrics, summaries, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import FOLDED_ORDERS, LOG, digits, experiment_log, query, rounded, table
from foldloom.operators import folds, leaderboard, metrics
from foldloom.operators.state import with_state
from foldloom.plans.pipeline import REFERENCE_SCORES


def _folded(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return folds.shuffled_kfold(df, "o_orderkey", 10)


def mean_model_predictions(spark, sf):
    """Every order predicted by the mean of the folds it is not in."""
    folded = _folded(spark, sf)
    means = metrics.fit_mean_model(folded, "o_totalprice", "fold")
    return with_state(folded, means, ["fold"]).withColumnRenamed("o_totalprice", "y_true")


MEAN_MODEL = f"""{FOLDED_ORDERS},
parts as (select fold, sum(o_totalprice) as s, count(*) as n from folded group by 1),
means as (select fold, ((select sum(s) from parts) - s) / ((select sum(n) from parts) - n) as y_pred from parts),
pred as (select folded.*, y_pred from folded join means using (fold))
"""
METRIC_SQL = """count(*) as n, avg(pow(o_totalprice - y_pred, 2)) as mse, avg(abs(o_totalprice - y_pred)) as mae,
  1 - sum(pow(o_totalprice - y_pred, 2)) / (var_pop(o_totalprice) * count(*)) as r2, sqrt(avg(pow(o_totalprice - y_pred, 2))) as rmse"""


def rounded_metrics(df):
    return df.withColumns(
        {"mse": digits("mse", 0), "mae": digits("mae", 4), "r2": digits("r2", 9), "rmse": digits("rmse", 4)}
    )


@query(f"""with {MEAN_MODEL}, m as (select fold, {METRIC_SQL} from pred group by 1)
select fold, n, round(mse, 0) as mse, round(mae, 4) as mae, round(r2, 9) + 0.0 as r2, round(rmse, 4) as rmse from m""")
def baseline_fold_metrics(spark, sf):
    return rounded_metrics(metrics.regression_metrics(mean_model_predictions(spark, sf), ["fold"], "y_true", "y_pred"))


@query(f"""with {MEAN_MODEL}, m as (select o_orderpriority as dataset, fold, {METRIC_SQL} from pred group by 1, 2)
select dataset, count(*) as total_folds, round(avg(mse), 0) as avg_mse, round(stddev_pop(mse), 0) as std_mse,
  round(avg(mae), 3) as avg_mae, round(stddev_pop(mae), 3) as std_mae, round(avg(r2), 8) + 0.0 as avg_r2,
  round(stddev_pop(r2), 8) as std_r2, round(avg(rmse), 3) as avg_rmse, round(stddev_pop(rmse), 3) as std_rmse
from m group by 1""")
def cross_fold_summary(spark, sf):
    predictions = mean_model_predictions(spark, sf).withColumnRenamed("o_orderpriority", "dataset")
    out = metrics.cross_fold_summary(metrics.regression_metrics(predictions, ["dataset", "fold"]))
    places = {"mse": 0, "mae": 3, "r2": 8, "rmse": 3}
    return out.withColumns({f"{s}_{m}": digits(f"{s}_{m}", d) for m, d in places.items() for s in ("avg", "std")})


@query(f"""with {FOLDED_ORDERS}, h as (select o_orderkey, o_totalprice, row_number() over (order by ((o_orderkey % 10007) * 7919) % 10007, o_orderkey) as rn from orders),
n as (select count(*) - cast(ceil(0.2 * count(*)) as bigint) as cut from orders),
m as (select avg(o_totalprice) as y_pred from h, n where rn <= cut)
select {METRIC_SQL.replace('avg(pow(o_totalprice - y_pred, 2)) as mse', 'round(avg(pow(o_totalprice - y_pred, 2)), 0) as mse')
        .replace('avg(abs(o_totalprice - y_pred)) as mae', 'round(avg(abs(o_totalprice - y_pred)), 4) as mae')
        .replace('1 - sum(pow(o_totalprice - y_pred, 2)) / (var_pop(o_totalprice) * count(*)) as r2', 'round(1 - sum(pow(o_totalprice - y_pred, 2)) / (var_pop(o_totalprice) * count(*)), 9) + 0.0 as r2')
        .replace('sqrt(avg(pow(o_totalprice - y_pred, 2))) as rmse', 'round(sqrt(avg(pow(o_totalprice - y_pred, 2))), 4) as rmse')}
from h, n, m where rn > cut""")
def baseline_holdout(spark, sf):
    """Mean model fitted on 80 % and scored on the shuffled 20 %."""
    df = folds.holdout(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2)
    state = metrics.fit_mean_model(df.filter(F.col("split") == "train"), "o_totalprice")
    predicted = with_state(df.filter(F.col("split") == "test"), state)
    return rounded_metrics(metrics.regression_metrics(predicted, [], "o_totalprice", "y_pred"))


@query("""with b as (select o_orderkey % 4 as dataset, 5.0 as y, case when o_orderkey % 4 = 0 then 5.0 else 5.5 end as p,
      o_orderkey % 4 = 3 as unlabelled from orders)
select dataset, count(*) as n, round(avg(pow(y - p, 2)), 6) as mse, case when sum(pow(y - p, 2)) = 0 then 1.0::double else 0.0::double end as r2
from b where not unlabelled group by 1""")
def constant_truth_metrics(spark, sf):
    """Constant truth scores 1 when exact and 0 otherwise; unlabelled rows give no metric row."""
    key = F.col("o_orderkey") % 4
    df = table(spark, sf, "orders").select(
        key.alias("dataset"),
        F.when(key != 3, F.lit(5.0)).alias("y_true"),
        F.when(key == 0, F.lit(5.0)).otherwise(F.lit(5.5)).alias("y_pred"),
    )
    out = metrics.regression_metrics(df, ["dataset"])
    return rounded(out.select("dataset", "n", "mse", "r2"), ["mse"])


@query("""select source, count(*) as n, round(avg(case when quality = (case when n_chars >= 500 then 1 else 0 end) then 1.0 else 0.0 end), 9) as accuracy
from labels join documents using (doc_id) group by 1""")
def accuracy_by_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    df = table(spark, sf, "labels").join(docs, "doc_id").select(
        "source", F.col("quality").alias("y_true"), (F.col("n_chars") >= 500).cast("int").alias("y_pred")
    )
    return rounded(metrics.accuracy(df, ["source"]), ["accuracy"], 9)


@query("""with a as (select user_id as fold, avg(case when value > 20 then 1.0 else 0.0 end) as acc, avg(value) as loss from events group by 1)
select round(avg(acc), 8) as avg_accuracy, round(stddev_pop(acc), 8) as std_accuracy, round(avg(loss), 6) as avg_loss,
       round(stddev_pop(loss), 6) as std_loss, count(*) as total_folds from a""")
def meta_model_cv(spark, sf):
    """Cross-validation summary of a classifier: accuracy and loss over the folds."""
    folds_ = table(spark, sf, "events").groupBy(F.col("user_id").alias("fold")).agg(
        F.avg((F.col("value") > 20).cast("double")).alias("accuracy"), F.avg("value").alias("loss")
    )
    out = metrics.cross_fold_summary(folds_, [], ["accuracy", "loss"])
    return rounded(rounded(out, ["avg_accuracy", "std_accuracy"], 8), ["avg_loss", "std_loss"], 6)


@query(f"""with {LOG}, m as (select seq % 97 as trial, avg(score) as s from log where dataset <> 3 group by 1),
t as (select distinct seq % 101 as trial from log)
select trial, round(s, 6) as mean_r2, round(coalesce(s, 0.0), 6) as score from t left join m using (trial)""")
def mean_over_folds(spark, sf):
    log = experiment_log(spark, sf)
    trials = log.select((F.col("seq") % 101).alias("trial")).distinct()
    rows = log.filter("dataset <> 3").select((F.col("seq") % 97).alias("trial"), F.col("score").alias("r2"))
    out = metrics.mean_over_folds(trials, rows, metrics=("r2",))
    return rounded(out, ["mean_r2", "score"])


@query(f"""with {LOG}, p as (select algorithm, dataset, case when dataset = 4 then null else avg(score) end as s from log group by 1, 2)
select algorithm, round(avg(coalesce(s, -1.0)) - 0.1 * stddev_pop(coalesce(s, -1.0)), 6) + 0.0 as robust_score, count(*) as datasets
from p group by 1""")
def robust_score(spark, sf):
    """Dataset 4 fails for every algorithm and counts with the penalty score."""
    means = leaderboard.mean_scores(experiment_log(spark, sf)).select(
        "algorithm", "dataset", F.when(F.col("dataset") != 4, F.col("mean_score")).alias("score")
    )
    return rounded(metrics.robust_score(means, ["algorithm"]), ["robust_score"])


_REFERENCE = ", ".join(f"('{d}', {s}::double)" for d, s in REFERENCE_SCORES)
_NAMES = ", ".join(f"'{d}'" for d, _ in REFERENCE_SCORES)
_GAPS = f"""{LOG}, ref(dataset, reference) as (values {_REFERENCE}),
names as (select [{_NAMES}, 'unknown_set'] as names),
s as (select names[cast(seq % 6 as bigint) + 1] as dataset, avg(score) / 100 as r2 from log, names group by 1),
g as (select dataset, r2, coalesce(reference, 0.0) as reference, coalesce(reference, 0.0) - r2 as gap from s left join ref using (dataset))
"""


def _gaps(spark, sf):
    names = F.array(*[F.lit(d) for d, _ in REFERENCE_SCORES], F.lit("unknown_set"))
    results = experiment_log(spark, sf).groupBy(
        F.element_at(names, (F.col("seq") % 6 + 1).cast("int")).alias("dataset")
    ).agg((F.avg("score") / 100).alias("r2"))
    return metrics.reference_gap(results, spark.createDataFrame(REFERENCE_SCORES, "dataset string, reference double"))


@query(f"""with {_GAPS} select dataset, round(r2, 6) as r2, reference, round(gap, 6) as gap,
  case when gap < 0.05 then 'excellent' when gap < 0.1 then 'good' when gap < 0.2 then 'ok' else 'needs work' end as status from g""")
def reference_gap(spark, sf):
    return rounded(_gaps(spark, sf), ["r2", "gap"])


@query(f"with {_GAPS} select count(*) as datasets, round(avg(abs(gap)), 6) as average_gap from g")
def average_gap(spark, sf):
    return rounded(metrics.average_gap(_gaps(spark, sf)), ["average_gap"])
