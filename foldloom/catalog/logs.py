"""Queries over an experiment log and its hyper-parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import LOG, digits, experiment_log, query, rounded, table
from foldloom.operators import hyperparams, leaderboard
from foldloom.plans import recommend


@query(f"""with {LOG}, r as (select *, row_number() over (partition by dataset, fold order by score desc, seq) as rn from log)
select dataset, fold, algorithm as best_algorithm, round(score, 6) as best_score,
       dataset || '_fold_' || fold as dataset_fold from r where rn = 1""")
def best_per_fold(spark, sf):
    return rounded(leaderboard.best_per_fold(experiment_log(spark, sf)), ["best_score"])


@query(f"""with {LOG}, m as (select dataset, algorithm, avg(score) as mean_score, min(seq) as first from log group by 1, 2),
r as (select *, row_number() over (partition by dataset order by mean_score desc, first) as rn from m),
p as (select dataset, algorithm, k, row_number() over (partition by dataset, algorithm order by score desc, seq) as rn from log)
select dataset, algorithm, round(mean_score, 6) as mean_score, k from r join p using (dataset, algorithm) where r.rn = 1 and p.rn = 1""")
def best_per_dataset(spark, sf):
    out = leaderboard.best_per_dataset(experiment_log(spark, sf))
    return out.select("dataset", "algorithm", digits("mean_score").alias("mean_score"), F.col("params")["k"].cast("long").alias("k"))


@query(f"""with {LOG}, m as (select dataset, algorithm, avg(score) as mean_score, min(seq) as first from log group by 1, 2),
r as (select *, row_number() over (partition by dataset order by mean_score desc, first) as rn from m),
p as (select dataset, algorithm, k, row_number() over (partition by dataset, algorithm order by score desc, seq) as rn from log),
meta as (select user_id % 5 as dataset, count(*)::double as n_samples, round(avg(value), 6) as mean_value from events group by 1)
select dataset, n_samples, mean_value, r.algorithm as best_algorithm, k, f.fold::integer as fold, dataset || '_fold_' || f.fold as dataset_fold
from meta join r using (dataset) join p on p.dataset = r.dataset and p.algorithm = r.algorithm
join (select unnest(range(1, 11)) as fold) f on true where r.rn = 1 and p.rn = 1""")
def recommender_rows(spark, sf):
    """What the recommender learns from: meta-features and best algorithm of each dataset, a row per fold."""
    meta = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("value").alias("mean_value")
    )
    rows = recommend.training_rows(meta, experiment_log(spark, sf), 10)
    return rows.select(
        "dataset", "n_samples", digits("mean_value").alias("mean_value"), "best_algorithm",
        F.col("params")["k"].cast("long").alias("k"), "fold", "dataset_fold",
    )


@query(f"""with {LOG}, p as (select *, row_number() over (partition by dataset, algorithm order by score desc, seq) as rn from log)
select dataset, algorithm, k, round(score, 6) as score from p where rn = 1""")
def best_params(spark, sf):
    out = leaderboard.best_params(experiment_log(spark, sf))
    return out.select("dataset", "algorithm", F.col("params")["k"].cast("long").alias("k"), digits("score").alias("score"))


@query(f"""with {LOG}, m as (select dataset, algorithm, avg(score) as mean_score, count(*) as entries from log group by 1, 2)
select dataset, algorithm, round(mean_score, 6) as mean_score, entries,
       cast(row_number() over (partition by dataset order by mean_score desc, algorithm) as integer) as rank from m""")
def ranked_leaderboard(spark, sf):
    return rounded(leaderboard.ranked(leaderboard.mean_scores(experiment_log(spark, sf))), ["mean_score"])


@query(f"""with {LOG}, m as (select dataset, algorithm, avg(score) as mean_score, count(*) as entries from log group by 1, 2)
select dataset, algorithm, round(mean_score, 6) as mean_score, entries from m order by m.mean_score desc, dataset, algorithm limit 1""")
def global_best(spark, sf):
    return rounded(leaderboard.global_best(leaderboard.mean_scores(experiment_log(spark, sf))), ["mean_score"])


@query(f"with {LOG} select seq, dataset, algorithm, round(score, 6) as score from log order by log.score desc, seq")
def trials_by_value(spark, sf):
    log = experiment_log(spark, sf).select("seq", "dataset", "algorithm", "score")
    return rounded(leaderboard.trials_by_value(log), ["score"])


@query(f"""with {LOG}, r as (select *, row_number() over (partition by dataset, fold order by score desc, seq) as rn from log)
select algorithm, count(*) as n from r where rn = 1 group by 1""")
def algorithm_distribution(spark, sf):
    winners = leaderboard.best_per_fold(experiment_log(spark, sf)).withColumnRenamed("best_algorithm", "algorithm")
    return leaderboard.algorithm_distribution(winners)


@query(f"""with {LOG} select dataset, count(*) as n, round(min(score), 6) as minimum, round(quantile_cont(score, 0.25), 6) as q1,
  round(quantile_cont(score, 0.5), 6) as median, round(quantile_cont(score, 0.75), 6) as q3, round(max(score), 6) as maximum
from log group by 1""")
def score_boxplot(spark, sf):
    out = leaderboard.five_numbers(experiment_log(spark, sf))
    return rounded(out, ["minimum", "q1", "median", "q3", "maximum"])


@query(f"""with {LOG}, m as (select dataset, algorithm, avg(score) as s from log group by 1, 2),
t as (select dataset, max(s) as top from m group by 1),
w as (select dataset, sum(exp(s - top)) as total from m join t using (dataset) group by 1),
r as (select *, row_number() over (partition by dataset order by s desc, algorithm) as rn from m)
select dataset, algorithm, round(1 / total, 8) as confidence from r join w using (dataset) where rn = 1""")
def softmax_choice(spark, sf):
    means = leaderboard.mean_scores(experiment_log(spark, sf))
    return rounded(leaderboard.softmax_choice(means, value="mean_score"), ["confidence"], 8)


_STOP = """with x as ({source}),
b as (select *, min(l) over (partition by g order by s rows between unbounded preceding and 1 preceding) as best from x),
i as (select g, s from b where best is null or l < best),
n as (select g, s, lead(s) over (partition by g order by s) as nxt from i),
e as (select g, max(s) as last from x group by 1),
c as (select n.g, min(s) as stop from n join e using (g) where coalesce(nxt - s > {p}, e.last - s >= {p}) group by 1),
latest as (select g, max(s) as s from i group by 1)
select {out} coalesce(stop, latest.s) as best_step, coalesce(stop + {p}, e.last) as stop_step, stop is not null as stopped_early
from e join latest using (g) left join c using (g)"""


@query(_STOP.format(source="select 0 as g, event_id as s, value as l from events", p=500, out=""))
def early_stop_point(spark, sf):
    """The event values as one loss series."""
    series = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return leaderboard.early_stop(series, patience=500, block=1000)


@query(_STOP.format(source="select o_orderstatus as g, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as s, o_totalprice as l from orders",
                    p=50, out="g as o_orderstatus,"))
def early_stop_by_group(spark, sf):
    """One loss series per order status."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    ranked = leaderboard.dense_steps(df, "o_orderkey", ["o_orderstatus"])
    series = ranked.select("o_orderstatus", "step", F.col("o_totalprice").alias("loss"))
    return leaderboard.early_stop(series, patience=50, by=["o_orderstatus"], block=500)


def _ragged(spark, sf):
    """Best entry per (dataset, fold); its parameter is named after its algorithm."""
    best = F.max_by(F.struct("algorithm", "params"), F.struct("score", -F.col("seq")))
    picked = experiment_log(spark, sf).groupBy("dataset", "fold").agg(best.alias("b"))
    named = F.create_map(F.col("b.algorithm"), F.col("b.params")["k"])
    return picked.select("dataset", "fold", F.col("b.algorithm").alias("algorithm"), named.alias("params"))


RAGGED = f"""{LOG}, r0 as (select *, row_number() over (partition by dataset, fold order by score desc, seq) as rn from log),
ragged as (select dataset, fold, algorithm, algorithm as hp, k from r0 where rn = 1)
"""
_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"with {RAGGED} select dataset, fold, algorithm, hp, cast(k as varchar) as value from ragged")
def hp_explode(spark, sf):
    return hyperparams.explode_params(_ragged(spark, sf))


@query(f"""with {RAGGED} select dataset, fold, {', '.join(f"max(case when hp = '{t}' then cast(k as varchar) end) as hp_{t}, bool_or(hp = '{t}') as mask_{t}" for t in _TYPES)}
from ragged group by 1, 2""")
def hp_long_to_wide(spark, sf):
    long = hyperparams.explode_params(_ragged(spark, sf))
    return hyperparams.widen(long, ["dataset", "fold"], _TYPES)


@query(f"""with {LOG}, s as (select algorithm, avg(k) as m, stddev_pop(k) as d, count(k) as n from log group by 1)
select seq, algorithm as hp, round(coalesce(case when n > 1 then (k - m) / (case when d = 0 then 1 else d end) else k end, 0), 6) + 0.0 as scaled
from log join s using (algorithm)""")
def hp_scale(spark, sf):
    long = experiment_log(spark, sf).select(
        "seq", F.col("algorithm").alias("hp"), F.col("params")["k"].cast("double").alias("value")
    )
    out = hyperparams.scale_hp(long, hyperparams.fit_hp_scalers(long))
    return rounded(out.select("seq", "hp", "scaled"), ["scaled"])


@query(f"with {LOG} select seq, algorithm as hp, round(k::double, 6) as value from log")
def hp_unscale(spark, sf):
    long = experiment_log(spark, sf).select(
        "seq", F.col("algorithm").alias("hp"), F.col("params")["k"].cast("double").alias("value")
    )
    scalers = hyperparams.fit_hp_scalers(long)
    out = hyperparams.unscale_hp(hyperparams.scale_hp(long, scalers).drop("value"), scalers)
    return rounded(out.select("seq", "hp", "value"), ["value"])


_BOUNDS = ", ".join(
    f"('{a}', '{h}', {lo}::double, {'NULL' if hi is None else hi}::double, {str(w).lower()})"
    for a, h, lo, hi, w in hyperparams.LEGAL_RANGES
)


@query(f"""with {LOG}, b(algorithm, hp, lo, hi, whole) as (values {_BOUNDS})
select seq, b.algorithm, hp, round(greatest(lo, coalesce(least(hi, x), x)), 9) as value
from (select seq, b.*, case when whole then floor(abs(raw)) else abs(raw) end as x
      from (select seq, (k - 50) * 1.5 as raw from log) l cross join b) b""")
def hp_clamp(spark, sf):
    """Every log entry offers its number for every known parameter; legal ranges do the rest."""
    bounds = hyperparams.bounds_table(spark)
    offered = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(h).alias("h")) for a, h, *_ in hyperparams.LEGAL_RANGES]))
    long = experiment_log(spark, sf).select(
        "seq", ((F.col("params")["k"].cast("double") - 50) * 1.5).alias("value"), offered.alias("o")
    ).select("seq", F.col("o.a").alias("algorithm"), F.col("o.h").alias("hp"), "value")
    return hyperparams.clamp(long, bounds).select("seq", "algorithm", "hp", F.round("value", 9).alias("value"))


_DECODED = [(a, h) for a, h in hyperparams.DECODED]


@query(f"""with {LOG}, d(algorithm, hp) as (values {', '.join(f"('{a}', '{h}')" for a, h in _DECODED)}),
v as (select seq, d.*, (k - 50) / 40.0::double as x from log cross join d)
select seq, algorithm, hp, case hp when 'max_features' then case when abs(x) > 0.5 then 'sqrt' else 'log2' end
  when 'activation' then case when abs(x) > 0.5 then 'tanh' else 'relu' end
  when 'weights' then case when abs(x) > 0.5 then 'distance' else 'uniform' end
  when 'batch_size' then case when abs(x) < 0.25 then '32' when abs(x) < 0.5 then '64' when abs(x) < 0.75 then '128' else '256' end
  when 'algorithm' then case when abs(x) < 0.25 then 'auto' when abs(x) < 0.5 then 'ball_tree' when abs(x) < 0.75 then 'kd_tree' else 'brute' end end as value
from v""")
def hp_decode(spark, sf):
    offered = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(h).alias("h")) for a, h in _DECODED]))
    long = experiment_log(spark, sf).select(
        "seq", ((F.col("params")["k"].cast("double") - 50) / 40.0).alias("x"), offered.alias("o")
    ).select("seq", F.col("o.a").alias("algorithm"), F.col("o.h").alias("hp"), "x")
    return long.select(
        "seq", "algorithm", "hp", hyperparams.decode(F.col("algorithm"), F.col("hp"), F.col("x")).alias("value")
    )


@query("""with w as (select event_id, event_type as hp, case when event_id % 3 = 0 then user_id::varchar else 'w' || (user_id % 7) end as value from events),
c as (select hp, value, row_number() over (partition by hp order by value) - 1 as code
      from (select distinct hp, value from w where try_cast(value as double) is null))
select event_id, w.hp, w.value, coalesce(try_cast(w.value as double), c.code::double) as number
from w left join c on w.hp = c.hp and w.value = c.value""")
def hp_categorical_codes(spark, sf):
    long = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("hp"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string"))
        .otherwise(F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string"))).alias("value"),
    )
    return hyperparams.categorical_codes(long).select("event_id", "hp", "value", "number")


@query(f"""with {LOG} select seq, case when seq % 3 = 0 then k else 5 end as n_neighbors,
  case seq % 4 when 0 then 'distance' when 1 then 'uniform' when 2 then 'uniform' else null end as weights from log""")
def hp_accepted(spark, sf):
    """Keep what the model accepts, repair an illegal value, add a missing default."""
    k = F.col("params")["k"]
    base = F.map_concat(
        F.create_map(F.lit("nonsense"), k),
        F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("n_neighbors"), k)).otherwise(F.create_map().cast("map<string,string>")),
        F.when(F.col("seq") % 4 == 0, F.create_map(F.lit("weights"), F.lit("distance")))
        .when(F.col("seq") % 4 == 1, F.create_map(F.lit("weights"), F.lit("uniform")))
        .when(F.col("seq") % 4 == 2, F.create_map(F.lit("weights"), F.lit("cosine")))
        .otherwise(F.create_map().cast("map<string,string>")),
    )
    fixed = hyperparams.repair_knn(hyperparams.accepted_params(base, ["n_neighbors", "weights", "p"]))
    return experiment_log(spark, sf).select("seq", fixed.alias("p")).select(
        "seq", F.col("p")["n_neighbors"].cast("long").alias("n_neighbors"), F.col("p")["weights"].alias("weights")
    )

