"""Cleaning, trees and search for every (dataset, fold) of several datasets at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foldloom.catalog.base import EVENTS_INF, ORDERS_NULLS, digits, events_inf, orders_nulls, query, rounded, table
from foldloom.catalog.evaluating import rounded_metrics
from foldloom.operators.packed import Packed, pack
from foldloom.plans import grid, grouped, search

RAW = """raw_cells as (
  select 'events' as dataset, event_id as row_id, unnest([
    {'col': 'event_type', 's': event_type, 'x': null::double},
    {'col': 'value', 's': null, 'x': case when isfinite(value) then value end}], recursive := true) from events_inf
  union all
  select 'orders', o_orderkey, unnest([
    {'col': 'o_orderpriority', 's': coalesce(o_orderpriority, 'unknown'), 'x': null::double},
    {'col': 'o_orderstatus', 's': o_orderstatus, 'x': null::double},
    {'col': 'o_totalprice', 's': null, 'x': o_totalprice}], recursive := true) from orders_nulls
  union all
  select 'part', p_partkey, unnest([
    {'col': 'p_brand', 's': p_brand, 'x': null::double},
    {'col': 'p_size', 's': null, 'x': p_size::double}], recursive := true) from part)"""


def _raw(spark, sf) -> Packed:
    """Three datasets with missing texts and numbers; the fold is a third of the keys."""
    events = events_inf(spark, sf).withColumn("y", F.col("event_id") % 13).withColumnRenamed("event_id", "row_id")
    orders = orders_nulls(spark, sf).withColumn("y", F.col("o_orderkey") % 97).withColumnRenamed("o_orderkey", "row_id")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_brand", "p_size", F.col("p_retailprice").alias("y"))
    third = (F.col("row_id") % 3 + 1).cast("int").alias("fold")
    return pack({n: (df.select("*", third), "y") for n, df in (("events", events), ("orders", orders), ("part", part))})


@query(f"""with {ORDERS_NULLS}, {EVENTS_INF}, {RAW},
train as (
  select h.fold as held_out, c.* from raw_cells c join (select unnest([1, 2, 3]) as fold) h on c.row_id % 3 + 1 <> h.fold),
codes as (
  select dataset, held_out, col, s, dense_rank() over (partition by dataset, held_out, col order by s) - 1 as code, count(*) as n
  from train where s is not null group by dataset, held_out, col, s),
modes as (select dataset, held_out, col, arg_min(code, (-n, s)) as fill from codes group by all),
means as (select dataset, held_out, col, avg(x) as fill from train where s is null group by all),
fills as (select * from modes union all select * from means),
v as (
  select t.dataset, t.held_out, t.col, f.fill, coalesce(c.code, t.x, f.fill) as v
  from train t join fills f using (dataset, held_out, col)
  left join codes c on c.dataset = t.dataset and c.held_out = t.held_out and c.col = t.col and c.s = t.s)
select dataset, held_out, col as "column", round(max(fill), 6) as fill, round(avg(v), 6) as center,
  round(case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end, 6) as scale, stddev_pop(v) = 0 as constant
from v group by dataset, held_out, col""")
def grouped_clean_state(spark, sf):
    """Codes, fills, means and spreads of all columns of three datasets for every held-out fold."""
    packed = _raw(spark, sf)
    out = grouped.described(packed, grouped.fit_clean(packed))
    return rounded(out, ["fill", "center", "scale"])


@query("""with r as (
  select 'customer' as dataset, c_custkey % 4 as fold, c_nationkey::double as x, c_acctbal as y from customer
  union all select 'part', p_partkey % 4, p_size::double, p_retailprice from part),
h as (select unnest([0, 1, 2, 3]) as held_out),
v as (
  select dataset, held_out, x, count(*) as n, sum(y - 1000) as s from r join h on fold <> held_out group by all),
c as (
  select *, (x + lead(x) over w) / 2 as cut, sum(n) over w as nl, sum(s) over w as sl,
         sum(n) over (partition by dataset, held_out) as na, sum(s) over (partition by dataset, held_out) as sa
  from v window w as (partition by dataset, held_out order by x)),
g as (select *, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) as gain from c where cut is not null),
b as (
  select dataset, held_out, arg_max(cut, gain) as cut, arg_max(sl / nl, gain) + 1000 as ml,
         arg_max((sa - sl) / (na - nl), gain) + 1000 as mr
  from g group by all),
p as (
  select r.dataset, fold, y, case when x <= cut then ml else mr end as yp
  from r join b on r.dataset = b.dataset and r.fold = b.held_out)
select dataset, fold::integer as fold, count(*) as n, round(avg(pow(y - yp, 2)), 0) as mse, round(avg(abs(y - yp)), 4) as mae,
  round(1 - sum(pow(y - yp, 2)) / (var_pop(y) * count(*)), 9) + 0.0 as r2, round(sqrt(avg(pow(y - yp, 2))), 4) as rmse
from p group by dataset, fold""")
def stump_grid(spark, sf):
    """The best single split of every (dataset, fold) of two datasets, scored on the fold it has not seen."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), "c_nationkey", F.col("c_acctbal").alias("y"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_size", F.col("p_retailprice").alias("y"))
    fold = (F.col("row_id") % 4).alias("fold")
    packed = pack({"customer": (customer.select("*", fold), "y"), "part": (part.select("*", fold), "y")})
    fitted = grid.fit(packed, grouped.plain(packed), [grid.Trial(0, "decision_tree", {"max_depth": "1"})], bins=64)
    scored = grid.scores(packed, fitted).select("dataset", "fold", "n", "mse", "mae", "r2", "rmse")
    return rounded_metrics(scored)


@query()
def grid_search(spark, sf):
    """Seeded candidates of five algorithms on three datasets, every fold scored by models that did not see it."""
    packed = _raw(spark, sf)
    states = grouped.fit_clean(packed)
    grouped.select(packed, states)
    # every parameter as drawn from its whole range
    drawn = grid.trials_of(search.trial_grid(spark, ["ridge", "lasso", "decision_tree", "random_forest", "gradient_boosting"], 2))
    best = grid.best_trials(grid.scores(packed, grid.fit(packed, states, drawn)))
    return best.select("dataset", "algorithm", "trial", digits("best_score").alias("best_score"), "n_trials")


def _part_features(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), "p_size", (F.col("p_partkey") % 17).alias("place"),
        F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 4).alias("fold"),
    )
    return pack({"part": (part, "y")})


_PART = """r as (select p_partkey as id, p_partkey % 4 as fold, p_size::double as a, (p_partkey % 17)::double as b, p_retailprice as y from part)"""


@query(f"""with {_PART},
x as (select h.o as held_out, r.* , ((id % 10007) * 7919) % 10007 % 10 as block from r join (select unnest([0, 1, 2, 3]) as o) h on fold <> o)
select held_out::integer as held_out, block::integer as block, count(*) as n, round(sum(a), 4) as sum_size, round(sum(b), 4) as sum_place,
  round(sum(a * b), 4) as size_place, round(sum(a * y), 2) as size_y, round(sum(b * y), 2) as place_y
from x group by held_out, block""")
def selection_moments(spark, sf):
    """The sums per row block from which all selection runs are formed."""
    packed = _part_features(spark, sf)
    states = grouped.plain(packed)

    def parts(block, layout, held_out):
        return np.where(block.fold != held_out, grouped.row_blocks(block.row_id, 10), -1)

    # columns in the order of the layout: size and place
    sums = grouped.gram(packed, states, None, parts)
    cell = lambda part, at: F.max(F.when(F.col("part") == part, F.col("numbers")[at]))
    out = sums.groupBy("held_out", F.col("task").alias("block")).agg(
        cell(0, 0).cast("long").alias("n"), cell(0, 1).alias("sum_size"), cell(0, 2).alias("sum_place"),
        cell(1, 2).alias("size_place"), cell(1, 3).alias("size_y"), cell(2, 3).alias("place_y"),
    )
    return rounded(rounded(out, ["sum_size", "sum_place", "size_place"], 4), ["size_y", "place_y"], 2)


@query(f"""with {_PART},
t as (select unnest([0, 1, 2]) as trial, unnest([1.0, 10000.0, 1000000.0]) as alpha),
f as (select unnest([0, 1, 2, 3]) as f),
pairs as (select o.f as o, i.f as i from f o join f i on true),
m as (
  select o, i, trial, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) * count(*) + alpha as saa,
         var_pop(b) * count(*) + alpha as sbb, covar_pop(a, b) * count(*) as sab, covar_pop(a, y) * count(*) as say,
         covar_pop(b, y) * count(*) as sby
  from pairs join r on r.fold <> o and r.fold <> i cross join t group by o, i, trial, alpha),
w as (
  select *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) as wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) as wb from m),
s as (
  select o, i, trial, count(*) as n, avg(pow(y - my - wa * (a - ma) - wb * (b - mb), 2)) as mse, var_pop(y) as var
  from w join r on r.fold = i group by o, i, trial),
c as (
  select o, trial, avg(1 - mse / var) as inner_r2 from s where i <> o group by o, trial
  qualify row_number() over (partition by o order by inner_r2 desc, trial) = 1)
select o::integer as fold, trial::bigint as trial, round(inner_r2, 8) + 0.0 as inner_r2, n, round(mse, 4) as mse, round(1 - mse / var, 8) + 0.0 as r2
from c join s using (o, trial) where i = o""")
def nested_ridge(spark, sf):
    """The penalty chosen inside each outer fold, and its error on that fold."""
    packed = _part_features(spark, sf)
    trials = [grid.Trial(i, "ridge", {"alpha": a}) for i, a in enumerate(("1", "10000", "1000000"))]
    out = grid.nested_linear(packed, grouped.plain(packed), trials).drop("dataset")
    return rounded(rounded(out, ["inner_r2", "r2"], 8), ["mse"], 4)
