"""Fold assignment, hold-outs, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import FOLDED_ORDERS, SHUFFLED, query, table
from foldloom.functions.numeric import spread
from foldloom.operators import folds


@query(f"with {FOLDED_ORDERS} select o_orderkey, fold from folded")
def shuffled_kfold(spark, sf):
    return folds.shuffled_kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10)


@query(f"with {FOLDED_ORDERS} select fold, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from folded group by 1")
def kfold_sizes(spark, sf):
    folded = folds.shuffled_kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10)
    return folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query(f"""with {FOLDED_ORDERS}
select f.k as fold, case when f.k = folded.fold then 'test' else 'train' end as split, count(*) as n,
       round(avg(o_totalprice), 3) as mean_target
from folded cross join (select cast(unnest(range(1, 11)) as integer) as k) f group by 1, 2""")
def expand_folds(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    expanded = folds.expand_folds(folds.shuffled_kfold(df, "o_orderkey", 10), k=10)
    return expanded.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean_target")
    )


@query("select o_orderkey, cast(ntile(3) over (order by o_orderkey) as integer) as fold from orders")
def contiguous_kfold(spark, sf):
    return folds.contiguous_kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 3)


_STRATIFIED = """
with c as (select {label} as label, count(*) as n, min({id}) as first from {table} group by 1),
s as (select label, n, coalesce(sum(n) over (order by first rows between unbounded preceding and 1 preceding), 0) as start from c),
f as (select label, start, f, cast(len(list_filter(range(start::bigint, (start + n)::bigint), lambda p: p % 5 = f)) as bigint) as take
      from s cross join (select unnest(range(5)) as f)),
e as (select label, f, sum(take) over (partition by label order by f) as upto from f),
r as (select {id}, {label} as label, row_number() over (partition by {label} order by (({id} % 10007) * 7919) % 10007, {id}) as rn from {table})
select r.{id}, r.label as {label}, cast(1 + (select count(*) from e where e.label = r.label and e.f < 4 and e.upto < r.rn) as integer) as fold from r
"""


@query(_STRATIFIED.format(label="quality", id="doc_id", table="labels"))
def stratified_kfold(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", "quality")
    return folds.stratified_kfold(df, "quality", "doc_id", 5)


@query(_STRATIFIED.format(label="event_type", id="event_id", table="events"))
def stratified_kfold_events(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return folds.stratified_kfold(df, "event_type", "event_id", 5)


@query(_STRATIFIED.format(label="o_custkey", id="o_orderkey", table="orders"))
def stratified_kfold_many(spark, sf):
    """A class per customer, in the form for more classes than the driver should hold."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return folds.stratified_kfold(df, "o_custkey", "o_orderkey", 5, few=100)


@query(f"""select o_orderkey, case when row_number() over (order by {SHUFFLED})
       <= (select count(*) - cast(ceil(0.2 * count(*)) as bigint) from orders) then 'train' else 'test' end as split from orders""")
def holdout_split(spark, sf):
    return folds.holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("""select o_orderkey, case when row_number() over (order by o_orderkey)
       <= (select count(*) - cast(floor(0.1 * count(*)) as bigint) from orders) then 'train' else 'test' end as split from orders""")
def sequential_holdout(spark, sf):
    return folds.sequential_holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("""with n as (select count(*) as n from lineitem),
r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       row_number() over (order by ((l_orderkey % 10007) * 7919) % 10007, l_orderkey, l_partkey, l_suppkey, l_linenumber) as rn from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber from r, n where n.n <= 50000 or rn <= 10000""")
def sample_cap(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = table(spark, sf, "lineitem").select(*keys)
    return folds.sample_cap(df, [spread(F.col("l_orderkey")), *keys])
