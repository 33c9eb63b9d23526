"""Imputation, infinities, column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import (
    EVENTS_INF,
    ORDERS_NULLS,
    digits,
    events_inf,
    orders_nulls,
    query,
    rounded,
    table,
)
from foldloom.operators import clean, columns
from foldloom.plans import features as fe


@query(f"""with {ORDERS_NULLS}
select o_orderkey, round(coalesce(o_totalprice, (select avg(o_totalprice) from orders_nulls)), 4) as o_totalprice
from orders_nulls""")
def impute_mean(spark, sf):
    df = orders_nulls(spark, sf).select("o_orderkey", "o_totalprice")
    state = clean.fit_mean(df, ["o_totalprice"])
    return rounded(clean.fill(df, state, ["o_totalprice"]), ["o_totalprice"], 4)


@query(f"""with {ORDERS_NULLS},
m as (select o_orderstatus, avg(o_totalprice) as m from orders_nulls group by 1)
select o_orderkey, o_orderstatus, round(coalesce(o_totalprice, m.m), 4) as o_totalprice
from orders_nulls join m using (o_orderstatus)""")
def impute_mean_by_group(spark, sf):
    df = orders_nulls(spark, sf).select("o_orderkey", "o_orderstatus", "o_totalprice")
    by = ["o_orderstatus"]
    out = clean.fill(df, clean.fit_mean(df, ["o_totalprice"], by), ["o_totalprice"], by)
    return rounded(out, ["o_totalprice"], 4)


@query(f"""with {ORDERS_NULLS}
select o_orderkey, round(coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from orders_nulls)), 4) as o_totalprice
from orders_nulls""")
def impute_median(spark, sf):
    df = orders_nulls(spark, sf).select("o_orderkey", "o_totalprice")
    state = clean.fit_median(df, ["o_totalprice"])
    return rounded(clean.fill(df, state, ["o_totalprice"]), ["o_totalprice"], 4)


@query(f"""with {ORDERS_NULLS},
c as (select o_orderpriority as v, count(*) as n from orders_nulls where o_orderpriority is not null group by 1),
m as (select v from c order by n desc, v limit 1)
select o_orderkey, coalesce(o_orderpriority, (select v from m)) as o_orderpriority from orders_nulls""")
def impute_mode(spark, sf):
    df = orders_nulls(spark, sf).select("o_orderkey", "o_orderpriority")
    state = clean.fit_mode(df, ["o_orderpriority"])
    return clean.fill(df, state, ["o_orderpriority"], default="missing")


@query(f"""with {ORDERS_NULLS}
select o_orderkey, coalesce(o_orderpriority, 'unknown') as o_orderpriority from orders_nulls""")
def impute_unknown(spark, sf):
    df = orders_nulls(spark, sf).select("o_orderkey", "o_orderpriority")
    return clean.text_or_unknown(df, ["o_orderpriority"])


@query(f"""with {ORDERS_NULLS}
select o_orderkey,
       round(coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from orders_nulls), 0.0), 4) as o_totalprice,
       cast(0.0 as double) as all_missing
from orders_nulls""")
def impute_default(spark, sf):
    df = orders_nulls(spark, sf).select(
        "o_orderkey", "o_totalprice", F.lit(None).cast("double").alias("all_missing")
    )
    both = ["o_totalprice", "all_missing"]
    return rounded(clean.fill(df, clean.fit_median(df, both), both, default=0.0), ["o_totalprice"], 4)


@query(f"""with {EVENTS_INF},
q as (select quantile_cont(value, 0.01) as p1, quantile_cont(value, 0.99) as p99 from events_inf
      where value is not null and not isinf(value))
select event_id, round(case when value = 'infinity'::double then p99
                            when value = '-infinity'::double then p1 else value end, 6) as value
from events_inf, q""")
def clip_infinite(spark, sf):
    df = columns.nan_to_null(events_inf(spark, sf).select("event_id", "value"))
    state = clean.fit_clip(df, ["value"])
    return rounded(clean.clip_infinite(df, state, ["value"]), ["value"])


@query(f"""with {EVENTS_INF}
select event_id, round(case when value is null or isinf(value) then 0.0 else value end, 6) as value from events_inf""")
def zero_infinite(spark, sf):
    df = events_inf(spark, sf).select("event_id", "value")
    return rounded(clean.zero_infinite(df, ["value"]), ["value"])


@query(f"""with {EVENTS_INF},
m as (select quantile_cont(value, 0.5) as m from events_inf where value is not null and not isinf(value))
select event_id, round(case when value is null or isinf(value) then m.m else value end, 6) as value
from events_inf, m""")
def infinite_to_median(spark, sf):
    df = events_inf(spark, sf).select("event_id", "value")
    finite = clean.infinite_to_null(df, ["value"])
    return rounded(clean.fill(finite, clean.fit_median(finite, ["value"]), ["value"]), ["value"])


@query(f"""with {EVENTS_INF},
q as (select event_type, quantile_cont(value, 0.5) as m from events_inf
      where value is not null and not isinf(value) group by 1)
select event_id, event_type,
       round(case when value is null or isinf(value) then m else value end, 6) as value
from events_inf join q using (event_type)""")
def infinite_to_group_median(spark, sf):
    df = clean.infinite_to_null(events_inf(spark, sf), ["value"])
    by = ["event_type"]
    return rounded(clean.fill(df, clean.fit_median(df, ["value"], by), ["value"], by), ["value"])


@query(f"""with {EVENTS_INF}
select cast(count(*) filter (where value is null) as bigint) as missing,
       cast(count(*) filter (where isinf(value)) as bigint) as infinite
from events_inf""")
def remaining_issues(spark, sf):
    return clean.remaining_issues(events_inf(spark, sf), ["event_id"])


@query("""select p_partkey, p_size, p_retailprice from part""")
def drop_constant(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.lit(1.0).alias("always_one")
    )
    return columns.drop_constant(df, ["p_size", "p_retailprice", "always_one"])


@query("""select p_partkey, p_retailprice, p_size, cast(0.0 as double) as p_weight from part""")
def schema_align(spark, sf):
    df = table(spark, sf, "part")
    return columns.align_to(df, ["p_retailprice", "p_size", "p_weight"], ["p_partkey"])


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount + 0.0 as l_discount, l_tax + 0.0 as l_tax from lineitem""")
def numeric_columns(spark, sf):
    df = columns.numeric_only(table(spark, sf, "lineitem"))
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in ("l_discount", "l_tax")})


@query("""select o_orderkey, o_custkey, o_totalprice from orders""")
def first_columns(spark, sf):
    df = columns.numeric_only(table(spark, sf, "orders"), ["o_orderkey"])
    return columns.first_columns(df, 50, ["o_orderkey"])


@query("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders order by o_orderkey limit 3""")
def column_preview(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderdate")
    return columns.preview(df, ["o_orderkey"], n=3, head=4)


@query("""select o_totalprice, o_orderpriority from orders order by o_orderkey limit 3""")
def column_preview_tail(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderdate")
    return columns.preview(df, ["o_orderkey"], n=3, tail=2)


@query(f"""with {ORDERS_NULLS},
m as (select quantile_cont(o_totalprice, 0.5) as m from orders_nulls),
c as (select o_orderpriority as v, count(*) as n from orders_nulls where o_orderpriority is not null group by 1),
f as (select v from c order by n desc, v limit 1),
filled as (select o_orderkey, o_orderstatus, coalesce(o_orderpriority, (select v from f)) as p,
                  coalesce(o_totalprice, (select m from m)) as y from orders_nulls),
sc as (select s, row_number() over (order by s) - 1 as code from (select distinct o_orderstatus as s from filled)),
pc as (select p, row_number() over (order by p) - 1 as code from (select distinct p from filled))
select o_orderkey, cast(sc.code as integer) as o_orderstatus, cast(pc.code as integer) as o_orderpriority,
       round(y, 4) as o_totalprice
from filled join sc on s = o_orderstatus join pc using (p)""")
def clean_for_folds(spark, sf):
    df = orders_nulls(spark, sf)
    return rounded(fe.clean_for_folds(df, "o_totalprice", ["o_orderkey"]), ["o_totalprice"], 4)


@query(f"""with {ORDERS_NULLS},
x as (select n.o_orderkey, n.o_orderpriority, n.o_totalprice, c.c_acctbal
      from orders_nulls n join orders o using (o_orderkey) join customer c on o.o_custkey = c.c_custkey),
m as (select avg(o_totalprice) as m from x),
c as (select o_orderpriority as v, count(*) as n from x where o_orderpriority is not null group by 1),
f as (select v from c order by n desc, v limit 1),
filled as (select o_orderkey, coalesce(o_totalprice, (select m from m)) as o_totalprice,
                  coalesce(o_orderpriority, (select v from f)) as p, c_acctbal from x),
coded as (select o_orderkey, o_totalprice, c_acctbal, dense_rank() over (order by p) - 1 as o_orderpriority from filled),
s as (select avg(o_totalprice) as m1, stddev_pop(o_totalprice) as s1,
             avg(o_orderpriority) as m2, stddev_pop(o_orderpriority) as s2 from coded)
select o_orderkey, round(c_acctbal, 6) + 0.0 as c_acctbal, round((o_totalprice - m1) / s1, 6) + 0.0 as o_totalprice,
       round((o_orderpriority - m2) / s2, 6) + 0.0 as o_orderpriority
from coded, s""")
def clean_for_search(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    df = (
        orders_nulls(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
        .join(keys, "o_orderkey").join(customer, "o_custkey").drop("o_custkey")
    )
    out = fe.clean_for_search(df, "c_acctbal", ["o_orderkey"])
    return rounded(out, ["c_acctbal", "o_totalprice", "o_orderpriority"])


@query(f"""with {ORDERS_NULLS},
x as (select *, o_orderkey % 10 = 0 as is_test from orders_nulls),
t as (select * from x where not is_test),
codes as (select p, row_number() over (order by p) - 1 as code
          from (select distinct coalesce(o_orderpriority, 'unknown') as p from x)),
coded as (select x.o_orderkey, x.is_test, coalesce(x.o_totalprice, (select avg(o_totalprice) from t)) as price, codes.code
          from x join codes on codes.p = coalesce(x.o_orderpriority, 'unknown')),
m1 as (select avg(price) as a1, stddev_pop(price) as b1, avg(code) as a2, stddev_pop(code) as b2 from coded where not is_test),
l as (select o_orderkey, is_test, ln(1 + abs((price - a1) / b1)) as l1, ln(1 + abs((code - a2) / b2)) as l2 from coded, m1),
m2 as (select avg(l1) as a1, stddev_pop(l1) as b1, avg(l2) as a2, stddev_pop(l2) as b2 from l where not is_test)
select o_orderkey, round((l1 - a1) / b1, 3) + 0.0 as o_totalprice, round((l2 - a2) / b2, 3) + 0.0 as o_orderpriority
from l, m2""")
def clean_train_test(spark, sf):
    df = orders_nulls(spark, sf).select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.lit(0.0).alias("target"), F.lit(3.5).alias("flat")
    )
    test = F.col("o_orderkey") % 10 == 0
    fitted = fe.fit_clean_features(df.filter(~test), "target", ["o_orderkey"], df.filter(test))
    out = fitted.transform(df)
    return out.select("o_orderkey", digits("o_totalprice", 3).alias("o_totalprice"),
                      digits("o_orderpriority", 3).alias("o_orderpriority"))
