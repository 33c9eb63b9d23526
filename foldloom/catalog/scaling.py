"""Scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import query, rounded, table
from foldloom.operators import scale

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""with s as (select avg(l_quantity) a1, stddev_pop(l_quantity) b1, avg(l_extendedprice) a2, stddev_pop(l_extendedprice) b2,
       avg(l_discount) a3, stddev_pop(l_discount) b3, avg(l_tax) a4, stddev_pop(l_tax) b4 from lineitem),
z as (select l_returnflag, (l_quantity-a1)/b1 z1, (l_extendedprice-a2)/b2 z2, (l_discount-a3)/b3 z3, (l_tax-a4)/b4 z4 from lineitem, s)
select l_returnflag, count(*) as n, round(avg(z1),6)+0.0 as l_quantity, round(avg(z2),6)+0.0 as l_extendedprice,
       round(avg(z3),6)+0.0 as l_discount, round(avg(z4),6)+0.0 as l_tax, round(max(z1),6)+0.0 as max_quantity,
       round(min(z2),6)+0.0 as min_price from z group by 1""")
def standard_scale(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", *LINE)
    z = scale.standard_scale(df, scale.fit_standard(df, LINE), LINE)
    out = z.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in LINE],
        F.max("l_quantity").alias("max_quantity"), F.min("l_extendedprice").alias("min_price"),
    )
    return rounded(out, [*LINE, "max_quantity", "min_price"])


@query("""with s as (select c_mktsegment, avg(c_acctbal) a, stddev_pop(c_acctbal) b from customer group by 1)
select c_custkey, c_mktsegment, round((c_acctbal - a) / b, 6) + 0.0 as c_acctbal from customer join s using (c_mktsegment)""")
def standard_scale_by_group(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    by = ["c_mktsegment"]
    out = scale.standard_scale(df, scale.fit_standard(df, ["c_acctbal"], by), ["c_acctbal"], by)
    return rounded(out.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"])


@query("""select c_custkey, round(c_acctbal, 6) + 0.0 as c_acctbal from customer""")
def inverse_scale(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    state = scale.fit_standard(df, ["c_acctbal"])
    scaled = scale.standard_scale(df, state, ["c_acctbal"])
    return rounded(scale.inverse_standard(scaled, state, ["c_acctbal"]), ["c_acctbal"])


@query("""with q as (select quantile_cont(c_acctbal, 0.25) a1, quantile_cont(c_acctbal, 0.5) a2, quantile_cont(c_acctbal, 0.75) a3,
       quantile_cont(c_nationkey::double, 0.25) b1, quantile_cont(c_nationkey::double, 0.5) b2, quantile_cont(c_nationkey::double, 0.75) b3 from customer)
select c_custkey, round((c_acctbal - a2) / (a3 - a1), 6) + 0.0 as c_acctbal,
       round((c_nationkey - b2) / (b3 - b1), 6) + 0.0 as c_nationkey, cast(0.0 as double) as flat from customer, q""")
def robust_scale(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.lit(2.0).alias("flat"))
    names = ["c_acctbal", "c_nationkey", "flat"]
    return rounded(scale.robust_scale(df, scale.fit_robust(df, names), names), names)


@query("""with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) a1, quantile_cont(l_extendedprice, 0.5) a2,
              quantile_cont(l_extendedprice, 0.75) a3 from lineitem group by 1)
select l_returnflag, count(*) as n, round(min((l_extendedprice - a2) / (a3 - a1)), 6) + 0.0 as low,
       round(max((l_extendedprice - a2) / (a3 - a1)), 6) + 0.0 as high
from lineitem join q using (l_returnflag) group by 1""")
def robust_scale_by_group(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    by, names = ["l_returnflag"], ["l_extendedprice"]
    z = scale.robust_scale(df, scale.fit_robust(df, names, by), names, by)
    out = z.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )
    return rounded(out, ["low", "high"])


@query("""with m as (select avg(p_size) a1, stddev_pop(p_size) b1, avg(p_retailprice) a2, stddev_pop(p_retailprice) b2 from part),
l as (select p_partkey, ln(1 + abs((p_size - a1) / b1)) l1, ln(1 + abs((p_retailprice - a2) / b2)) l2 from part, m),
n as (select avg(l1) a1, stddev_pop(l1) b1, avg(l2) a2, stddev_pop(l2) b2 from l)
select p_partkey, round_even((l1 - a1) / b1, 3) + 0.0 as p_size, round_even((l2 - a2) / b2, 3) + 0.0 as p_retailprice from l, n""")
def log_normalise(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    names = ["p_size", "p_retailprice"]
    out = scale.log_normalise(df, scale.fit_log_normal(df, names), names)
    return out.select("p_partkey", *[(F.col(c) + F.lit(0.0)).alias(c) for c in names])
