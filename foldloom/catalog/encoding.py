"""Categorical encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.catalog.base import FOLDED_ORDERS, digits, query, rounded, table
from foldloom.functions.text import clean_name as clean_name_expr
from foldloom.operators import encode, folds


@query("""select event_id, event_type, cast(dense_rank() over (order by event_type) - 1 as integer) as code from events""")
def label_encode(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return encode.encode(df, encode.fit_categories(df, ["event_type"]), "event_type", label="code")


def _split(spark, sf):
    """Orders; in the test part (keys ending in 0) some priorities are new."""
    key = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(key % 50 == 0, F.lit("zz_new")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return df.filter(key % 10 != 0), df.filter(key % 10 == 0)


SPLIT = """
x as (select o_orderkey, o_totalprice,
             case when o_orderkey % 50 = 0 then 'zz_new' else o_orderpriority end as p from orders),
train as (select * from x where o_orderkey % 10 <> 0),
test as (select * from x where o_orderkey % 10 = 0),
cats as (select p, count(*) as n, avg(o_totalprice) as m, row_number() over (order by p) - 1 as code from train group by p)
"""


@query(f"""with {SPLIT},
u as (select p, row_number() over (order by p) - 1 as code from (select distinct p from x))
select o_orderkey, cast(code as integer) as code from test join u using (p)""")
def label_encode_union(spark, sf):
    train, test = _split(spark, sf)
    known = encode.fit_categories(train, ["o_orderpriority"], also=test)
    return encode.encode(test, known, "o_orderpriority", label="code").select("o_orderkey", "code")


@query(f"""with {SPLIT}
select o_orderkey, cast(coalesce(code, (select code from cats order by n desc, p limit 1)) as integer) as mode_code,
       cast(coalesce(code, 0) as integer) as first_code
from test left join cats using (p)""")
def label_encode_unseen(spark, sf):
    train, test = _split(spark, sf)
    known = encode.fit_categories(train, ["o_orderpriority"])
    out = encode.encode(test, known, "o_orderpriority", label="mode_code", unseen="mode")
    out = encode.encode(out, known, "o_orderpriority", label="first_code", unseen="first")
    return out.select("o_orderkey", "mode_code", "first_code")


@query(f"""with {SPLIT} select distinct p as o_orderpriority from test where p not in (select p from train)""")
def unseen_categories(spark, sf):
    train, test = _split(spark, sf)
    return encode.unseen_categories(train, test, "o_orderpriority")


@query(f"""with {SPLIT}
select o_orderkey, round(coalesce(m, (select avg(o_totalprice) from train)), 3) as priority_target_mean
from x left join cats using (p)""")
def target_encode(spark, sf):
    train, test = _split(spark, sf)
    known = encode.fit_categories(train, ["o_orderpriority"], "o_totalprice")
    both = train.unionByName(test)
    out = encode.encode(both, known, "o_orderpriority", target_mean="priority_target_mean")
    return rounded(out.select("o_orderkey", "priority_target_mean"), ["priority_target_mean"], 3)


@query(f"""with {FOLDED_ORDERS},
p as (select o_orderpriority, fold, sum(o_totalprice) as s, count(*) as n from folded group by 1, 2),
t as (select o_orderpriority, sum(s) as s, sum(n) as n from p group by 1)
select o_orderkey, o_orderpriority, fold, round((t.s - p.s) / (t.n - p.n), 3) as oof_mean
from folded join p using (o_orderpriority, fold) join t using (o_orderpriority)""")
def target_encode_oof(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    folded = folds.shuffled_kfold(df, "o_orderkey", 10)
    out = encode.out_of_fold_target_encode(folded, "o_orderpriority", "o_totalprice", "fold", "oof_mean")
    return rounded(out.select("o_orderkey", "o_orderpriority", "fold", "oof_mean"), ["oof_mean"], 3)


@query("""with c as (select p_brand, count(*) as n from part group by 1)
select p_partkey, p_brand, round(n / (select count(*) from part), 8) as p_brand_freq from part join c using (p_brand)""")
def frequency_encode(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    out = encode.encode(df, encode.fit_categories(df, ["p_brand"]), "p_brand", frequency="p_brand_freq")
    return out.select("p_partkey", "p_brand", digits("p_brand_freq", 8).alias("p_brand_freq"))


@query("""with b as (select p_brand, count(*) as n from part group by 1), t as (select p_type, count(*) as n from part group by 1)
select p_partkey, b.n as p_brand_count, t.n as p_type_count from part join b using (p_brand) join t using (p_type)""")
def count_encode(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    known = encode.fit_categories(df, ["p_brand", "p_type"])
    for c in ("p_brand", "p_type"):
        df = encode.encode(df, known, c, count=f"{c}_count")
    return df.select("p_partkey", "p_brand_count", "p_type_count")


@query("""select c_custkey, cast(dense_rank() over (order by c_name) - 1 as integer) as code from customer""")
def label_encode_many(spark, sf):
    """A category per row: the state is as large as the table, nothing relies on it being small."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    known = encode.fit_categories(df, ["c_name"])
    return encode.encode(df, known, "c_name", label="code").select("c_custkey", "code")


@query("""select distinct o_orderstatus as value, cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as target from orders""")
def class_target_codes(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus")
    known = encode.fit_categories(df, ["o_orderstatus"])
    return known.of("o_orderstatus").table.select(
        F.col("key").alias("value"), F.col("code").alias("target")
    )


@query(r"""select c_custkey,
  trim(regexp_replace(regexp_replace(lower(regexp_replace(c_name || ' -- ' || c_mktsegment || '__', '[^\p{L}\p{N}_-]', '', 'g')), '_+', '_', 'g'), '-+', '-', 'g'), '_-') as name
from customer""")
def clean_name(spark, sf):
    df = table(spark, sf, "customer")
    raw = F.concat(F.col("c_name"), F.lit(" -- "), F.col("c_mktsegment"), F.lit("__"))
    return df.select("c_custkey", clean_name_expr(raw).alias("name"))
