"""Derived features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from foldloom.catalog.base import digits, query, rounded, table
from foldloom.operators import columns, derive, hyperparams
from foldloom.plans import features as fe
from foldloom.sources.synthetic import coefficient, synthetic_regression

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""with x as (select *, (l_quantity + l_extendedprice + l_discount + l_tax) / 4 as m from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(m, 4) + 0.0 as row_mean,
  round(sqrt((pow(l_quantity - m, 2) + pow(l_extendedprice - m, 2) + pow(l_discount - m, 2) + pow(l_tax - m, 2)) / 3), 4) + 0.0 as row_std,
  round(greatest(l_quantity, l_extendedprice, l_discount, l_tax), 4) + 0.0 as row_max,
  round(least(l_quantity, l_extendedprice, l_discount, l_tax), 4) + 0.0 as row_min,
  round(greatest(l_quantity, l_extendedprice, l_discount, l_tax) - least(l_quantity, l_extendedprice, l_discount, l_tax), 4) + 0.0 as row_range
from x""")
def row_stats(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE)
    return rounded(derive.with_row_stats(df, LINE).drop(*LINE), derive.ROW_STATS, 4)


def _pairs_sql() -> str:
    cells = []
    for a, b in combinations(LINE, 2):
        cells += [
            f"round({a} + {b}, 4) + 0.0 as {a}_plus_{b}",
            f"round({a} * {b}, 4) + 0.0 as {a}_mult_{b}",
            f"round({a} - {b}, 4) + 0.0 as {a}_minus_{b}",
            f"round({a} / ({b} + 1e-8), 0) + 0.0 as {a}_div_{b}",
        ]
    return f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(cells)} from lineitem"


@query(_pairs_sql())
def pair_interactions(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = table(spark, sf, "lineitem").select(*keys, *LINE)
    made = derive.pair_features(LINE, minus=True)
    out = derive.derive(df, made)
    return out.select(*keys, *[digits(c, 0 if "_div_" in c else 4).alias(c) for c in made])


@query("""select c_custkey, round(sqrt(c_nationkey), 6) as c_nationkey_sqrt, round(ln(1 + c_nationkey), 6) as c_nationkey_log,
  round((c_nationkey * c_nationkey)::double, 6) + 0.0 as c_nationkey_squared, round(abs(c_nationkey)::double, 6) + 0.0 as c_nationkey_abs,
  round(c_acctbal * c_acctbal, 4) as c_acctbal_squared, round(abs(c_acctbal), 6) as c_acctbal_abs from customer""")
def unary_features(spark, sf):
    names = ["c_nationkey", "c_acctbal"]
    df = table(spark, sf, "customer").select("c_custkey", *names)
    minimum = derive.fit_minimum(df, names).first().asDict()
    out = derive.derive(df, derive.unary_features(names, minimum)).drop(*names)
    made = [c for c in out.columns if c != "c_custkey"]
    return out.select("c_custkey", *[digits(c, 4 if c == "c_acctbal_squared" else 6).alias(c) for c in made])


@query("""select p_partkey, round((p_size * p_size)::double, 4) + 0.0 as p_size_poly_p_size, round(p_retailprice * p_retailprice, 4) as p_retailprice_poly_p_retailprice,
  round(p_size * p_retailprice, 4) as p_size_poly_p_retailprice, round((p_size + p_retailprice) / 2, 4) as row_median from part""")
def polynomial_features(spark, sf):
    names = ["p_size", "p_retailprice"]
    df = table(spark, sf, "part").select("p_partkey", *names)
    made = {**derive.polynomial_features(names), "row_median": derive.row_median(names)}
    out = derive.derive(df, made)
    return out.select("p_partkey", *[digits(c, 4).alias(c) for c in made])


@query("""with l as (select min(p_retailprice) lo, max(p_retailprice) hi from part)
select p_partkey, cast(least(4, floor((p_retailprice - lo) / ((hi - lo) / 5))) as integer) as price_bin from part, l""")
def equal_width_bins(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return derive.equal_width_bins(df, "p_retailprice", "price_bin", 5).select("p_partkey", "price_bin")


@query("""select p_partkey, cast(ntile(5) over (order by p_retailprice, p_partkey) as integer) as price_bin from part""")
def equal_freq_bins(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return derive.assign_tiles(df, ["p_retailprice", "p_partkey"], 5, "price_bin").select("p_partkey", "price_bin")


def _orders_customer(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey", "c_mktsegment"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    # read by every fit below
    return orders.join(customer, "o_custkey").drop("o_custkey").persist()


def _manual_sql() -> str:
    numeric, categorical = ["c_acctbal", "c_nationkey"], ["o_orderpriority", "c_mktsegment"]
    engineered = {
        "row_mean": "(c_acctbal + c_nationkey) / 2",
        "row_std": "abs(c_acctbal - c_nationkey) / sqrt(2)",
        "row_max": "greatest(c_acctbal, c_nationkey)",
        "row_min": "least(c_acctbal, c_nationkey)",
        "row_range": "abs(c_acctbal - c_nationkey)",
        "c_acctbal_plus_c_nationkey": "c_acctbal + c_nationkey",
        "c_acctbal_mult_c_nationkey": "c_acctbal * c_nationkey",
        "c_acctbal_div_c_nationkey": "c_acctbal / (c_nationkey + 1e-8)",
        "c_acctbal_squared": "c_acctbal * c_acctbal",
        "c_acctbal_abs": "abs(c_acctbal)",
        "c_nationkey_sqrt": "sqrt(c_nationkey)",
        "c_nationkey_log": "ln(1 + c_nationkey)",
        "c_nationkey_squared": "c_nationkey * c_nationkey",
        "c_nationkey_abs": "abs(c_nationkey)",
    }
    cells = [f"cast({c} as double) as {c}" for c in numeric]
    cells += [f"cast({e} as double) as {n}" for n, e in engineered.items()]
    joins, names = [], [*numeric, *engineered]
    for c in categorical:
        cells += [f"cast({c}_t.code as double) as {c}", f"{c}_t.m as {c}_target_mean",
                  f"cast({c}_t.n as double) / (select count(*) from x where o_orderkey % 10 <> 0) as {c}_freq"]
        names += [c, f"{c}_target_mean", f"{c}_freq"]
        joins.append(
            f"join (select {c} as v, row_number() over (order by {c}) - 1 as code, avg(o_totalprice) as m, count(*) as n "
            f"from x where o_orderkey % 10 <> 0 group by {c}) {c}_t on {c}_t.v = x.{c}"
        )
    quartiles = ", ".join(f"quantile_cont({n}, [0.25, 0.5, 0.75]) as q_{n}" for n in names)
    scaled = ", ".join(
        f"round(({n} - q_{n}[2]) / (case when q_{n}[3] - q_{n}[1] = 0 then 1 else q_{n}[3] - q_{n}[1] end), 5) + 0.0 as {n}"
        for n in names
    )
    return f"""with x as (select o_orderkey, o_totalprice, o_orderpriority, c_acctbal, c_nationkey, c_mktsegment
      from orders join customer on o_custkey = c_custkey),
e as (select x.o_orderkey, x.o_totalprice, {', '.join(cells)} from x {' '.join(joins)}),
q as (select {quartiles} from e where o_orderkey % 10 <> 0)
select o_orderkey, o_totalprice, {scaled} from e, q"""


@query(_manual_sql())
def manual_features(spark, sf):
    df = _orders_customer(spark, sf).select(
        "o_orderkey", "c_acctbal", "c_nationkey", "o_orderpriority", "c_mktsegment", "o_totalprice"
    )
    # fitted on the training rows, applied to all rows
    fitted = fe.fit_manual_features(df.filter(F.col("o_orderkey") % 10 != 0), "o_totalprice", ["o_orderkey"])
    return rounded(fitted.transform(df), fitted.names, 5)


@query("""select cast(4 as bigint) as original, cast(5 as bigint) as statistical, cast(3 as bigint) as interactions,
  cast(6 as bigint) as transformations, cast(4 as bigint) as categorical,
  cast(4 + 5 + 3 + 6 + 4 as bigint) as total, (select count(*) from orders) as n_rows""")
def feature_categories(spark, sf):
    df = _orders_customer(spark, sf).select(
        "o_orderkey", "c_acctbal", "c_nationkey", "o_orderpriority", "c_mktsegment", "o_totalprice"
    )
    fitted = fe.fit_manual_features(df, "o_totalprice", ["o_orderkey"])
    out = fitted.transform(df)
    counts = derive.feature_categories(
        df, fitted.names, ["c_acctbal", "c_nationkey", "o_orderpriority", "c_mktsegment"]
    )
    return counts.withColumn("n_rows", F.lit(out.count()).cast("long"))


@query()
def auto_features(spark, sf):
    """Originals plus one unary step, kept by importance."""
    df = _orders_customer(spark, sf).select("o_orderkey", "c_acctbal", "c_nationkey", "o_totalprice")
    fitted = fe.fit_auto_features(df, "o_totalprice", ["o_orderkey"])
    return fitted.transform(df)


@query("""with u as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
select vec_id, round(v[1], 6) + 0.0 as cut_first, round(v[50], 6) + 0.0 as cut_last, cast(50 as integer) as cut_size,
       cast(0.0 as double) as pad_last, cast(80 as integer) as pad_size, round(v[64], 6) + 0.0 as pad_kept from u""")
def pad_truncate(spark, sf):
    df = table(spark, sf, "embeddings")
    cut, pad = columns.pad_vector(F.col("embedding"), 50), columns.pad_vector(F.col("embedding"), 80)
    both = df.select("vec_id", cut.alias("cut"), pad.alias("pad"))
    return both.select(
        "vec_id", digits(F.col("cut")[0]).alias("cut_first"), digits(F.col("cut")[49]).alias("cut_last"),
        F.size("cut").alias("cut_size"), F.col("pad")[79].alias("pad_last"), F.size("pad").alias("pad_size"),
        digits(F.col("pad")[63]).alias("pad_kept"),
    )


# Event types of the log read as searched algorithms.
ALGORITHM_OF = {
    "click": "random_forest", "view": "gradient_boosting", "purchase": "xgboost",
    "signup": "knn", "error": "ridge",
}


def _space_values() -> str:
    rows = []
    for event, algorithm in ALGORITHM_OF.items():
        for i, (hp, kind, *rest) in enumerate(hyperparams.SEARCH_SPACES[algorithm]):
            if kind == "choice":
                choices = "[" + ", ".join(f"'{c}'" for c in rest[0]) + "]"
                rows.append(f"('{event}', '{algorithm}', {i}, '{hp}', '{kind}', 0.0::double, 0.0::double, {choices})")
            else:
                rows.append(f"('{event}', '{algorithm}', {i}, '{hp}', '{kind}', {rest[0]}::double, {rest[1]}::double, NULL::varchar[])")
    return ", ".join(rows)


@query(f"""with s(event_type, algorithm, position, hp, kind, lo, hi, choices) as (values {_space_values()}),
d as (select event_id as trial, s.*, (((event_id % 10007) * 7919 + position * 104729) % 10007) / 10007.0::double as u
      from events join s using (event_type))
select trial, algorithm, hp, round(case kind when 'int' then floor(lo + u * (hi - lo + 1))
         when 'log' then exp(ln(lo) + u * (ln(hi) - ln(lo))) when 'float' then lo + u * (hi - lo) end, 9) as number,
       case when kind = 'choice' then choices[cast(floor(u * len(choices)) as bigint) + 1] end as choice from d
""".replace("exp(ln(lo)", "exp(ln(greatest(lo, 1e-12))").replace("(ln(hi) - ln(lo))", "(ln(greatest(hi, 1e-12)) - ln(greatest(lo, 1e-12)))"))
def trial_candidates(spark, sf):
    pairs = spark.createDataFrame(list(ALGORITHM_OF.items()), "event_type string, algorithm string")
    trials = table(spark, sf, "events").select(F.col("event_id").alias("trial"), "event_type").join(
        pairs, "event_type").drop("event_type")
    drawn = hyperparams.candidates(trials, hyperparams.space_table(spark))
    return drawn.select("trial", "algorithm", "hp", F.round("number", 9).alias("number"), "choice")


def _unit_sql(key: str, salt: int) -> str:
    x = f"(({key}::bigint % 2147483647 + {salt * 7919 + 1}) % 2147483647)"
    x = f"(({x} * {x} + {x} * 48271) % 2147483647)"
    x = f"(({x} * {x} + {x} * 16807 + {salt}) % 2147483647)"
    return f"({x} + 0.5::double) / 2147483647.0::double"


def _normal_sql(key: str, salt: int) -> str:
    return f"sqrt(-2.0::double * ln({_unit_sql(key, 2 * salt + 1)})) * cos(2 * pi() * ({_unit_sql(key, 2 * salt + 2)}))"


def _synthetic_sql() -> str:
    cells = ", ".join(f"{_normal_sql('o_orderkey', 42 + j)} as feature_{j}" for j in range(5))
    target = " + ".join(f"{coefficient(j, 42)!r}::double * feature_{j}" for j in range(3))
    return f"""with x as (select o_orderkey as row_id, {cells}, {_normal_sql('o_orderkey', 1042)} as noise from orders)
select row_id, {', '.join(f'round(feature_{j}, 5) + 0.0 as feature_{j}' for j in range(5))},
       round(1.5 + {target} + 0.2 * noise, 4) + 0.0 as target from x"""


@query(_synthetic_sql())
def synthetic_regression_rows(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    out = synthetic_regression(keys, "o_orderkey", features=5, informative=3, noise=0.2, bias=1.5)
    return out.select("row_id", *[digits(f"feature_{j}", 5).alias(f"feature_{j}") for j in range(5)],
                      digits("target", 4).alias("target"))
