"""Dataset profiles and quality reports; a dataset is one of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.catalog.base import events_inf, orders_nulls, query, rounded, table
from foldloom.operators import columns, gram, profile, profiles
from foldloom.sources.folds import metadata

# table -> (numeric features, other features, target)
SETS = {
    "orders": (["o_custkey"], ["o_orderstatus", "o_orderpriority", "o_orderdate"], "o_totalprice"),
    "customer": (["c_custkey", "c_nationkey"], ["c_name", "c_mktsegment"], "c_acctbal"),
    "part": (["p_partkey", "p_size"], ["p_name", "p_brand", "p_type"], "p_retailprice"),
    "lineitem": (
        ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus", "l_shipdate"],
        "l_extendedprice",
    ),
    "events": (["user_id"], ["ts", "event_type", "props"], "value"),
    "documents": (["doc_id"], ["lang", "source"], "n_chars"),
}


def dataset(spark, sf: str, name: str) -> DataFrame:
    numeric, other, target = SETS[name]
    return table(spark, sf, name).select(*numeric, *other, target)


def _stack(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _union(sqls) -> str:
    return "\nunion all\n".join(sqls)


def _shape_sql(name: str) -> str:
    numeric, other, _ = SETS[name]
    p = len(numeric) + len(other)
    missing = " + ".join(f"count(*) filter (where {c} is null)" for c in [*numeric, *other])
    return f"""select '{name}' as dataset, count(*) as n_samples, {p}::bigint as n_features, {len(other)}::bigint as n_categorical,
  {len(numeric)}::bigint as n_numerical, round(({missing})::double / (count(*) * {p}), 9) as missing_ratio from {name}"""


@query(_union(_shape_sql(n) for n in SETS))
def meta_shapes(spark, sf):
    parts = [profile.shapes(dataset(spark, sf, n), n, [SETS[n][2]]) for n in SETS]
    return rounded(_stack(parts), ["missing_ratio"], 9)


def _entropy_sql(name: str) -> str:
    numeric = SETS[name][0]
    cols = _union(f"select '{c}' as c, {c}::double as x from {name}" for c in numeric)
    return f"""select '{name}' as dataset, round(sum(h) / {len(numeric)}, 8) + 0.0 as feature_entropy from (
  select c, -sum(n / t * log2(n / t)) as h from (
    select c, b, count(*)::double as n, sum(count(*)) over (partition by c)::double as t from (
      select c, least(9, floor((x - lo) / (case when hi = lo then 1 else (hi - lo) / 10 end))) as b
      from ({cols}) v join (select c, min(x) as lo, max(x) as hi from ({cols}) group by 1) using (c)) group by 1, 2) group by 1)"""


@query(_union(_entropy_sql(n) for n in SETS))
def meta_entropy(spark, sf):
    parts = [profile.entropy(dataset(spark, sf, n), n, SETS[n][0]) for n in SETS]
    return rounded(_stack(parts), ["feature_entropy"], 8)


def _moments_sql(name: str) -> str:
    numeric = SETS[name][0]
    n = len(numeric)
    skew = " + ".join(f"skewness({c})" for c in numeric)
    kurt = " + ".join(f"kurtosis({c})" for c in numeric)
    return f"select '{name}' as dataset, round(({skew}) / {n}, 5) + 0.0 as skewness_mean, round(({kurt}) / {n}, 5) + 0.0 as kurtosis_mean from {name}"


@query(_union(_moments_sql(n) for n in SETS))
def meta_moments(spark, sf):
    parts = [profile.moments(dataset(spark, sf, n), n, SETS[n][0]) for n in SETS]
    return rounded(_stack(parts), ["skewness_mean", "kurtosis_mean"], 5)


def _corr_sql(name: str) -> str:
    numeric = SETS[name][0]
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    if not pairs:
        return f"select '{name}' as dataset, 0.0::double as correlation_mean, 0.0::double as correlation_std"
    rows = _union(f"select corr({a}::double, {b}::double) as r from {name}" for a, b in pairs)
    return f"select '{name}' as dataset, round(avg(r), 8) + 0.0 as correlation_mean, round(stddev_pop(r), 8) + 0.0 as correlation_std from ({rows})"


@query(_union(_corr_sql(n) for n in SETS))
def meta_correlation(spark, sf):
    parts = [profile.correlations(dataset(spark, sf, n), n, SETS[n][0]) for n in SETS]
    return rounded(_stack(parts), ["correlation_mean", "correlation_std"], 8)


@query("""with e as (
  select vec_id, i, case when (vec_id + i) % 7 <> 0 then embedding[i]::double end as x
  from embeddings, unnest(range(1, 26)) as t(i))
select a.i::integer as i, b.i::integer as j, round(corr(a.x, b.x), 8) + 0.0 as r
from e a join e b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i""")
def wide_correlations(spark, sf):
    """Correlations of every two of 25 columns with gaps, by the form for wide frames: one scan."""
    vectors = table(spark, sf, "embeddings")
    cells = [
        F.when((F.col("vec_id") + i) % 7 != 0, F.col("embedding")[i - 1].cast("double")).alias(f"x{i}") for i in range(1, 26)
    ]
    rows = gram.correlation_rows(vectors.select(*cells), [f"x{i}" for i in range(1, 26)])
    pairs = rows.select((F.col("i") + 1).alias("i"), F.posexplode("r").alias("at", "r"))
    return rounded(pairs.select("i", (F.col("i") + F.col("at") + 1).cast("int").alias("j"), "r"), ["r"], 8)


def _meta_sql(name: str) -> str:
    return f"""select s.*, e.feature_entropy, v.target_variance, c.correlation_mean, c.correlation_std, m.skewness_mean, m.kurtosis_mean,
  round(3.0 / s.n_features, 9) as fe_impact_score
from ({_shape_sql(name)}) s join ({_entropy_sql(name)}) e using (dataset)
join (select '{name}' as dataset, round(var_pop({SETS[name][2]}::double) / 1e6, 5) as target_variance from {name}) v using (dataset)
join ({_corr_sql(name)}) c using (dataset) join ({_moments_sql(name)}) m using (dataset)"""


@query(_union(_meta_sql(n) for n in SETS))
def meta_features(spark, sf):
    """All twelve meta-features per dataset (variance in millions)."""
    parts = []
    for n, (numeric, other, target) in SETS.items():
        p = len(numeric) + len(other)
        # the engineered frame is taken as three derived columns wider
        parts.append(profile.profile(dataset(spark, sf, n), n, target, p + 3))
    return _meta_rounded(_stack(parts))


@query(_union(_meta_sql(n) for n in SETS))
def meta_features_grouped(spark, sf):
    """The same rows from scans that all datasets share."""
    frames = {n: (dataset(spark, sf, n), target) for n, (_, _, target) in SETS.items()}
    rows, widths = profiles.profile_rows(frames, {n: len(a) + len(b) + 3 for n, (a, b, _) in SETS.items()})
    return _meta_rounded(profiles.profiles(rows, widths))


def _meta_rounded(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("target_variance", F.col("target_variance") / 1e6)
    out = rounded(out, ["fe_impact_score"], 9)
    out = rounded(out, ["missing_ratio"], 9)
    out = rounded(out, ["target_variance", "skewness_mean", "kurtosis_mean"], 5)
    return rounded(out, ["feature_entropy", "correlation_mean", "correlation_std"], 8)


def _report_sql(task: str, frame: str, numeric: list[str], p: int) -> str:
    missing = " + ".join(f"count(*) filter (where {c} is null)" for c in numeric)
    infinite = " + ".join(f"count(*) filter (where isinf({c}::double))" for c in numeric)
    return f"""select cast({frame}.fold as integer) as fold, '{task}' as task, count(*) as samples, {p}::bigint as features,
  cast({missing} as bigint) as missing, cast({infinite} as bigint) as infinite from {frame} group by 1"""


_INJECTED = """
ev as (select event_id % 10 as fold, case when event_id % 11 = 0 then 'infinity'::double when event_id % 13 = 0 then '-infinity'::double
         when event_id % 17 = 0 then null else value end as value, user_id from events),
od as (select o_orderkey % 10 as fold, case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice, o_custkey from orders),
pt as (select p_partkey % 10 as fold, p_size, p_retailprice from part)
"""
_REPORT = "with " + _INJECTED + ", report as (" + _union(
    [
        _report_sql("events", "ev", ["value", "user_id"], 2),
        _report_sql("orders", "od", ["o_totalprice", "o_custkey"], 2),
        _report_sql("part", "pt", ["p_size", "p_retailprice"], 2),
    ]
) + ")"


def _reports(spark, sf):
    events = events_inf(spark, sf).join(
        table(spark, sf, "events").select("event_id", "user_id"), "event_id"
    ).select((F.col("event_id") % 10).cast("int").alias("fold"), "value", "user_id")
    keys = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    orders = orders_nulls(spark, sf).join(keys, "o_orderkey").select(
        (F.col("o_orderkey") % 10).cast("int").alias("fold"), "o_totalprice", "o_custkey"
    )
    part = table(spark, sf, "part").select(
        (F.col("p_partkey") % 10).cast("int").alias("fold"), "p_size", "p_retailprice"
    )
    frames = {"events": events, "orders": orders, "part": part}
    return _stack([profile.quality_report(df, n, by=["fold"]) for n, df in frames.items()])


@query(_REPORT + " select * from report")
def quality_report(spark, sf):
    return _reports(spark, sf)


@query(_REPORT + " select * from report where missing > 0 or infinite > 0")
def quality_issues(spark, sf):
    return profile.quality_issues(_reports(spark, sf))


@query(_REPORT + """ select task, round_even(avg(features), 2) as original_features, round_even(avg(features + 3), 2) as engineered_features,
  round_even(avg((features + 3) / features::double), 2) as expansion_ratio, round_even(avg(samples), 2) as samples, count(fold) as folds
from report group by 1""")
def quality_summary(spark, sf):
    """Original against engineered reports (three derived columns more), averaged per task."""
    report = _reports(spark, sf)
    engineered = report.withColumn("features", F.col("features") + 3)
    compared = profile.compare_versions(report, engineered)
    return profile.quality_summary(
        compared, ["original_features", "engineered_features", "expansion_ratio", "samples"]
    )


@query(f"""with s as ({_union(_shape_sql(n) for n in SETS)})
select max(n_features) as max_features, (select dataset from s order by n_samples desc, dataset limit 1) as largest_dataset from s""")
def largest_dataset(spark, sf):
    parts = [profile.shapes(dataset(spark, sf, n), n, [SETS[n][2]]) for n in SETS]
    return profile.largest_dataset(_stack(parts))


@query("""with s as (select o_custkey % 400 as dataset, count(*) as n_samples, (o_custkey % 400) % 3 <> 0 as numeric_target from orders group by 1)
select dataset, n_samples from s where n_samples >= 20 and numeric_target""")
def accepted_datasets(spark, sf):
    """Datasets with enough rows and a numeric target."""
    key = F.col("o_custkey") % 400
    sets = table(spark, sf, "orders").groupBy(key.alias("dataset")).agg(F.count(F.lit(1)).alias("n_samples"))
    flagged = sets.withColumn("numeric_target", F.col("dataset") % 3 != 0)
    return profile.acceptable(flagged, 20).select("dataset", "n_samples")


@query("select count(distinct quality) as classes from labels")
def class_count(spark, sf):
    return profile.class_count(table(spark, sf, "labels"), "quality")


@query("""select 'orders' as name, count(*) as n_samples, 4 as n_features, 'o_totalprice' as target_name,
  'o_custkey,o_orderstatus,o_orderpriority,o_orderdate' as feature_names, 10 as n_folds from orders""")
def dataset_metadata(spark, sf):
    numeric, other, target = SETS["orders"]
    row = metadata(dataset(spark, sf, "orders"), "orders", [*numeric, *other], target, 10)
    return row.withColumn("feature_names", F.concat_ws(",", "feature_names"))


@query(_union(f"select '{n}' as dataset, {len(SETS[n][0])}::bigint as numeric_columns, (select count(*) from {n}) as n_rows" for n in SETS))
def column_kinds(spark, sf):
    """Column typing from the schema, next to the row count of each table."""
    parts = []
    for n in SETS:
        df = dataset(spark, sf, n)
        kinds = columns.column_kinds(df, [SETS[n][2]])
        parts.append(df.agg(
            F.lit(n).alias("dataset"), F.lit(len(kinds.numeric)).cast("long").alias("numeric_columns"),
            F.count(F.lit(1)).alias("n_rows"),
        ))
    return _stack(parts)
