"""Exact order statistics without a global sort or a single-task percentile.

``percentile`` keeps every distinct value of a group in memory of one task and
``ntile() over (order by ...)`` moves a whole table to one task.  Both are
answered here by *rank selection*: histogram the interval that contains the
wanted rank, keep the bucket the rank falls into, repeat.  Every pass is a scan
with a map-side combined count (at most ``BUCKETS`` rows per interval leave a
task); nothing is sorted and no row moves.  Once an interval holds no more than
``SMALL_INTERVAL`` rows it is read off exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions import sql
from foldloom.operators.columns import melt
from foldloom.operators.state import settle

BUCKETS = 4096
SMALL_INTERVAL = 500_000
SMALL_CELLS = 500_000
HOT_GROUP_ROWS = 5_000_000
CASE_INTERVALS = 32
MAX_DOUBLE = 1.7976931348623157e308


def _tag(df: DataFrame, by: Sequence[str], key: str, intervals: list[dict]) -> DataFrame:
    """Rows that lie in some interval, with that interval's ``lo, span, half, kind, iid``."""
    spark = df.sparkSession
    key_type = df.schema[key].dataType
    fields = [df.schema[c] for c in by]
    schema = T.StructType(
        [
            *[T.StructField("__g_" + f.name, f.dataType) for f in fields],
            T.StructField("__iid", T.IntegerType()),
            T.StructField("__lo", key_type),
            T.StructField("__hi", key_type),
            T.StructField("__half", T.DoubleType()),
            T.StructField("__span", T.DoubleType()),
            T.StructField("__kind", T.IntegerType()),
        ]
    )
    rows = [
        (*i["group"], n, i["lo"], i["hi"], i["half"], i["span"], i["kind"])
        for n, i in enumerate(intervals)
    ]
    x = F.col(key)
    if not by and len(rows) <= CASE_INTERVALS:
        pick = None
        for n, i in enumerate(intervals):
            hit = x.between(F.lit(i["lo"]).cast(key_type), F.lit(i["hi"]).cast(key_type))
            info = F.struct(
                F.lit(n).alias("__iid"),
                F.lit(i["lo"]).cast(key_type).alias("__lo"),
                F.lit(i["half"]).alias("__half"),
                F.lit(i["span"]).alias("__span"),
                F.lit(i["kind"]).alias("__kind"),
            )
            pick = F.when(hit, info) if pick is None else pick.when(hit, info)
        tagged = df.select(key, pick.alias("__i")).filter(F.col("__i").isNotNull())
        return tagged.select(key, "__i.*")
    table = spark.createDataFrame(rows, schema)
    match = x.between(F.col("__lo"), F.col("__hi"))
    for c in by:
        match = match & (F.col(c) == F.col("__g_" + c))
    # one row per live interval: bounded by (groups asked for) x (ranks asked for)
    return df.select(*by, key).join(F.broadcast(table), match, "inner").select(
        key, "__iid", "__lo", "__half", "__span", "__kind"
    )


LINEAR, LOG_POSITIVE, LOG_NEGATIVE, SIGN = range(4)
WIDE_RATIO = 1_000


def _bucket(key: str) -> Column:
    """Monotone bucket of a value inside its interval; the two ends never share one."""
    x, lo = F.col(key), F.col("__lo")
    linear = (x * F.col("__half") - lo * F.col("__half")) / F.col("__span")
    logs = (F.ln(F.abs(x)) - F.ln(F.abs(lo))) / F.col("__span")
    share = F.when(F.col("__kind") == LINEAR, linear).otherwise(logs)
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    return F.when(F.col("__kind") == SIGN, F.signum(x) + 1).otherwise(bucket).cast("int")


def _interval(group: tuple, lo, hi, below: int, rows: int, ranks: list[int], poor: bool) -> dict:
    """Interval with its bucket rule: log-spaced over a wide range of one sign, else equal width.

    Around zero the signs are separated first when equal widths barely helped.
    """
    half, span, kind = 1.0, 0.0, LINEAR
    if lo > 0 and hi / WIDE_RATIO > lo:
        kind, span = LOG_POSITIVE, math.log(hi) - math.log(lo)
    elif hi < 0 and lo / WIDE_RATIO < hi:
        kind, span = LOG_NEGATIVE, math.log(-hi) - math.log(-lo)
    elif lo <= 0 <= hi and poor:
        kind = SIGN
    if kind == LINEAR:
        if isinstance(lo, float) and math.isinf(hi - lo):
            half = 0.5
        span = float(hi * half - lo * half)
    # the span of a finished or sign interval is never used
    return dict(group=group, lo=lo, hi=hi, below=below, rows=rows, ranks=ranks,
                kind=kind, half=half, span=span or 1.0)


def _select_key(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    wanted: dict[tuple, list[int]] | None,
    ranks_of: Callable[[int], list[int]] | None,
    small: int,
) -> tuple[dict[tuple, int], dict[tuple, dict[int, tuple]]]:
    """Value at each wanted rank of ``key`` per group, with the count of smaller rows."""
    df = df.filter(F.col(key).isNotNull())
    if wanted is not None and by:
        keys = df.sparkSession.createDataFrame(
            list(wanted), T.StructType([df.schema[c] for c in by])
        )
        df = df.join(F.broadcast(keys), list(by), "left_semi")
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.min(key).alias("__lo"), F.max(key).alias("__hi")
    ).collect()
    sizes: dict[tuple, int] = {}
    found: dict[tuple, dict[int, tuple]] = {}
    live: list[dict] = []
    for row in stats:
        group = tuple(row[c] for c in by)
        n = row["__n"]
        sizes[group] = n
        if n == 0:
            continue
        ranks = sorted(set(wanted[group] if wanted is not None else ranks_of(n)))
        found[group] = {}
        if ranks:
            live.append(_interval(group, row["__lo"], row["__hi"], 0, n, ranks, False))
    while live:
        for i in live:
            if i["lo"] == i["hi"]:
                for r in i["ranks"]:
                    found[i["group"]][r] = (i["lo"], i["below"])
        live = [i for i in live if i["lo"] != i["hi"]]
        short = [i for i in live if i["rows"] <= small]
        if short:
            _read_off(df, by, key, short, found)
        live = [i for i in live if i["rows"] > small]
        if live:
            live = _narrow(df, by, key, live)
    return sizes, found


def _read_off(df, by, key, intervals, found) -> None:
    """Finish intervals that are small enough to hold in one task."""
    lists = (
        _tag(df, by, key, intervals)
        .groupBy("__iid")
        .agg(F.sort_array(F.collect_list(key)).alias("__v"))
    )
    spark = df.sparkSession
    asked = spark.createDataFrame(
        [(n, r - i["below"], r) for n, i in enumerate(intervals) for r in i["ranks"]],
        "__iid int, __at int, __rank long",
    )
    value = F.element_at("__v", F.col("__at"))
    picked = lists.join(F.broadcast(asked), "__iid").select(
        "__iid", "__rank", value.alias("__x"), (F.array_position("__v", value) - 1).alias("__less")
    )
    for row in picked.collect():
        i = intervals[row["__iid"]]
        found[i["group"]][row["__rank"]] = (row["__x"], i["below"] + row["__less"])


def _narrow(df, by, key, intervals) -> list[dict]:
    """One histogram pass: replace each interval by the buckets its ranks fall into."""
    hist = (
        _tag(df, by, key, intervals)
        .groupBy("__iid", _bucket(key).alias("__b"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    )
    # at most BUCKETS rows per interval
    upto = Window.partitionBy("__iid").orderBy("__b")
    asked = df.sparkSession.createDataFrame(
        [(n, r - i["below"], r) for n, i in enumerate(intervals) for r in i["ranks"]],
        "__iid int, __at long, __rank long",
    )
    chosen = (
        hist.withColumn("__upto", F.sum("__n").over(upto))
        .join(F.broadcast(asked), "__iid")
        .filter((F.col("__at") <= F.col("__upto")) & (F.col("__at") > F.col("__upto") - F.col("__n")))
        .collect()
    )
    merged: dict[tuple, list] = {}
    for row in chosen:
        merged.setdefault((row["__iid"], row["__b"]), []).append(row)
    result = []
    for (iid, _), rows in merged.items():
        old, row = intervals[iid], rows[0]
        result.append(
            _interval(
                old["group"], row["__lo"], row["__hi"],
                old["below"] + row["__upto"] - row["__n"], row["__n"],
                [r["__rank"] for r in rows],
                row["__n"] * 2 > old["rows"],
            )
        )
    return result


def _read_whole(df, order, ranks, by, small):
    """All groups at once when the largest is small; None otherwise."""
    counts = df.filter(F.col(order[0]).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    # no more than ``small`` groups of no more than ``small`` rows come back
    sizes_rows = counts.limit(small + 1).collect()
    sizes = {tuple(r[c] for c in by): r["__n"] for r in sizes_rows}
    if len(sizes) > small or any(n > small for n in sizes.values()):
        return None
    wanted = ranks if isinstance(ranks, dict) else {g: ranks(n) for g, n in sizes.items()}
    keys: dict[tuple, dict[int, tuple]] = {g: {} for g, n in sizes.items() if n and g in wanted}
    asked = [(*g, int(r)) for g in keys for r in sorted(set(wanted[g]))]
    if asked:
        fields = [df.schema[c] for c in by]
        table = df.sparkSession.createDataFrame(
            asked, T.StructType([*fields, T.StructField("__rank", T.IntegerType())])
        )
        lists = (
            df.filter(F.col(order[0]).isNotNull())
            .groupBy(*by)
            .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__v"))
        )
        if by:
            # a handful of ranks per group
            joined = lists.join(F.broadcast(table), by)
        else:
            joined = lists.select("__v", F.explode(F.array(*[F.lit(a[0]) for a in asked])).alias("__rank"))
        for row in joined.select(*by, "__rank", F.element_at("__v", F.col("__rank")).alias("__k")).collect():
            keys[tuple(row[c] for c in by)][row["__rank"]] = tuple(row["__k"])
    return sizes, keys


def select_ranks(
    df: DataFrame,
    order: Sequence[str],
    ranks: Callable[[int], list[int]] | dict[tuple, list[int]],
    by: Sequence[str] = (),
    small: int = SMALL_INTERVAL,
) -> tuple[dict[tuple, int], dict[tuple, dict[int, tuple]]]:
    """Key tuples at the wanted 1-based ranks of every group, in ``order``.

    ``ranks`` maps a group size to its ranks, or names the ranks of each group.

    ``order`` is compared lexicographically: the first column is selected, then
    the next one among the rows that tie on it.  Returns group sizes and
    ``{group: {rank: key_tuple}}``.
    """
    by = list(by)
    named = ranks if isinstance(ranks, dict) else None
    whole = _read_whole(df, order, ranks, by, small)
    if whole is not None:
        return whole
    sizes, first = _select_key(df, by, order[0], named, None if named else ranks, small)
    keys = {g: {r: (v,) for r, (v, _) in m.items()} for g, m in first.items()}
    rest = {g: {r: r - below for r, (_, below) in m.items()} for g, m in first.items()}
    for depth in range(1, len(order)):
        wanted: dict[tuple, list[int]] = {}
        for g, m in keys.items():
            for r, prefix in m.items():
                wanted.setdefault((*g, *prefix), []).append(rest[g][r])
        if not wanted:
            break
        _, found = _select_key(df, [*by, *order[:depth]], order[depth], wanted, None, small)
        for g, m in keys.items():
            for r, prefix in list(m.items()):
                value, below = found[(*g, *prefix)][rest[g][r]]
                m[r] = (*prefix, value)
                rest[g][r] -= below
    return sizes, keys


def _quantile_ranks(probs: Sequence[float]) -> Callable[[int], list[int]]:
    def ranks(n: int) -> list[int]:
        out = set()
        for p in probs:
            at = p * (n - 1)
            out |= {math.floor(at) + 1, math.ceil(at) + 1}
        return sorted(out)

    return ranks


def _interpolate(values: dict[int, tuple], n: int, p: float) -> float:
    at = p * (n - 1)
    low, high = values[math.floor(at) + 1][0], values[math.ceil(at) + 1][0]
    low, high = (math.copysign(math.inf, v) if abs(v) >= MAX_DOUBLE else v for v in (low, high))
    return low if low == high else low + (high - low) * (at - math.floor(at))


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    hot_rows: int = HOT_GROUP_ROWS,
    small: int = SMALL_INTERVAL,
) -> DataFrame:
    """Exact interpolated quantiles ``(by..., n, q array<double>)`` per group.

    Groups up to ``hot_rows`` rows are sorted (spilling, many groups per task) and
    the wanted positions picked.  Larger groups, at most total / ``hot_rows`` of
    them, are answered by rank selection, so no task ever holds a hot group.
    """
    by = list(by)
    slim = df.select(*by, F.col(value).cast("double").alias("__x")).filter(
        F.col("__x").isNotNull() & ~F.isnan("__x")
    )
    counts = settle(slim.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))).table
    hot_groups = [tuple(r) for r in counts.filter(F.col("n") > hot_rows).drop("n").collect()]
    if not hot_groups:
        return _sorted_quantiles(slim, counts, by, probs)
    spark = df.sparkSession
    key_schema = T.StructType([slim.schema[c] for c in by])
    keys = F.broadcast(spark.createDataFrame(hot_groups, key_schema))
    clipped = slim.join(keys, by, "left_semi").withColumn(
        "__x", F.greatest(F.least("__x", F.lit(MAX_DOUBLE)), F.lit(-MAX_DOUBLE))
    )
    sizes, found = select_ranks(clipped, ["__x"], _quantile_ranks(probs), by, small)
    rows = [
        (*g, sizes[g], [_interpolate(found[g], sizes[g], p) for p in probs]) for g in hot_groups
    ]
    schema = T.StructType(
        [*key_schema.fields, T.StructField("n", T.LongType()),
         T.StructField("q", T.ArrayType(T.DoubleType()))]
    )
    cold = _sorted_quantiles(slim.join(keys, by, "left_anti"), counts, by, probs)
    return cold.unionByName(spark.createDataFrame(rows, schema))


def _sorted_quantiles(slim: DataFrame, counts: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of groups that one task may sort."""
    at = [f"{float(p)!r}D * (n - 1)" for p in probs]
    ranks = sorted({f"{f}({x}) + 1" for x in at for f in ("floor", "ceil")})
    numbered = slim.join(counts, by).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*by).orderBy("__x"))
    )
    kept = numbered.filter(F.expr(f"__rn in ({', '.join(ranks)})"))
    cells = []
    for i, x in enumerate(at):
        low, high = (f"max(case when __rn = {f}({x}) + 1 then __x end)" for f in ("floor", "ceil"))
        cells += [f"{low} as l{i}", f"{high} as h{i}", f"max({x} - floor({x})) as w{i}"]
    picked = kept.groupBy(*by).agg(F.max("n").alias("n"), *[F.expr(c) for c in cells])
    values = [f"if(l{i} = h{i}, l{i}, l{i} + (h{i} - l{i}) * w{i})" for i in range(len(at))]
    return picked.selectExpr(*[sql.name(c) for c in by], "n", f"array({', '.join(values)}) as q")


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    cells: int = SMALL_CELLS,
    hot_rows: int = HOT_GROUP_ROWS,
    small: int = SMALL_INTERVAL,
    rows: int | None = None,
) -> DataFrame:
    """Exact quantiles of many columns: one row per group, ``<column>__q array<double>``.

    A frame of at most ``cells`` cells is one aggregate.
    Otherwise the columns are melted and every (group, column) becomes a group
    of :func:`grouped_quantiles`.  ``rows`` is the row count when the caller has
    counted already.
    """
    by = list(by)
    if rows is None:
        rows = df.count()
    clean = df.selectExpr(
        *[sql.name(c) for c in by], *[f"{sql.not_nan(c)} as {sql.name(c)}" for c in columns]
    )
    if rows * max(len(columns), 1) <= cells:
        wanted = ", ".join(repr(float(p)) for p in probs)
        return clean.groupBy(*by).agg(
            *[
                F.expr(f"percentile({sql.name(c)}, array({wanted})) as {sql.name(c + '__q')}")
                for c in columns
            ]
        )
    long = melt(clean, columns, by)
    q = grouped_quantiles(long, [*by, "column"], "value", probs, hot_rows, small)
    # pivot back: at most one row per (group, column)
    return q.groupBy(*by).agg(
        *[F.expr(f"max(case when column = '{c}' then q end) as {sql.name(c + '__q')}") for c in columns]
    )
