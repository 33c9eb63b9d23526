"""Row-wise derived features. Builders return ``{name: expression}``; one ``select`` applies them all."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.functions.numeric import equal_width_bin
from foldloom.operators.orderstats import select_ranks
from foldloom.operators.state import settle_row, with_state

PAIR_COLUMNS = 5


ROW_STATS = ("row_mean", "row_std", "row_max", "row_min", "row_range")


def with_row_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Append mean, sample std, max, min and range over the non-missing cells of a row.

    Three projections: each level is computed once and reused by the next.
    """
    cells = [sql.double(c) for c in columns]
    total = " + ".join(f"coalesce({x}, 0D)" for x in cells)
    seen = " + ".join(f"int({x} is not null)" for x in cells)
    high, low = (f"{f}({', '.join(cells)})" for f in ("greatest", "least"))
    first = df.selectExpr(
        "*", f"({total}) as __total", f"({seen}) as __seen", f"{high} as row_max", f"{low} as row_min"
    )
    second = first.selectExpr("*", "try_divide(__total, __seen) as row_mean")
    squares = " + ".join(f"coalesce(({x} - row_mean) * ({x} - row_mean), 0D)" for x in cells)
    return second.selectExpr(
        *[sql.name(c) for c in df.columns],
        "row_mean",
        f"coalesce(sqrt(try_divide({squares}, __seen - 1)), 0D) as row_std",
        "row_max",
        "row_min",
        "row_max - row_min as row_range",
    )


def row_median(columns: Sequence[str]) -> str:
    cells = f"array_sort(array_compact(array({', '.join(sql.double(c) for c in columns)})))"
    n = f"size({cells})"
    # get() is NULL outside the array: a row without values has no median
    return f"(get({cells}, int(({n} - 1) div 2)) + get({cells}, int({n} div 2))) / 2"


def pair_features(
    columns: Sequence[str], limit: int = PAIR_COLUMNS, minus: bool = False
) -> dict[str, str]:
    """Sum, product and guarded quotient (optionally difference) of column pairs."""
    out: dict[str, str] = {}
    for a, b in combinations(columns[:limit], 2):
        x, y = sql.double(a), sql.double(b)
        out[f"{a}_plus_{b}"] = f"{x} + {y}"
        out[f"{a}_mult_{b}"] = f"{x} * {y}"
        out[f"{a}_div_{b}"] = f"try_divide({x}, {y} + 1e-8D)"
        if minus:
            out[f"{a}_minus_{b}"] = f"{x} - {y}"
    return out


def polynomial_features(columns: Sequence[str], limit: int = PAIR_COLUMNS) -> dict[str, str]:
    """Degree-2 terms of the first columns: squares and cross products."""
    chosen = list(columns[:limit])
    terms = [(c, c) for c in chosen] + list(combinations(chosen, 2))
    return {f"{a}_poly_{b}": f"{sql.double(a)} * {sql.double(b)}" for a, b in terms}


def fit_minimum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return settle_row(df.agg(*[F.expr(f"min({sql.double(c)}) as {sql.name(c)}") for c in columns]))


def unary_features(columns: Sequence[str], minimum: dict[str, float | None]) -> dict[str, str]:
    """sqrt and log1p where the training minimum is not negative; square and abs always.

    Rows below 0 that only a later split has are taken at 0 for the gated pair.
    """
    out: dict[str, str] = {}
    for c in columns:
        x, low = sql.double(c), minimum.get(c)
        if low is not None and low >= 0:
            out[f"{c}_sqrt"] = f"sqrt(greatest({x}, 0D))"
            out[f"{c}_log"] = f"log1p(greatest({x}, 0D))"
        out[f"{c}_squared"] = f"{x} * {x}"
        out[f"{c}_abs"] = f"abs({x})"
    return out


def derive(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """All features in one projection; columns not asked for later are pruned."""
    return df.selectExpr("*", *[f"{e} as {sql.name(n)}" for n, e in features.items()])


def equal_width_bins(df: DataFrame, column: str, name: str, bins: int = 5) -> DataFrame:
    limits = settle_row(
        df.agg(F.min(F.col(column).cast("double")).alias("__lo"), F.max(F.col(column).cast("double")).alias("__hi"))
    )
    joined = with_state(df, limits)
    return joined.withColumn(
        name, equal_width_bin(F.col(column).cast("double"), F.col("__lo"), F.col("__hi"), bins)
    ).drop("__lo", "__hi")


def ntile_cuts(n: int, k: int) -> list[int]:
    """Last rank of tiles 1..k-1 when the first ``n mod k`` tiles hold one row more."""
    size, extra = divmod(n, k)
    ends, at = [], 0
    for tile in range(k - 1):
        at += size + (1 if tile < extra else 0)
        ends.append(at)
    return ends


def tile_of(
    df: DataFrame, order: Sequence[str], cuts: Sequence[tuple], name: str
) -> DataFrame:
    """Tile number (1-based) by comparing the order key with the cut keys: a projection."""
    key = F.struct(*[F.col(c) for c in order])
    types = [df.schema[c].dataType for c in order]
    tile = F.lit(1)
    for cut in cuts:
        bound = F.struct(
            *[F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, types, order, strict=True)]
        )
        tile = tile + (key > bound).cast("int")
    return df.withColumn(name, tile)


def assign_tiles(df: DataFrame, order: Sequence[str], k: int, name: str) -> DataFrame:
    """``ntile(k) over (order by ...)`` without a global window.

    ``order`` must be unique per row.  The k-1 cut keys come from rank selection;
    assignment is then a comparison per row, so no row is shuffled or sorted.
    """
    wanted: list[int] = []

    def ranks(n: int) -> list[int]:
        wanted.extend(r for r in ntile_cuts(n, k))
        return sorted({r for r in wanted if r >= 1})

    _, found = select_ranks(df.select(*order), list(order), ranks)
    keys = found.get((), {})
    cuts = [keys[r] for r in wanted if r >= 1]
    return tile_of(df, order, cuts, name)


def feature_categories(df: DataFrame, engineered: Sequence[str], original: Sequence[str]) -> DataFrame:
    """Count engineered columns by the part of their name that tells the family."""
    spark = df.sparkSession
    # fixed values: name fragments that mark each feature family
    families = {
        "statistical": ["row_"],
        "interactions": ["_plus_", "_mult_", "_div_", "_minus_"],
        "transformations": ["_sqrt", "_log", "_squared", "_abs"],
        "categorical": ["_target_mean", "_freq"],
    }
    names = spark.createDataFrame([(c,) for c in engineered], "name string")
    counts = [
        F.count_if(_contains_any(F.col("name"), parts)).alias(family)
        for family, parts in families.items()
    ]
    return names.agg(
        F.lit(len(original)).cast("long").alias("original"),
        *counts,
        F.count(F.lit(1)).alias("total"),
    )


def _contains_any(name: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | name.contains(part)
    return hit
