"""Imputation and infinity handling. Fit on training rows, apply anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.operators.columns import column_kinds, melt
from foldloom.operators.orderstats import column_quantiles
from foldloom.operators.state import settle, settle_row, with_state


def _settled(state: DataFrame, by: Sequence[str]) -> DataFrame:
    return settle(state).table if by else settle_row(state)


def fit_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``<column>__fill`` = mean of the non-missing values."""
    agg = df.groupBy(*by).agg(
        *[F.expr(f"avg({sql.not_nan(c)}) as {sql.name(c + '__fill')}") for c in columns]
    )
    return _settled(agg, by)


def fit_median(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """``<column>__fill`` = exact interpolated median."""
    q = column_quantiles(df, columns, [0.5], by, rows=rows)
    return _settled(
        q.selectExpr(*by, *[f"{sql.name(c + '__q')}[0] as {sql.name(c + '__fill')}" for c in columns]), by
    )


def fit_mode(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``<column>__fill`` = most frequent value, smallest on ties.

    Counting per value first keeps the aggregation map-side combined; the
    built-in ``mode`` would hold all distinct values of a column in one buffer.
    """
    counts = (
        melt(df, columns, by, cast="string")
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy(*by, "column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    )
    wide = best.groupBy(*by).agg(
        *[F.expr(f"max(case when column = '{c}' then value end) as {sql.name(c + '__fill')}") for c in columns]
    )
    return _settled(wide, by)


def fill(
    df: DataFrame,
    state: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    default: float | str | None = None,
) -> DataFrame:
    """Replace missing cells by the fitted value, then by ``default`` (all-missing column)."""
    types = dict(df.dtypes)
    last = "" if default is None else f", '{default}'" if isinstance(default, str) else f", {default}"

    def filled(c: str) -> str:
        x = sql.not_nan(c) if types[c] in ("double", "float") else sql.name(c)
        return f"coalesce({x}, {sql.name(c + '__fill')}{last})"

    return sql.replace_columns(df, with_state(df, state, by), columns, filled)


def text_or_unknown(df: DataFrame, columns: Sequence[str], token: str = "unknown") -> DataFrame:
    """Categorical columns as strings with missing cells spelled out."""
    return sql.replace_columns(
        df, df, columns, lambda c: f"coalesce(cast({sql.name(c)} as string), '{token}')"
    )


def infinite_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return sql.replace_columns(df, df, columns, sql.finite)


def zero_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN, NULL and both infinities become 0."""
    return sql.replace_columns(df, df, columns, sql.finite_or_zero)


def fit_clip(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """1st and 99th percentile of the finite values, ``<column>__q = [p1, p99]``."""
    finite_part = infinite_to_null(df.select(*by, *columns), columns)
    return _settled(column_quantiles(finite_part, columns, [0.01, 0.99], by, rows=rows), by)


def clip_infinite(
    df: DataFrame, state: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """+inf to the 99th, -inf to the 1st percentile; 0 where no finite value was seen."""

    def clipped(c: str) -> str:
        x, q = sql.double(c), sql.name(c + "__q")
        high = f"when {x} = {sql.INF} then coalesce({q}[1], 0D)"
        return f"case {high} when {x} = -{sql.INF} then coalesce({q}[0], 0D) else {x} end"

    return sql.replace_columns(df, with_state(df, state, by), columns, clipped)


def remaining_issues(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Cells still missing or infinite after cleaning: one row."""
    kinds = column_kinds(df, exclude)
    return df.agg(missing_cells(kinds).alias("missing"), infinite_cells(kinds).alias("infinite"))


def missing_cells(kinds) -> Column:
    """Sum of missing cells over all columns (one aggregate expression)."""
    cells = [f"int({sql.name(c)} is null or isnan({sql.double(c)}))" for c in kinds.numeric]
    cells += [f"int({sql.name(c)} is null)" for c in (*kinds.categorical, *kinds.other)]
    return _count_cells(cells)


def infinite_cells(kinds) -> Column:
    return _count_cells([f"int(coalesce(abs({sql.double(c)}) = {sql.INF}, false))" for c in kinds.numeric])


def _count_cells(cells: list[str]) -> Column:
    return F.expr(f"coalesce(sum(bigint({' + '.join(cells) or '0'})), 0L)")
