"""Scalers. Each fit is one row of statistics (per group); each apply is one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.operators.orderstats import column_quantiles
from foldloom.operators.state import settle, settle_row, with_state


def _settled(state: DataFrame, by: Sequence[str]) -> DataFrame:
    return settle(state).table if by else settle_row(state)


def fit_standard(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation."""
    stats = [
        F.expr(f"{f}({sql.double(c)}) as {sql.name(c + suffix)}")
        for c in columns
        for f, suffix in (("avg", "__mean"), ("stddev_pop", "__std"))
    ]
    return _settled(df.groupBy(*by).agg(*stats), by)


def _z(c: str) -> str:
    return f"(({sql.double(c)} - {sql.name(c + '__mean')}) / {sql.or_one(sql.name(c + '__std'))})"


def standard_scale(
    df: DataFrame, state: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """z-score; a constant column is only centred."""
    return sql.replace_columns(df, with_state(df, state, by), columns, _z)


def inverse_standard(
    df: DataFrame, state: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    def original(c: str) -> str:
        return f"{sql.name(c)} * {sql.or_one(sql.name(c + '__std'))} + {sql.name(c + '__mean')}"

    return sql.replace_columns(df, with_state(df, state, by), columns, original)


def fit_robust(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Exact quartiles, ``<column>__q = [q1, median, q3]``."""
    return _settled(column_quantiles(df, columns, [0.25, 0.5, 0.75], by, rows=rows), by)


def robust_scale(
    df: DataFrame, state: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(x - median) / IQR; an IQR of 0 divides by 1."""

    def scaled(c: str) -> str:
        q = sql.name(c + "__q")
        return f"({sql.double(c)} - {q}[1]) / {sql.or_one(f'({q}[2] - {q}[0])')}"

    return sql.replace_columns(df, with_state(df, state, by), columns, scaled)


def fit_log_normal(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Moments of the column and of ``log1p(abs(z))``: two aggregates."""
    first = fit_standard(df, columns, by)
    logs = sql.replace_columns(df, with_state(df, first, by), columns, lambda c: f"log1p(abs({_z(c)}))")
    second = fit_standard(logs, columns, by)
    renamed = second.selectExpr(
        *by,
        *[f"{sql.name(f'{c}__{s}')} as {sql.name(f'{c}__log_{s}')}" for c in columns for s in ("mean", "std")],
    )
    return _settled(first.join(renamed, list(by)) if by else _beside(first, renamed), by)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row states side by side."""
    return with_state(left, right)


def log_normalise(
    df: DataFrame, state: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """z-score, ``log1p(abs(z))``, z-score again, rounded half to even."""

    def scaled(c: str) -> str:
        mean, std = sql.name(c + "__log_mean"), sql.name(c + "__log_std")
        return f"bround((log1p(abs({_z(c)})) - {mean}) / {sql.or_one(std)}, {digits})"

    return sql.replace_columns(df, with_state(df, state, by), columns, scaled)
