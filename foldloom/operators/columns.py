"""Column typing, selection and schema alignment. Only the schema is consulted, no job runs
(except for the variance test)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions import sql


@dataclass(frozen=True)
class ColumnKinds:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    other: tuple[str, ...]


def column_kinds(df: DataFrame, exclude: Iterable[str] = ()) -> ColumnKinds:
    """Numeric = any number type, categorical = string, other = boolean and time types."""
    skip = set(exclude)
    numeric, categorical, other = [], [], []
    for field in df.schema.fields:
        if field.name in skip:
            continue
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"nested column {field.name!r} is not a feature; flatten it first")
        if isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType)):
            categorical.append(field.name)
        else:
            other.append(field.name)
    return ColumnKinds(tuple(numeric), tuple(categorical), tuple(other))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in any floating column becomes NULL."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return sql.replace_columns(
        df, df, floats, lambda c: f"case when not isnan({sql.name(c)}) then {sql.name(c)} end"
    )


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    numeric = set(column_kinds(df, keep).numeric)
    return df.select(*[c for c in df.columns if c in numeric or c in keep])


def to_double(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return sql.replace_columns(df, df, columns, sql.double)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose sample variance is exactly zero: one aggregate over all of them."""
    if not columns:
        return []
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0.0]


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


def align_to(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Force the training schema: missing columns become 0, extras go, order is fixed."""
    present = set(df.columns)
    return df.selectExpr(
        *[sql.name(c) for c in keep],
        *[sql.name(c) if c in present else f"0D as {sql.name(c)}" for c in names],
    )


def align_inputs(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Fitted input columns of a later frame; one it lacks is NULL and imputed like a missing cell."""
    present = set(df.columns)

    def column(c: str, kind: str) -> str:
        return sql.name(c) if c in present else f"cast(null as {kind}) as {sql.name(c)}"

    return df.selectExpr(
        *[column(c, "double") for c in keep],
        *[column(c, "double") for c in numeric],
        *[column(c, "string") for c in categorical],
    )


def first_columns(df: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    names = [c for c in df.columns if c not in keep]
    return df.select(*keep, *names[:k])


def preview(df: DataFrame, order: Sequence[str], n: int = 3, head: int = 10, tail: int = 0) -> DataFrame:
    """First ``n`` rows by ``order``, showing the first ``head`` (or last ``tail``) columns."""
    names = df.columns[-tail:] if tail else df.columns[:head]
    return df.orderBy(*order).limit(n).select(*names)


def pad_vector(vector: Column, width: int) -> Column:
    """Zero-pad or cut an array to ``width`` elements."""
    missing = F.greatest(F.lit(width) - F.size(vector), F.lit(0))
    element = F.array_repeat(F.lit(0.0), missing)
    return F.slice(F.concat(vector.cast("array<double>"), element), 1, width)


def melt(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    cast: str = "double",
    name: str = "column",
    value: str = "value",
) -> DataFrame:
    """Wide to long ``(keep..., column, value)``; one generator, no union of scans."""
    cells = ", ".join(f"'{c}', cast({sql.name(c)} as {cast})" for c in columns)
    return df.selectExpr(
        *[sql.name(c) for c in keep],
        f"stack({len(columns)}, {cells}) as ({sql.name(name)}, {sql.name(value)})",
    )
