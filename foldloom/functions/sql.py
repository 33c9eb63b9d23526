"""SQL text for expressions that are built per column.

Wide frames need hundreds of them, and one parsed string costs a single call
into the JVM where an operator tree costs one per node.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INF = "double('Infinity')"


def name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def double(c: str) -> str:
    return f"cast({name(c)} as double)"


def finite(c: str) -> str:
    """The value as double, NULL where it is NaN or infinite."""
    x = double(c)
    return f"case when not isnan({x}) and abs({x}) <> {INF} then {x} end"


def finite_or_zero(c: str) -> str:
    return f"coalesce({finite(c)}, 0D)"


def not_nan(c: str) -> str:
    x = double(c)
    return f"case when not isnan({x}) then {x} end"


def or_one(scale: str) -> str:
    """A scale to divide by: 0 and NULL become 1."""
    return f"coalesce(nullif({scale}, 0D), 1D)"


def literal(value: object, kind: T.DataType) -> str:
    """A value of a settled state as SQL text."""
    if value is None:
        return f"cast(null as {kind.simpleString()})"
    if isinstance(kind, T.ArrayType):
        return "array(" + ", ".join(literal(v, kind.elementType) for v in value) + ")"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        if math.isfinite(value):
            return f"{value!r}D"
        return "double('NaN')" if math.isnan(value) else ("" if value > 0 else "-") + INF
    if isinstance(kind, T.StringType):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"cast('{value}' as {kind.simpleString()})"


def replace_columns(df: DataFrame, source: DataFrame, columns: Iterable[str], expression) -> DataFrame:
    """The columns of ``df`` read from ``source``, the given ones replaced by ``expression(c)``."""
    wanted = set(columns)
    return source.selectExpr(
        *[f"{expression(c)} as {name(c)}" if c in wanted else name(c) for c in df.columns]
    )
