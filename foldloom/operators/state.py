"""Fitted state: small DataFrames learned on training rows and joined back.

A state is *settled* once after fitting, so later plans neither re-scan the
training data nor carry its lineage.  Up to ``LOCAL_STATE_ROWS`` rows become a
local relation whose size Catalyst knows exactly (it broadcasts it on its own);
anything larger is checkpointed to the shared folder and joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.session import checkpointed

LOCAL_STATE_ROWS = 50_000
HOT_SHARE = 1_000


@dataclass(frozen=True)
class Settled:
    """A materialised state; ``local`` says its row count passed the bound."""

    table: DataFrame
    local: bool


def settle(state: DataFrame, limit: int = LOCAL_STATE_ROWS) -> Settled:
    head = state.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return Settled(state.sparkSession.createDataFrame(head, state.schema), True)
    return Settled(checkpointed(state), False)


def settle_row(state: DataFrame) -> DataFrame:
    """Settle a state that has one row by construction (a global aggregate)."""
    return state.sparkSession.createDataFrame(state.toArrow(), state.schema)


def with_state(df: DataFrame, state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Append the state columns to every row of ``df``.

    Without ``by`` the state is a single row and becomes literals, which keeps
    the plan a pure projection; with ``by`` it is a left join on those keys.
    """
    if by:
        return df.join(state, list(by), "left")
    row = state.first()
    return df.selectExpr(
        "*", *[f"{sql.literal(row[f.name], f.dataType)} as {sql.name(f.name)}" for f in state.schema.fields]
    )


def lookup(
    df: DataFrame,
    state: Settled,
    keys: Sequence[str],
    count_col: str = "n",
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Left join ``df`` with a state that has at most one row per key.

    A local state is broadcast by its known size.  A larger one is split by
    ``count_col`` (how many training rows hold the key): keys above one in
    ``hot_share`` of all rows are at most ``hot_share`` many, so that part is
    broadcast and never shuffled; the remaining keys are joined by shuffle,
    where no key is hot.
    """
    keys = list(keys)
    if state.local:
        return df.join(state.table, keys, "left")
    total = state.table.agg(F.sum(count_col)).first()[0] or 0
    is_hot = F.col(count_col) * F.lit(hot_share) > F.lit(total)
    hot = state.table.filter(is_hot)
    cold = state.table.filter(~is_hot)
    on_hot = df.join(F.broadcast(hot), keys, "inner")
    rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return on_hot.unionByName(rest.join(cold, keys, "left"))
