"""Registry and shared input frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when it has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digits(c: Column | str, n: int = 6) -> Column:
    """Rounded double without a negative zero (``round`` itself would go through a decimal)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**n)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def rounded(df: DataFrame, columns: Iterable[str], n: int = 6) -> DataFrame:
    return sql.replace_columns(df, df, columns, lambda c: f"rint({sql.double(c)} * {10**n}D) / {10**n}D + 0D")


def orders_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing prices (every 7th key) and priorities (every 11th key)."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_NULLS = """
orders_nulls as (
  select o_orderkey, o_orderstatus,
         case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice,
         case when o_orderkey % 11 <> 0 then o_orderpriority end as o_orderpriority
  from orders)
"""


def events_inf(spark: SparkSession, folder: str) -> DataFrame:
    """Events with +inf (11th), -inf (13th) and NaN (17th) values injected."""
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(key % 11 == 0, F.lit(float("inf")))
        .when(key % 13 == 0, F.lit(float("-inf")))
        .when(key % 17 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
    )


EVENTS_INF = """
events_inf as (
  select event_id, event_type,
         case when event_id % 11 = 0 then 'infinity'::double
              when event_id % 13 = 0 then '-infinity'::double
              when event_id % 17 = 0 then null
              else value end as value
  from events)
"""


def experiment_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a search log: one entry per event."""
    return table(spark, folder, "events").select(
        (F.col("user_id") % 5).alias("dataset"),
        F.col("event_type").alias("algorithm"),
        (F.col("event_id") % 10).alias("fold"),
        F.col("value").alias("score"),
        F.from_json("props", "map<string,string>").alias("params"),
        F.col("event_id").alias("seq"),
    )


LOG = """
log as (
  select user_id % 5 as dataset, event_type as algorithm, event_id % 10 as fold, value as score,
         cast(json_extract_string(props, '$.k') as bigint) as k, event_id as seq
  from events)
"""

SHUFFLED = "((o_orderkey % 10007) * 7919) % 10007, o_orderkey"
FOLDED_ORDERS = f"""
folded as (
  select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
         cast(ntile(10) over (order by {SHUFFLED}) as integer) as fold
  from orders)
"""
