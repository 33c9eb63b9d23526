"""Saving and loading fitted state: parquet per table plus one metadata JSON row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from foldloom.operators.encode import CategoryMap, category_totals
from foldloom.operators.state import settle


def save_state(path: str, tables: dict[str, DataFrame], info: dict) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame(
        [(json.dumps({**info, "tables": sorted(tables)}),)], "value string"
    ).coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    info = json.loads(spark.read.text(f"{path}/info").first()["value"])
    return {n: spark.read.parquet(f"{path}/{n}") for n in info["tables"]}, info


def load_categories(table: DataFrame, columns: list[str]) -> CategoryMap:
    state = settle(table)
    return CategoryMap(state, tuple(columns), category_totals(state.table))
