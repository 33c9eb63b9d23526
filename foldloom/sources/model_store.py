"""Fitted models by dataset, fold and name, kept across sessions.

Spark ML models are written by their own writers, one folder each; models that are rows (weights,
tree nodes) are tables.  Either becomes visible by a commit of :class:`Snapshots`, so a model is
read whole or not at all, and saving under a used key replaces the model.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.sources.snapshots import Snapshots

KEYS = ("dataset", "fold", "model")
INDEX = "dataset string, fold int, model string, kind string, path string, info string"


@dataclass(frozen=True)
class Entry:
    """A fitted Spark ML model; ``fold`` is None for one that serves all folds."""

    dataset: str
    fold: int | None
    model: str
    fitted: MLWritable
    info: Mapping[str, object] = field(default_factory=dict)


class ModelStore(Snapshots):
    def save(self, entries: Iterable[Entry]) -> int:
        """Write the models of all entries, then show them at once."""
        folder, rows = self.new_folder(), []
        for i, e in enumerate(entries):
            path = f"{folder}/{i}"
            e.fitted.write().save(f"{self.root}/{path}")
            rows.append((e.dataset, e.fold, e.model, type(e.fitted).__name__, path, json.dumps(dict(e.info), sort_keys=True)))
        return self.merge("index", self.spark.createDataFrame(rows, INDEX), KEYS)

    def index(self) -> DataFrame:
        found = self.read("index")
        return self.spark.createDataFrame([], INDEX) if found is None else found

    def load(self, dataset: str, fold: int | None, model: str) -> tuple[object, dict]:
        """The fitted model and its info."""
        key = {"dataset": dataset, "fold": fold, "model": model}
        match = [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()]
        row = self.index().filter(match[0] & match[1] & match[2]).first()
        if row is None:
            raise KeyError(tuple(key.values()))
        fitted = DefaultParamsReader.loadParamsInstance(f"{self.root}/{row['path']}", self.spark)
        return fitted, json.loads(row["info"])

    def folds(self, dataset: str, model: str) -> dict[int, object]:
        """The models of all folds of a dataset."""
        rows = self.index().filter((F.col("dataset") == dataset) & (F.col("model") == model)).select("fold").collect()
        return {r["fold"]: self.load(dataset, r["fold"], model)[0] for r in rows}

    def save_rows(self, kind: str, rows: DataFrame) -> int:
        """Models that are rows, one per (dataset, fold, model): linear weights, say."""
        return self.merge(f"rows_{kind}", rows, KEYS)

    def rows(self, kind: str) -> DataFrame | None:
        return self.read(f"rows_{kind}")

    def _folders(self, version: int) -> list[str]:
        """Beside the tables, the models of the version's index are in use."""
        index = self.read("index", version)
        own = [] if index is None else [r["path"] for r in index.select("path").distinct().collect()]
        return [*super()._folders(version), *own]
