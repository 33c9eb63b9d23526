"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch, attach

EDGES = "a long, b long"


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node of each one's component."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of the components inside each batch."""
    for batch in batches:
        nodes, root = joined(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        out = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(root[out])], ["a", "b"])


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
    low = Scratch.kept(low.withColumn("low", F.least("a", "low")))
    around = attach(both, low, ["a"], "n")
    if large:
        out = around.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = around.select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b); neither may be null."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = edges.mapInArrow(_contracted, EDGES).distinct()
    edges = Scratch.kept(edges)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = Scratch.kept(_starred(_starred(edges, True), False))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
