"""Corpus pipeline over ``documents``: stages that each write Parquet, reread by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foldloom.llm import stages
from foldloom.llm.store import delete, shared_folder

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of ``docs``
STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("substring dedup", stages.repeated_passages),
    ("source mixing", stages.mix),
    ("BPE encoding", stages.encode),
]

#: the classifier and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage read is deleted once its result is written, and all if a stage fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    try:
        for _, stage in STAGES:
            written.append(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
            stage(spark, docs, sf_dir).write.parquet(written[-1])
            for folder in written[:-1]:
                delete(spark, folder)
            written = written[-1:]
            docs = spark.read.parquet(written[-1])
    except BaseException:
        for folder in written:
            delete(spark, folder)
        raise
    return docs
