"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that stay.

All but the last return the columns of ``docs``; n_chars follows text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import cotraining, lexicon_bpe, overlap_join, passages, poisson_mix
from foldloom.llm.queries import table, tokenizer
from foldloom.llm.store import Scratch, attach, small_side


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    judged = cotraining.judge(docs, table(spark, sf_dir, "labels"))
    rejected = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept")
    rejected = small_side(Scratch.kept(rejected.select(F.col("doc_id").alias("_id"))))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of smallest doc_id (any one, if none has an id).

    Documents without words all stay.  Rows that share a doc_id, or have none, are told apart by the print of
    their text.  An empty table stays empty; columns beside doc_id and text are only passed on.
    """
    found = Scratch.kept(overlap_join.classes(docs))
    odd = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1")
    odd = Scratch.kept(odd)
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    if odd.isEmpty():
        return docs.join(small_side(dropped), F.col("doc_id") == F.col("_id"), "left_anti")
    ids = small_side(odd.select(F.col("doc_id").alias("_id")))
    plain = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_anti")
    stay = plain.join(small_side(dropped.distinct()), F.col("doc_id") == F.col("_id"), "left_anti")
    rows = overlap_join.with_print(docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi"))
    facts = found.join(ids, found["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    facts = facts.groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("print").alias("_print")).agg(
        F.first("component").alias("_component"), F.first("component_id").alias("_least"), F.count(F.lit(1)).alias("_n")
    )
    rows = attach(rows, Scratch.kept(facts), ["doc_id", "_print"], "_n")
    wordless = rows.filter("_component is null")
    first = rows.filter("_component is not null and doc_id <=> _least").dropDuplicates(["_component"])
    return stay.unionByName(wordless.select(*docs.columns)).unionByName(first.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id holds."""
    cut = passages.without_passages(docs)
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate draws it, shuffled."""
    return poisson_mix.replicate(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the text that the ids decode to."""
    encoded = lexicon_bpe.encode(docs, tokenizer("word_bpe_49k.json")).drop("text")
    return encoded.withColumn("decoded", F.col("decoded").cast("string"))
