"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is the size it should get over the size it has.  Every document
draws its number of copies from a Poisson distribution with that mean, by inversion: a uniform
number made from a hash of seed and doc_id is looked up in the source's cumulative probabilities.
The document is exploded by its count and all copies are dealt out and sorted by another hash, which
shuffles them globally.  The draw depends on nothing but seed, doc_id and rate, so a task that runs
again gives the same copies.

Poisson variables add up, so a rate above ``STEP`` is drawn as several parts of at most ``STEP``,
each with its own hash; the table of cumulative probabilities stays short at any rate.

Defined cases: a null source is a source of its own; a null or empty text counts as size 0; a
source without any characters, or without a weight, has rate 0 and gives no rows; rows that repeat
draw the same count each; documents with a null doc_id share one draw; an empty table gives an
empty result; a column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch, attach

STEP = 200.0
POWER = 0.5

#: 52 bits of a hash as a number in [0, 1)
UNIFORM = "cast(conv(substr(md5({}), 1, 13), 16, 10) as bigint) / 4503599627370496D"


def rates(docs: DataFrame, weights: DataFrame | None = None, scale: float = 1.0, power: float = POWER) -> DataFrame:
    """source, docs, size, weight, rate: the rate gives every source its share of ``scale`` times the total size.

    ``weights`` has source and weight; without it a source's weight is its size to the ``power``.
    """
    sizes = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")
    )
    sizes = sizes.filter("size > 0")
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(given, sizes["source"].eqNullSafe(given["_source"]), "left").drop("_source")
        weighted = weighted.fillna({"weight": 0.0})
    weighted = Scratch.kept(weighted)
    total = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = float(scale) * (total["size"] or 0)
    return weighted.withColumn("rate", F.lit(share) * (F.col("weight") / F.lit(total["weight"] or 1.0)) / F.col("size"))


def replicate(
    docs: DataFrame, weights: DataFrame | None = None, scale: float = 1.0, power: float = POWER, seed: int = 7
) -> DataFrame:
    """Every document as often as its draw says: the columns of ``docs`` and copy (1, 2, …), shuffled."""
    kept = [c for c in docs.columns if c != "copy"]
    tables = (
        rates(docs.select("source", "text"), weights, scale, power)
        .withColumn("_parts", F.expr(f"cast(greatest(ceil(rate / {STEP!r}D), 1) as int)"))
        .withColumn("_rate", F.expr("rate / _parts"))
        .withColumn("_last", F.expr("cast(ceil(_rate + 12 * sqrt(_rate) + 25) as int)"))
        .withColumn(
            "_cdf",
            F.expr(
                """aggregate(
                     sequence(1, _last),
                     named_struct('term', exp(-_rate), 'sum', exp(-_rate), 'cdf', array(exp(-_rate))),
                     (s, k) -> named_struct(
                       'term', s.term * _rate / k,
                       'sum', s.sum + s.term * _rate / k,
                       'cdf', array_append(s.cdf, s.sum + s.term * _rate / k)),
                     s -> s.cdf)"""
            ),
        )
        .select("source", "docs", "_parts", "_cdf")
    )
    tables = Scratch.kept(tables)
    drawn = attach(docs.select(*kept), tables, ["source"], "docs")
    key = f"concat('{seed}:', coalesce(cast(doc_id as string), ''), ':', cast(i as string))"
    drawn = drawn.withColumn("_draws", F.expr(f"transform(sequence(1, _parts), i -> {UNIFORM.format(key)})"))
    drawn = drawn.withColumn("_n", F.expr("aggregate(_draws, 0, (n, u) -> n + size(filter(_cdf, c -> c <= u)))"))
    copies = drawn.filter("_n > 0").select(*kept, F.explode(F.expr("sequence(1, _n)")).alias("copy"))
    place = F.xxhash64(F.lit(seed), "doc_id", "copy")
    return (
        copies.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place").select(*kept, "copy")
    )
