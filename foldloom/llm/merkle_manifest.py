"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree of the sources' roots.

The rows of a tree are numbered without a sort in one task: a range partitioning by tree and order
keeps neighbours together, a row's number is its place in its partition plus the rows of the
partitions before, and a tree's own numbers start at its smallest one.  So the tree of a source that
holds a third of all rows is spread like any other rows.

A level is a slot pivot: node number p of a tree is child p % 16 of parent p // 16, conditional
aggregates spread the children's digests into 16 columns, and the parent's digest is the hash of the
concatenated columns.  A child's siblings are its parent's columns without its own.  Siblings are
handed down from the root: a parent's own siblings on the way up are known before its children's, so
the one join of the size of the table is that of the leaves with their parents.

Defined cases: a null value is ``-``; a null source is a source of its own, before all others;
a null doc_id comes first in its source; rows with equal doc_id are ordered by leaf, and equal
rows are leaves of their own; a null doc_id is never tampered with; an empty table gives an
empty result; columns other than the five of ``FIELDS`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch, attach, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
SLOTS = [f"s{i}" for i in range(FANOUT)]
#: the only tree of the level above the sources
TOP = ""


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of the values, each with its length in bytes."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def numbered(rows: DataFrame, tree: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rows``, ``pos`` counted from 0 in each ``tree`` along ``order`` (ties in any order), and the tree's size ``of``."""
    # the salt keeps rows that are equal in every column from filling one partition
    salted = scratch.save(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    parts = partitions(rows.sparkSession)
    dealt = salted.repartitionByRange(parts, tree, *order, "_salt").sortWithinPartitions(tree, *order, "_salt")
    placed = scratch.save(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # a row per partition
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    placed = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    placed = placed.withColumn("_n", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    placed = placed.drop("_part", "_before", "_at")
    firsts = placed.groupBy(tree).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("of"))
    firsts = scratch.save(firsts.withColumn("_rows", F.col("of")))
    placed = attach(placed, firsts, [tree], "_rows")
    return placed.withColumn("pos", F.col("_n") - F.col("_first")).drop("_n", "_first")


def pivoted(nodes: DataFrame) -> DataFrame:
    """The parents of nodes (tree, pos, of, digest): the same columns, and their children's digests in ``SLOTS``."""
    slot = F.col("pos") % FANOUT
    columns = [F.max(F.when(slot == i, F.col("digest"))).alias(s) for i, s in enumerate(SLOTS)]
    up = F.expr(f"pos div {FANOUT}").alias("pos")
    parents = nodes.groupBy("tree", up, F.expr(f"(of + {FANOUT - 1}) div {FANOUT}").alias("of")).agg(*columns)
    return parents.withColumn("digest", F.sha2(F.concat_ws("", *SLOTS), 256))


def levels(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The pivoted levels above ``nodes``, lowest first; a tree ends at the level where it is one node."""
    # the largest tree decides the number of levels
    most = nodes.agg(F.max("of")).first()[0] or 0
    built = []
    while most > 1:
        nodes = scratch.save(pivoted(nodes.filter("of > 1")))
        built.append(nodes)
        most = -(-most // FANOUT)
    return built


def roots(nodes: DataFrame, built: list[DataFrame]) -> DataFrame:
    """tree, digest of the one node that remains of every tree."""
    ends = [level.filter("of = 1").select("tree", "digest") for level in (nodes, *built)]
    return reduce(DataFrame.unionByName, ends)


def _beside(children: DataFrame, parents: DataFrame, handed: Sequence[str]) -> DataFrame:
    """Children (tree, pos, …) with ``path``: their siblings before and after them, then their parents' path."""
    slot = F.col("pos") % FANOUT
    shown = [F.coalesce(f"_{s}", F.lit("")) for s in SLOTS]
    before = F.concat(*[F.when(slot > i, s).otherwise("") for i, s in enumerate(shown)])
    after = F.concat(*[F.when(slot < i, s).otherwise("") for i, s in enumerate(shown)])
    up = parents.select([F.col(c).alias(f"_{c}") for c in ("tree", "pos", *SLOTS, "path", *handed)])
    on = (F.col("tree") == F.col("_tree")) & (F.expr(f"pos div {FANOUT}") == F.col("_pos"))
    path = F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), "_path")
    return children.join(up, on).select(*children.columns, path.alias("path"), *[F.col(f"_{c}").alias(c) for c in handed])


def with_paths(nodes: DataFrame, built: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with ``path``, their siblings of every level upwards.

    ``above`` has for each tree the path from its root on, and what else its nodes are handed.
    """
    handed = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for level in (*reversed(built), nodes):
        # at most sixteen children meet a parent, and one root its tree's row, so no key is hot
        rows = level.filter("of = 1").join(above, "tree").select(*level.columns, "path", *handed)
        if parents is not None:
            rows = rows.unionByName(_beside(level.filter("of > 1"), parents, handed))
        parents = scratch.save(rows)
    return parents


#: a digest carried up a path
FOLD = "aggregate(path, {}, (d, p) -> sha2(concat(p.before, d, p.after), 256))"
NO_PATH = "cast(array() as array<struct<before string, after string>>)"


def manifest(docs: DataFrame, changed: Column, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Where ``changed`` holds, the root is recomputed from a leaf whose text is ``tampered``, beside the
    original siblings.
    """
    with Scratch(docs.sparkSession) as scratch:
        fields = [F.col(c) for c in FIELDS]
        own = leaf_of(fields)
        other = F.when(changed, leaf_of([*fields[:-1], tampered]))
        source = F.col("source").cast("string")
        tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
        leaves = docs.select("doc_id", tree.alias("tree"), own.alias("digest"), other.alias("other"))
        leaves = scratch.save(numbered(leaves, "tree", ["doc_id", "digest"], scratch))
        built = levels(leaves, scratch)

        upper = roots(leaves, built).select(F.col("tree").alias("source"), F.lit(TOP).alias("tree"), "digest")
        upper = scratch.save(numbered(upper, "tree", ["source"], scratch))
        built_above = levels(upper, scratch)
        root = roots(upper, built_above).first()
        root = F.lit(None if root is None else root["digest"]).cast("string")
        top = scratch.save(docs.sparkSession.range(1).select(F.lit(TOP).alias("tree"), F.expr(NO_PATH).alias("path")))
        upper = with_paths(upper, built_above, top, scratch)

        above = upper.select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"))
        rows = with_paths(leaves, built, above, scratch)
        rows = rows.withColumn("folded_root", F.expr(FOLD.format("coalesce(other, digest)")))
        return scratch.kept(
            rows.select(
                "doc_id",
                F.col("digest").alias("leaf"),
                "subroot",
                root.alias("root"),
                F.expr("sha2(array_join(transform(path, p -> concat(p.before, p.after)), ''), 256)").alias("proof_sha256"),
                "folded_root",
                (F.col("folded_root") == root).alias("verified"),
            )
        )
