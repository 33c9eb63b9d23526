"""Spelling variants: words one edit apart, found with asymmetric q-chunks.

Of two words the shorter one (of either, if equally long) of m code points contributes two disjoint
chunks, its first and its last q = m // 2 code points; the other one, of m or m + 1 code points,
contributes its positional grams of length q.  One edit cannot touch both chunks.  If it stands right of the
first chunk, that chunk is the gram at the same place; else the last chunk is a gram whose place is
shifted by the difference of the lengths, zero or one.  Grams elsewhere meet no chunk within that shift and get
no row.  The rows are joined on a hash of (m, which chunk, gram) and each pair is verified by a
banded edit distance.

Half a word is a poor key where many words share it.  What the chunk leaves over, the remainders of
the two words, are again one edit apart, so the same step splits them: a key is extended by a chunk
of the remainder.  ``DEPTH`` steps are always taken.  A key whose words would still make more than
``HEAVY`` comparisons is split again, until its remainder has one code point, so a common word part
costs more rows instead of all pairs of its words, and no link is lost.

Defined cases: a null or empty text has no words; words of fewer than ``least`` code points take no
part; words that repeat in the given table are added up; a null word or count is left out; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch, attach, small_side

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST = 7
RATIO = 10
DEPTH = 2
HEAVY = 4_096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and word for every maximal run of letters of at least ``least`` code points, A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word"))


def counted(words: DataFrame, least: int = LEAST, times: int = 2) -> DataFrame:
    """word, n of the words with enough code points and occurrences."""
    words = words.filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def _split(rows: DataFrame) -> DataFrame:
    """Each row's key extended by the first and by the last chunk of what is left of its word."""
    q = "(m div 2)"
    parts = F.expr(
        f"""inline(array(
          named_struct('key', xxhash64(key, 0, left(rest, {q})), 'rest', substr(rest, {q} + 1), 'm', m - {q}),
          named_struct('key', xxhash64(key, 1, right(rest, {q})), 'rest', left(rest, length(rest) - {q}), 'm', m - {q})))"""
    )
    return rows.select("word", "n", "chunk", parts)


def _rows(words: DataFrame, least: int) -> DataFrame:
    """word, n, chunk, key, rest, m: the chunks of every word, and its grams for words of its length and one less."""
    size = "length(word)"
    sides = F.expr(
        f"""inline(filter(array(
          named_struct('chunk', true, 'm', {size}),
          named_struct('chunk', false, 'm', {size}),
          named_struct('chunk', false, 'm', {size} - 1)), x -> x.m >= {least}))"""
    )
    rows = words.select("word", "n", F.col("word").alias("rest"), sides)
    rows = rows.withColumn("key", F.col("m").cast("long"))
    for _ in range(DEPTH):
        rows = _split(rows)
    return rows


def _compared(rows: DataFrame) -> DataFrame:
    """The pairs one edit apart among the rows of a key: a, n_a, b, n_b."""
    chunks = rows.filter("chunk").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = rows.filter("not chunk").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    near: Column = F.expr("(length(a) < length(b) or a < b) and levenshtein(a, b, 1) = 1")
    return chunks.join(grams, (chunks["key"] == grams["key"]) & near).drop("key")


def near_pairs(words: DataFrame, scratch: Scratch, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    """a, n_a, b, n_b for every two words one inserted, deleted or replaced code point apart, once each."""
    rows, light = _rows(words, least), []
    while True:
        work = F.expr("sum(if(chunk, 1, 0)) * sum(if(chunk, 0, 1))")
        over = rows.filter("m > 1").groupBy("key").agg(work.alias("work"), F.count(F.lit(1)).alias("rows"))
        over = scratch.save(over.filter(F.col("work") > heavy).select("key", "rows", F.lit(True).alias("over")))
        if over.isEmpty():
            light.append(rows)
            break
        marked = attach(rows, over, ["key"], "rows", "left")
        light.append(marked.filter("over is null").drop("over"))
        rows = scratch.save(_split(marked.filter("over").drop("over")))
    pairs = _compared(light[0])
    for rows in light[1:]:
        pairs = pairs.unionByName(_compared(rows))
    return pairs.distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where the forms lead, by pointer doubling; a form is ten times as frequent, so there is no ring."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        roots = scratch.save(roots)
        onward = roots.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        met = roots.join(small_side(onward), F.col("root") == F.col("_at"), "left")
        if met.filter("_at is not null").isEmpty():
            return roots
        roots = met.select("word", F.coalesce("_to", "root").alias("root"))


def variants(words: DataFrame, least: int = LEAST, ratio: int = RATIO, heavy: int = HEAVY) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of word and n.

    A word's form is the most frequent of its near words (ties: the smallest in code-point order) if that
    is at least ``ratio`` times as frequent as the word; its root is where the forms end.
    """
    with Scratch(words.sparkSession) as scratch:
        words = words.filter(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
        words = scratch.save(words.filter("n is not null"))
        pairs = scratch.save(near_pairs(words, scratch, least, heavy))
        both = pairs.selectExpr("a as word", "n_a as n", "b as near", "n_b as n_of").unionByName(
            pairs.selectExpr("b as word", "n_b as n", "a as near", "n_a as n_of")
        )
        near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"))
        fitting = both.filter(F.col("n_of") >= F.lit(ratio) * F.col("n"))
        best = fitting.groupBy("word").agg(F.expr("min(struct(-n_of as n, near as form))").alias("best"))
        forms = scratch.save(best.select("word", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))
        roots = _roots(forms, scratch)
        led = forms.join(roots, "word")
        out = words.join(near, "word", "left").join(led, "word", "left")
        return scratch.kept(
            out.select(
                "word",
                "form",
                F.coalesce("root", "word").alias("root"),
                "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                "form_n",
            )
        )
