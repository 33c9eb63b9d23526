"""Language identification by words first, then by progressively shorter character n-grams.

Learning is two counts over all labelled documents: words by language, and from that table the
character n-grams of 1 to ``LONGEST`` code points (from two on, a word is bounded by a blank on either side).  A word
or n-gram is known if its share in some language is at least ``SHARE``; so a language has at most
1 / ``SHARE`` known words and as many n-grams of each length, however large the corpus is, while its
shares come from every document.  That bound makes the model fit for a broadcast.

Scoring reads whole texts.  A known word counts with the logarithm of its share in each language.  An
unseen one is judged by its n-grams of the greatest length of which any is known, with the mean of their
logarithms; a word without a known n-gram of any length says nothing.  A share below a tenth of
``SHARE``, zero included, counts as that tenth.  The prediction is the language of the greatest mean
over all words, ties to the one with more words learned from, then to the smaller name; ``score`` is its part
of the sum of the languages' exponentiated means.

Words are runs of letters (Unicode category L), lower-cased.  Defined cases: a null text, or one
without letters, is ``und`` with score 0, and so is any text if nothing could be learned from; rows
with a null language or text are not learned from; rows that repeat count each; an empty table
gives an empty result; the other columns of ``docs`` come back, replaced if named like an output.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.llm.store import Scratch
from foldloom.llm.words import slices

SHARE = 1e-5
LONGEST = 5
#: languages that a model may have, as it is broadcast and has a column of shares for each
LANGUAGES = 1_000
UNKNOWN = "und"

WORD = regex.compile(r"\p{L}+")
#: numbers that a worker keeps at hand for the words it has scored
REMEMBERED = 1 << 21


@dataclass
class Model:
    """Per n-gram length (0: words) the known ones and a row of log shares, a column per language."""

    languages: list[str]
    known: list[dict[str, int]]
    shares: list[np.ndarray]

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)))
        self.filled = 0

    def word(self, word: str) -> np.ndarray | None:
        """Log shares of a word by its longest known form; None if no n-gram of it is known."""
        at = self.known[0].get(word)
        if at is not None:
            return self.shares[0][at]
        for n in range(len(self.known) - 1, 0, -1):
            table, bounded = self.known[n], f" {word} " if n > 1 else word
            grams = [table[g] for i in range(len(bounded) - n + 1) if (g := bounded[i : i + n]) in table]
            if grams:
                return self.shares[n][grams].mean(axis=0)
        return None

    def _rows_of(self, words: Iterable[str]) -> list[int]:
        """Where the words' log shares stand in ``rows``; -1 for words that say nothing."""
        seen = self.seen
        for w in words:
            if w not in seen:
                row = self.word(w)
                seen[w] = -1 if row is None else self.filled
                if row is not None:
                    if self.filled == len(self.rows):
                        self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                    self.rows[self.filled] = row
                    self.filled += 1
        return [seen[w] for w in words]

    def judge(self, text: str | None) -> tuple[str, float]:
        words = Counter(WORD.findall(text.lower())) if text else None
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self.seen) * len(self.languages) > REMEMBERED:
            self.forget()
        at = np.array(self._rows_of(words))
        times = np.fromiter(words.values(), float, len(words))[at >= 0]
        at = at[at >= 0]
        mean = times @ self.rows[at] / times.sum() if len(at) else np.zeros(len(self.languages))
        best = int(np.argmax(mean))
        return self.languages[best], float(1 / np.exp(mean - mean[best]).sum())


def _shares(counts: DataFrame, totals: dict[str, int], share: float) -> tuple[dict[str, int], np.ndarray]:
    """The known ones of a table of lang, term, n, and their log shares."""
    session = counts.sparkSession
    sizes = session.createDataFrame(list(totals.items()), "lang string, total long")
    counts = counts.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("total"))
    known = counts.groupBy("term").agg(
        F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("shares")
    )
    rows = known.filter(F.col("most") >= share).select("term", "shares").toArrow()
    place = {lang: i for i, lang in enumerate(totals)}
    terms = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
    table = np.full((len(terms), len(totals)), share / 10)
    shares = rows.column("shares").combine_chunks()
    if len(terms):
        row = np.repeat(np.arange(len(terms)), np.diff(shares.offsets.to_numpy()))
        found = shares.flatten()
        column = np.array([place[x] for x in found.field("lang").to_pylist()])
        table[row, column] = np.maximum(found.field("share").to_numpy(), share / 10)
    return terms, np.log(table)


def learn(docs: DataFrame, share: float = SHARE, longest: int = LONGEST) -> Model:
    """The model of all rows of ``docs`` (text, lang) with a language and a text."""
    with Scratch(docs.sparkSession) as scratch:
        words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
        words = docs.filter("lang is not null").select(F.col("lang").cast("string"), words.alias("term"))
        words = scratch.save(words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")))
        totals = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang")
        totals = {r["lang"]: r["n"] for r in totals.take(LANGUAGES + 1)}
        if len(totals) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages; a model has a column for each")
        known, shares = [], []
        for n in range(longest + 1):
            if n == 0:
                counts, sizes = words, totals
            else:
                bounded = F.concat(F.lit(" "), "term", F.lit(" ")) if n > 1 else F.col("term")
                counts = words.withColumn("term", bounded).filter(F.length("term") >= n)
                grams = F.expr(f"explode(transform(sequence(1, length(term) - {n - 1}), i -> substr(term, i, {n})))")
                counts = counts.select("lang", grams.alias("term"), "n")
                counts = scratch.save(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")))
                sizes = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
                sizes = {lang: sizes.get(lang, 0) for lang in totals}
            terms, table = _shares(counts, sizes, share)
            known.append(terms)
            shares.append(table)
        return Model(list(totals), known, shares)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` without text, and lang_pred, score."""
    spark = docs.sparkSession
    outputs = ("lang_pred", "score")
    kept = [c for c in docs.columns if c not in (*outputs, "text")]
    docs = docs.select(*kept, "text")
    fields = [*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = spark.sparkContext.broadcast((model.languages, model.known, model.shares))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [own.judge(t) for t in part.column("text").to_pylist()]
                columns = [part.column(c) for c in kept]
                columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *outputs])

    with Scratch(spark) as scratch:
        return scratch.kept(docs.mapInArrow(scored, T.StructType(fields)))
