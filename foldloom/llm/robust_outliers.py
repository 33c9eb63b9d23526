"""Quality rules by robust multivariate outliers.

Rules first: documents with few words or much repetition fail at once.  Of the others, a vector of
transformed statistics is compared with its language and source: a minimum-covariance-determinant
estimate of place and scatter, and rejection by Mahalanobis distance.

The estimate is FAST-MCD with deterministic starts over all rows, as grouped sums:

* medians and deviations of each statistic come from its counts by value;
* three starts per group: those scales alone, the scatter of tanh scores, the scatter of signs;
* a concentration step computes every row's distance, sums moments by distance bin, and takes the
  lowest bins that hold ``SHARE`` of the rows as the next estimate;
* of the starts, the one of least determinant is reweighted once.

Statistics are whole thousandths, so all sums are whole numbers and the result does not depend on
the order in the order in which tasks finish.  A spread below its ``FLOORS`` is raised to it, which keeps scatters
regular where a statistic hardly varies; a spread above it is used as estimated.  Floors are small
enough that each statistic alone can still lead to rejection.  Groups below ``LEAST`` rows are pooled by language, and languages
that stay below it are pooled together; every row belongs to one pool.

Defined cases: a null text has no words and fails; null language or source is a value of its own;
rows that repeat count as often as they occur; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldloom.llm.store import Scratch, attach
from foldloom.llm.text_stats import STATS, stats_of
from foldloom.llm.words import slices

LEAST_WORDS = 10
MOST_REPEATED = 20
LEAST = 50
#: of the rows that make an estimate; nearly as many others may be copies of one junk text
SHARE = 0.5
STEPS = 6
UNIT = 1000
#: words of average length added to each text, so that a few words say little about their length
PRIOR_WORDS, PRIOR_LENGTH = 30, 5
FEATURES = ("length", "symbols", "lines", "repeats")
#: least spread of each feature; with a floor as spread, a document is rejected from about 38 %
#: duplicate lines or 10.5 % repeated words on
FLOORS = np.array([0.04, 0.6, 0.75, 0.5])
#: factor on covariances, so that features which vary together in every row leave a regular scatter
SHRINK = 0.99
N = len(FEATURES)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]
#: quantiles of the chi-square distribution with N = 4 degrees of freedom, fixed values
CHI_SHARE, CHI_975, CHI_CUT = 3.356694, 11.143287, 23.512742  # 0.5, 0.975, 0.9999
#: P(chi2 with N + 2 <= the quantile), for the consistency of truncated scatters; fixed values
WITHIN_SHARE, WITHIN_975 = 0.237072, 0.915952


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed and the features in thousandths."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = stats_of(part.column("text"))
                words = np.maximum(s["n_words"], 1)
                values = [
                    np.log((s["word_chars"] + PRIOR_WORDS * PRIOR_LENGTH) / (s["n_words"] + PRIOR_WORDS)),
                    np.log1p(100 * s["n_symbols"] / words),
                    np.log1p(100 * s["n_dup_lines"] / np.maximum(s["n_lines"], 1)),
                    np.log1p(100 * s["n_repeat_words"] / words),
                ]
                values = [np.rint(UNIT * v).astype(np.int64) for v in values]
                columns = [part.column(c) for c in ("doc_id", "lang", "source")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *[pa.array(x, pa.int64()) for x in [*[s[c] for c in STATS], *values]]], schema.names
                )

    docs = docs.select("doc_id", "lang", "source", "text")
    numbers = [*STATS, *[f"x{i}" for i in range(N)]]
    schema = StructType([*docs.schema.fields[:3], *[StructField(c, LongType()) for c in numbers]])
    failed = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    return docs.mapInArrow(computed, schema).withColumn("base_failed", F.expr(failed))


def pools(rows: DataFrame) -> DataFrame:
    """lang, source, n and the pool whose estimate judges them."""
    own = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = own.filter(F.col("n") < LEAST).groupBy("lang").agg(F.sum("n").alias("of_lang"))
    small = small.withColumnRenamed("lang", "_lang")
    level = F.expr(f"if(n >= {LEAST}, 0, if(of_lang >= {LEAST}, 1, 2))")
    out = own.join(small, own["lang"].eqNullSafe(small["_lang"]), "left").withColumn("level", level)
    pool = F.expr("to_json(named_struct('level', level, 'lang', if(level < 2, lang, null), 'source', if(level < 1, source, null)))")
    return out.select("lang", "source", "n", pool.alias("pool"))


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, sums and sums of products of v0, v1, …, exact as whole numbers."""
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(N)]
    products = [F.sum(F.expr(f"v{i} * v{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


MODEL_COLUMNS = [*[f"m{i}" for i in range(N)], *[f"w{i}{j}" for i, j in PAIRS], "logdet"]
MODEL_DDL = "pool string, start int, rows long, " + ", ".join(f"{c} double" for c in MODEL_COLUMNS)


def model_row(pool: str, start: int, rows: int, mean: np.ndarray, scatter: np.ndarray) -> list:
    """An estimate as the inverse of its Cholesky factor, which turns deviations into unit ones."""
    factor = np.linalg.cholesky(scatter)
    inverse = np.linalg.inv(factor)
    logdet = 2 * np.log(np.diag(factor)).sum()
    return [pool, start, rows, *mean, *[inverse[i, j] for i, j in PAIRS], logdet]


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pool", "start", "rows", *MODEL_COLUMNS])


def _moments_of(frame: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (in feature units) of all rows of a frame of sums."""
    n = int(frame["n"].sum())
    total = np.array([frame[f"s{i}"].sum() for i in range(N)], float)
    second = np.zeros((N, N))
    for i, j in PAIRS:
        second[i, j] = second[j, i] = float(frame[f"p{i}{j}"].sum())
    mean = total / n
    return n, mean / UNIT, (second / n - np.outer(mean, mean)) / UNIT**2


def _regular(scatter: np.ndarray) -> np.ndarray:
    """The scatter with variances of at least ``FLOORS`` squared, and correlations below one."""
    return np.where(np.eye(N, dtype=bool), np.maximum(scatter, np.diag(FLOORS**2)), SHRINK * scatter)


def distance() -> str:
    """Squared Mahalanobis distance of x0, x1, … under the joined estimate."""
    terms = []
    for i in range(N):
        y = " + ".join(f"w{i}{j} * (x{j} / {UNIT}D - m{j})" for j in range(i + 1))
        terms.append(f"pow({y}, 2)")
    return " + ".join(terms)


def _centres(rows: DataFrame) -> DataFrame:
    """Medians and scaled median deviations of each pool, from the counts of each value."""
    stacked = rows.selectExpr(
        "pool", f"stack({N}, {', '.join(f'{i}, x{i}' for i in range(N))}) as (feature, value)"
    )
    counts = stacked.groupBy("pool", "feature", "value").agg(F.count(F.lit(1)).alias("n"))

    def middle(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    def fitted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        mean, spread = np.zeros(N), np.zeros(N)
        for i, own in frame.groupby("feature"):
            values, n = own["value"].to_numpy(), own["n"].to_numpy()
            mean[i] = middle(values, n)
            spread[i] = 1.4826 * middle(np.abs(values - mean[i]), n)
        scatter = _regular(np.diag((spread / UNIT) ** 2))
        rows = int(frame.loc[frame["feature"] == 0, "n"].sum())
        return _frame([model_row(key[0], 0, rows, mean / UNIT, scatter)])

    return counts.groupBy("pool").applyInPandas(fitted, MODEL_DDL)


def _starts(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """The centre's own scales, and the scatters of tanh scores and of signs in those scales."""
    scored = attach(rows, centres, ["pool"], "rows")
    z = [f"w{i}{i} * (x{i} / {UNIT}D - m{i})" for i in range(N)]
    norm = f"sqrt({' + '.join(f'pow({x}, 2)' for x in z)})"
    tanh = ", ".join(f"cast(rint(10000 * tanh({x})) as bigint)" for x in z)
    sign = ", ".join(f"cast(rint(if({norm} > 0, 10000 * {x} / {norm}, 0)) as bigint)" for x in z)
    names = ", ".join(["start", *[f"v{i}" for i in range(N)]])
    stacked = scored.selectExpr("pool", f"stack(2, 1, {tanh}, 2, {sign}) as ({names})")
    sums = moments(stacked, ["pool", "start"])

    def fitted(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        centre = left.iloc[0]
        mean = np.array([centre[f"m{i}"] for i in range(N)])
        scale = 1 / np.array([centre[f"w{i}{i}"] for i in range(N)])
        out = [left.iloc[0].tolist()]
        for start, own in right.groupby("start"):
            _, _, scatter = _moments_of(own)
            root = np.sqrt(np.diag(scatter))
            shape = scatter / np.outer(root, root) if (root > 0).all() else np.eye(N)
            shape = np.where(np.eye(N, dtype=bool), 1, 0.95 * shape)  # stays regular when scores agree
            out.append(model_row(key[0], int(start), int(centre["rows"]), mean, shape * np.outer(scale, scale)))
        return _frame(out)

    return centres.groupBy("pool").cogroup(sums.groupBy("pool")).applyInPandas(fitted, MODEL_DDL)


def _concentrated(rows: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step of every start: the rows of least distance give the next estimate."""
    wide = models.groupBy("pool").agg(
        F.max("rows").alias("rows"),
        F.sort_array(F.collect_list(F.struct("start", *MODEL_COLUMNS))).alias("models"),  # three at most
    )
    scored = attach(rows, Scratch.kept(wide), ["pool"], "rows").select(
        "pool", *[f"x{i}" for i in range(N)], F.explode("models").alias("model")
    )
    scored = scored.select("pool", *[f"x{i}" for i in range(N)], "model.*").withColumn("d2", F.expr(distance()))
    # bins of an eighth of a doubling: the order of distances is kept between bins
    scored = scored.withColumn("bin", F.expr("cast(floor(8 * log2(1 + 64 * d2)) as int)"))
    for i in range(N):
        scored = scored.withColumnRenamed(f"x{i}", f"v{i}")
    sums = moments(scored, ["pool", "start", "bin"])

    def fitted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for start, own in frame.groupby("start"):
            own = own.sort_values("bin")
            upto = np.cumsum(own["n"].to_numpy())
            enough = int(np.searchsorted(upto, SHARE * upto[-1])) + 1
            _, mean, scatter = _moments_of(own.iloc[:enough])
            consistent = scatter * (SHARE / WITHIN_SHARE)
            out.append(model_row(key[0], int(start), int(upto[-1]), mean, _regular(consistent)))
        return _frame(out)

    return sums.groupBy("pool").applyInPandas(fitted, MODEL_DDL)


def estimates(rows: DataFrame) -> DataFrame:
    """One reweighted estimate per pool of rows (pool, x0, x1, …)."""
    models = Scratch.kept(_starts(rows, Scratch.kept(_centres(rows))))
    for _ in range(STEPS):
        models = Scratch.kept(_concentrated(rows, models))
    best = models.groupBy("pool").agg(F.min_by(F.struct("*"), F.struct("logdet", "start")).alias("m")).select("m.*")
    scored = attach(rows, Scratch.kept(best), ["pool"], "rows").withColumn("d2", F.expr(distance()))
    near = scored.filter(F.col("d2") <= CHI_975)
    for i in range(N):
        near = near.withColumnRenamed(f"x{i}", f"v{i}")
    sums = moments(near, ["pool"])

    def fitted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = _moments_of(frame)
        return _frame([model_row(key[0], 0, n, mean, _regular(scatter * (0.975 / WITHIN_975)))])

    return sums.groupBy("pool").applyInPandas(fitted, MODEL_DDL)


def judge(docs: DataFrame, cut: float = CHI_CUT) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (squared) and kept."""
    docs = docs.select("doc_id", "lang", "source", "text")
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.save(statistics(docs))
        passed = table.filter("not base_failed")
        pool = Scratch.kept(pools(passed))
        rows = scratch.save(attach(passed, pool, ["lang", "source"], "n").select("pool", *[f"x{i}" for i in range(N)]))
        found = attach(pool, Scratch.kept(estimates(rows)), ["pool"], "rows").drop("start", "logdet", "pool")
        judged = attach(table, Scratch.kept(found), ["lang", "source"], "n", "left")
        judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.expr(distance())))
        kept = ~F.col("base_failed") & (F.col("distance") <= cut)
        out = judged.select("doc_id", "lang", "source", *STATS, "base_failed", "distance", kept.alias("kept"))
        return scratch.kept(out)
