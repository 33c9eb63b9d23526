"""Composite feature engineering: fit on training rows, transform anything.

A fit runs a fixed number of aggregates; a transform is one projection plus one
broadcast lookup per categorical column and stays lazy (it also accepts a
streaming frame).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import sql
from foldloom.operators import clean, columns, derive, encode, scale
from foldloom.operators.encode import CategoryMap
from foldloom.operators.linear import fold_moments, solve_lasso
from foldloom.sources.state import load_categories, load_state, save_state

FEATURE_CAP = 50
SELECTION_RUNS = 5
#: row blocks of each selection run
RUN_BLOCKS = 2


@dataclass(frozen=True)
class ManualFeatures:
    """Impute, row statistics, pairs, unary features, encoders, de-inf, robust scale."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    names: tuple[str, ...]
    keep: tuple[str, ...]
    minimum: dict
    median: DataFrame
    categories: CategoryMap | None
    quartiles: DataFrame

    def _engineer(self, df: DataFrame) -> DataFrame:
        numeric, categorical = list(self.numeric), list(self.categorical)
        out = columns.align_inputs(df, numeric, categorical, self.keep)
        if numeric:
            out = clean.fill(columns.to_double(out, numeric), self.median, numeric, default=0.0)
        out = clean.text_or_unknown(out, categorical)
        added: dict = {}
        if len(numeric) >= 2:
            out = derive.with_row_stats(out, numeric)
            added.update(derive.pair_features(numeric))
        added.update(derive.unary_features(numeric, self.minimum))
        out = derive.derive(out, added)
        for c in categorical:
            out = encode.encode(
                out, self.categories, c, label=c, target_mean=f"{c}_target_mean", frequency=f"{c}_freq"
            )
        names = feature_names(numeric, categorical, self.minimum)
        return clean.zero_infinite(out.select(*self.keep, *names), names)

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = scale.robust_scale(self._engineer(df), self.quartiles, list(self.names))
        return columns.align_to(scaled, list(self.names), self.keep)

    def save(self, path: str) -> None:
        tables = {"median": self.median, "quartiles": self.quartiles}
        if self.categories is not None:
            tables["categories"] = self.categories.state.table
        info = dict(
            numeric=self.numeric, categorical=self.categorical, names=self.names, keep=self.keep,
            minimum=self.minimum,
        )
        save_state(path, tables, info)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ManualFeatures:
        tables, info = load_state(spark, path)
        categories = None
        if "categories" in tables:
            categories = load_categories(tables["categories"], info["categorical"])
        return ManualFeatures(
            tuple(info["numeric"]), tuple(info["categorical"]), tuple(info["names"]), tuple(info["keep"]),
            info["minimum"], tables["median"], categories, tables["quartiles"],
        )


def feature_names(numeric: Sequence[str], categorical: Sequence[str], minimum: dict) -> list[str]:
    """Engineered columns in order; the width follows from the column kinds alone."""
    names = [*numeric, *categorical]
    if len(numeric) >= 2:
        names += list(derive.ROW_STATS)
        names += list(derive.pair_features(numeric))
    names += list(derive.unary_features(numeric, minimum))
    for c in categorical:
        names += [f"{c}_target_mean", f"{c}_freq"]
    return names


def fit_manual_features(train: DataFrame, target: str, keep: Sequence[str] = ()) -> ManualFeatures:
    """Four aggregates: minima, medians, category statistics, quartiles of the result.

    ``train`` is scanned by each of them; persist it when it is the result of work.
    """
    keep = tuple(dict.fromkeys([*keep, target]))
    kinds = columns.column_kinds(train, keep)
    numeric, categorical = list(kinds.numeric), list(kinds.categorical)
    train = columns.nan_to_null(train)
    first = train.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.expr(f"min({sql.double(c)}) as {sql.name(c)}") for c in numeric],
    ).first()
    rows = first["__rows"]
    # an all-missing column is filled with 0, whose square root exists
    minimum = {c: 0.0 if first[c] is None else first[c] for c in numeric}
    median = clean.fit_median(train, numeric, rows=rows) if numeric else _no_state(train)
    categories = None
    if categorical:
        categories = encode.fit_categories(clean.text_or_unknown(train, categorical), categorical, target)
    names = feature_names(numeric, categorical, minimum)
    draft = ManualFeatures(
        tuple(numeric), tuple(categorical), tuple(names), keep, minimum, median, categories, median
    )
    quartiles = scale.fit_robust(draft._engineer(train), names, rows=rows)
    return replace(draft, quartiles=quartiles)


def _no_state(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(0,)], "unused int")


@dataclass(frozen=True)
class CleanFeatures:
    """Label encode, mean impute, drop constant columns, log-normalise, de-inf."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    selected: tuple[str, ...]
    keep: tuple[str, ...]
    categories: CategoryMap | None
    means: DataFrame
    moments: DataFrame | None
    limits: DataFrame | None

    def _encoded(self, df: DataFrame) -> DataFrame:
        out = columns.align_inputs(df, self.numeric, self.categorical, self.keep)
        out = clean.text_or_unknown(columns.nan_to_null(out), list(self.categorical))
        for c in self.categorical:
            out = encode.encode(out, self.categories, c, label=c, unseen="mode")
        both = [*self.numeric, *self.categorical]
        return clean.fill(columns.to_double(out, both), self.means, both, default=0.0).select(*self.keep, *both)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._encoded(df).select(*self.keep, *self.selected)
        out = scale.log_normalise(out, self.moments, list(self.selected))
        names = list(self.selected)
        if self.limits is None:
            return clean.zero_infinite(out, names)
        return clean.clip_infinite(out, self.limits, names)

    def save(self, path: str) -> None:
        tables = {"means": self.means, "moments": self.moments, "limits": self.limits}
        if self.categories is not None:
            tables["categories"] = self.categories.state.table
        info = dict(numeric=self.numeric, categorical=self.categorical, selected=self.selected, keep=self.keep)
        save_state(path, {n: t for n, t in tables.items() if t is not None}, info)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CleanFeatures:
        tables, info = load_state(spark, path)
        categories = None
        if "categories" in tables:
            categories = load_categories(tables["categories"], info["categorical"])
        return CleanFeatures(
            tuple(info["numeric"]), tuple(info["categorical"]), tuple(info["selected"]), tuple(info["keep"]),
            categories, tables["means"], tables.get("moments"), tables.get("limits"),
        )


def fit_clean_features(
    train: DataFrame, target: str, keep: Sequence[str] = (), test: DataFrame | None = None
) -> CleanFeatures:
    """State comes from ``train``; ``test`` only contributes category names to the codes."""
    keep = tuple(dict.fromkeys([*keep, target]))
    kinds = columns.column_kinds(train, keep)
    numeric, categorical = list(kinds.numeric), list(kinds.categorical)
    text = clean.text_or_unknown(train, categorical)
    categories = None
    if categorical:
        also = clean.text_or_unknown(test.select(*categorical), categorical) if test is not None else None
        categories = encode.fit_categories(text, categorical, also=also)
    both = [*numeric, *categorical]
    coded = columns.nan_to_null(text)
    for c in categorical:
        coded = encode.encode(coded, categories, c, label=c, unseen="mode")
    means = clean.fit_mean(coded, both)
    draft = CleanFeatures(tuple(numeric), tuple(categorical), tuple(both), keep, categories, means, None, None)
    filled = draft._encoded(train)
    dropped = set(columns.constant_columns(filled, both))
    selected = [c for c in both if c not in dropped]
    slim = filled.select(*keep, *selected)
    moments = scale.fit_log_normal(slim, selected)
    scaled = scale.log_normalise(slim, moments, selected)
    # the scaled columns are finite unless the input was not: only then percentiles are needed
    rows, bad = scaled.agg(
        F.count(F.lit(1)), clean.infinite_cells(columns.column_kinds(scaled, keep))
    ).first()
    limits = clean.fit_clip(scaled, selected, rows=rows) if bad else None
    return replace(draft, selected=tuple(selected), moments=moments, limits=limits)


def auto_candidates(names: Sequence[str], minimum: dict) -> dict:
    """One unary step: log where positive, sqrt where not negative, abs where negatives occur."""
    out = {}
    for c in names:
        x, low = sql.double(c), minimum.get(c)
        if low is None:
            continue
        if low > 0:
            out[f"log({c})"] = f"ln(greatest({x}, {low!r}D))"
        if low >= 0:
            out[f"sqrt({c})"] = f"sqrt(greatest({x}, 0D))"
        else:
            out[f"abs({c})"] = f"abs({x})"
    return out


def select_features(
    df: DataFrame, names: Sequence[str], target: str, cap: int = FEATURE_CAP, alpha: float = 0.0005,
    runs: int = SELECTION_RUNS,
) -> list[str]:
    """Features by importance: votes of L1 models on standardised columns, mean weight, abs correlation.

    Rows are dealt into blocks by a hash of their values; each run leaves out its blocks.  All runs come from
    one scan, as second moments per block are added and subtracted; at most ``cap`` features are
    kept, which is the limit of the operator itself.
    """
    moments = scale.fit_standard(df, [*names, target])
    block = F.pmod(F.xxhash64(*names, target), F.lit(RUN_BLOCKS * runs)).cast("int")
    z = scale.standard_scale(df.withColumn("__block", block), moments, [*names, target])
    sums = fold_moments(z, names, target, "__block")
    p = len(names)
    n, _, products = sums.total()
    left_out = [{b for b in sums.parts if b % runs == r} for r in range(runs)] if runs > 1 else [set()]
    weights = [np.abs(solve_lasso(sums, alpha, out)[:p]) for out in left_out if sums.total(out)[0]]
    votes, weight = sum((w > 0).astype(int) for w in weights), sum(weights) / len(weights)
    corr = [abs(products[i, p]) / max(n, 1) for i in range(p)]
    order = sorted(range(p), key=lambda i: (-votes[i], -weight[i], -corr[i], names[i]))
    return [names[i] for i in order][:cap]


@dataclass(frozen=True)
class SelectedFeatures:
    names: tuple[str, ...]
    minimum: dict
    selected: tuple[str, ...]
    keep: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        made = {n: e for n, e in auto_candidates(self.names, self.minimum).items() if n in self.selected}
        out = derive.derive(df, made)
        return out.selectExpr(
            *self.keep, *[f"{sql.finite_or_zero(c)} as {sql.name(c)}" for c in self.selected]
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        minimum = spark.createDataFrame(list(self.minimum.items()), "column string, minimum double")
        info = dict(names=self.names, selected=self.selected, keep=self.keep)
        save_state(path, {"minimum": minimum}, info)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SelectedFeatures:
        tables, info = load_state(spark, path)
        minimum = {r["column"]: r["minimum"] for r in tables["minimum"].collect()}
        return SelectedFeatures(tuple(info["names"]), minimum, tuple(info["selected"]), tuple(info["keep"]))


def fit_auto_features(
    train: DataFrame, target: str, keep: Sequence[str] = (), cap: int = FEATURE_CAP
) -> SelectedFeatures:
    """Originals plus one unary step, selected by importance."""
    keep = tuple(dict.fromkeys([*keep, target]))
    numeric = list(columns.column_kinds(train, keep).numeric)
    minimum = derive.fit_minimum(train, numeric).first().asDict()
    made = auto_candidates(numeric, minimum)
    safe = {n: f"f{i}" for i, n in enumerate([*numeric, *made])}
    made_frame = derive.derive(train, made)
    wide = made_frame.selectExpr(
        f"{sql.double(target)} as {sql.name(target)}",
        *[f"{sql.finite_or_zero(n)} as {s}" for n, s in safe.items()],
    )
    back = {v: k for k, v in safe.items()}
    constant = set(columns.constant_columns(wide, list(back)))
    chosen = select_features(wide, [c for c in back if c not in constant], target, cap)
    return SelectedFeatures(tuple(numeric), minimum, tuple(back[c] for c in chosen), keep)


def clean_for_folds(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Median/mode impute, label encode, numeric only, infinities to the median, target too."""
    kinds = columns.column_kinds(df, [*keep, target])
    numeric, categorical = list(kinds.numeric), list(kinds.categorical)
    both = [*numeric, target]
    out = columns.nan_to_null(columns.to_double(df, both))
    rows, infinite = out.agg(
        F.count(F.lit(1)), clean.infinite_cells(columns.ColumnKinds(tuple(both), (), ()))
    ).first()
    out = clean.fill(out, clean.fit_median(out, both, rows=rows), both)
    if categorical:
        out = clean.fill(out, clean.fit_mode(out, categorical), categorical, default="unknown")
        codes = encode.fit_categories(out, categorical)
        for c in categorical:
            out = encode.encode(out, codes, c, label=c)
    out = columns.numeric_only(out.select(*df.columns), keep)
    if not infinite:
        return out
    finite_part = clean.infinite_to_null(out, both)
    return clean.fill(finite_part, clean.fit_median(finite_part, both, rows=rows), both)


def clean_for_search(
    df: DataFrame, target: str, keep: Sequence[str] = (), classification: bool = False
) -> DataFrame:
    """Mean/mode impute, label encode, z-score; a text class target becomes codes."""
    kinds = columns.column_kinds(df, [*keep, target])
    numeric, categorical = list(kinds.numeric), list(kinds.categorical)
    out = columns.nan_to_null(df)
    if numeric:
        out = clean.fill(columns.to_double(out, numeric), clean.fit_mean(out, numeric), numeric, default=0.0)
    if categorical:
        out = clean.fill(out, clean.fit_mode(out, categorical), categorical, default="unknown")
        codes = encode.fit_categories(out, categorical)
        for c in categorical:
            out = encode.encode(out, codes, c, label=c)
    both = [*numeric, *categorical]
    out = out.select(*keep, target, *both)
    out = scale.standard_scale(out, scale.fit_standard(out, both), both)
    if classification and dict(out.dtypes)[target] == "string":
        labels = encode.fit_categories(out, [target])
        out = encode.encode(out, labels, target, label=target)
    return out.select(*keep, target, *both)
