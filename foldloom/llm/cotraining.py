"""Quality classifier by co-training.

Two classifiers see different things: one the text (hashed words and a few statistics), one the page
metadata (source, language, size band).  Both are fitted on labelled documents.  In each round, each
labels those unlabelled documents about which it is confident, and some of them join the other's
training rows.  A view may hand over a class only if, on held-out labels, it is right about that
class as often as its confidence says; a view that knows too little hands over nothing.  Margins are
calibrated on the held-out rows, the calibrated views are combined there, and all documents are
scored by whole text.

A round is one pass over all documents.  What is bounded is the rows of a fit: at most ``LABELLED`` labelled
documents, those that come first by a hash of doc_id (one in ``HELD_OUT`` of each class held out), and about
``CHOSEN`` confident ones per view and class, drawn by a hash in equal numbers from every source and language that has
them.  A fit of that size is one task; the driver gets weights and held-out margins.  A document is good
if its quality label is 1 and its toxic label is not.

Defined cases: null text, source, language or size count as empty ones; labels without quality are
left out, and of labels that contradict each other the worse holds; of rows that share a doc_id the shortest text
is learned from (ties: the smaller one); where train or held-out rows lack a class nothing is learned, documents labelled
bad are rejected and all others kept, with the share of good labels (1 without any) as probability; a good_probability of
exactly ``THRESHOLD`` is kept; rows that repeat are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch, first_by_hash, small_side
from foldloom.llm.text_stats import per_row
from foldloom.llm.words import HASHED_BYTES, released, slices, word_hashes, words_of

LABELLED = 20_000
CHOSEN = 5_000
ROUNDS = 2
HELD_OUT = 5  # one in so many labelled documents
CONFIDENT = 0.97
LEAST_EVIDENCE = 20
WORD_FEATURES = 1 << 15
PAGE_FEATURES = 1 << 15
THRESHOLD = 0.5
STRENGTH = 1e-2
ITERATIONS = 25
#: past steps that a fit remembers
MEMORY = 10
#: entries of a fit that are multiplied at a time
CHUNK = 1 << 19
VIEWS = ("text", "page")
PAGE_COLUMNS = ("_page0", "_page1", "_page2")
STATS = 5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>!"]] = True


@dataclass
class Sparse:
    """Rows of a few features each: entry k says that row[k] has value[k] at at[k].  ``dense`` are features that all have."""

    rows: int
    size: int
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray
    dense: np.ndarray

    @property
    def width(self) -> int:
        return self.size + self.dense.shape[1]

    def _chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries by runs, so that what is made of them stays small."""
        for i in range(0, len(self.row), CHUNK):
            yield self.row[i : i + CHUNK], self.at[i : i + CHUNK], self.value[i : i + CHUNK]

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = self.dense @ weights[self.size :]
        for row, at, value in self._chunks():
            out += np.bincount(row, value * weights[at], self.rows)
        return out

    def turned(self, values: np.ndarray, power: int = 1) -> np.ndarray:
        """Of every feature, the sum of ``values`` by its values to a power."""
        out = np.zeros(self.size)
        for row, at, value in self._chunks():
            out += np.bincount(at, value**power * values[row], self.size)
        return np.concatenate((out, values @ self.dense**power))


def text_rows(texts: pa.Array) -> Sparse:
    """Hashed distinct words, each row of length one together, and statistics of the texts."""
    words = words_of(texts)
    n, rows = words.counts, len(words.counts)
    feature = (word_hashes(words) >> np.uint64(20)).astype(np.int64) % WORD_FEATURES
    held = np.unique(np.repeat(np.arange(rows), n) * WORD_FEATURES + feature)
    row, at = held // WORD_FEATURES, held % WORD_FEATURES
    distinct = np.bincount(row, minlength=rows)
    data, offsets = words.data, words.offsets
    upper = (data >= 65) & (data <= 90)
    pairs = np.zeros(len(data), bool)
    pairs[:-1] = upper[:-1] & upper[1:]
    least = np.maximum(n, 1)
    stats = np.column_stack(
        (
            np.log1p(n),
            per_row((data & 0xC0) != 0x80, offsets) / least,
            distinct / least,
            np.log1p(per_row(SYMBOL[data], offsets) / least),
            np.log1p(per_row(pairs, offsets) / least),
        )
    )
    return Sparse(rows, WORD_FEATURES, row, at, 1 / np.sqrt(distinct[row]), stats)


def page_rows(columns: list[np.ndarray]) -> Sparse:
    at = np.column_stack(columns).astype(np.int64).reshape(-1, len(columns))
    row = np.repeat(np.arange(len(at)), len(columns))
    return Sparse(len(at), PAGE_FEATURES, row, at.ravel(), np.ones(at.size), np.zeros((len(at), 0)))


def page_features() -> list[F.Column]:
    """Hashed source, language and size band: three of PAGE_FEATURES indicators."""
    band = F.floor(F.log2(F.coalesce(F.col("n_chars"), F.lit(0)).cast("double") + 1)).cast("string")
    values = {"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), "band": F.coalesce(band, F.lit(""))}
    return [
        F.pmod(F.xxhash64(F.lit(kind), value), F.lit(PAGE_FEATURES)).cast("int").alias(name)
        for name, (kind, value) in zip(PAGE_COLUMNS, values.items(), strict=True)
    ]


def fitted(x: Sparse, good: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Weights of a ridge logistic regression, the offset last, by limited-memory quasi-Newton steps.

    Features are divided by their spread, so the penalty treats rare and common ones alike.
    """
    n = max(len(good), 1)
    ones = np.ones(x.rows)
    spread = np.sqrt(np.maximum(x.turned(ones, 2) / n - (x.turned(ones) / n) ** 2, 0))
    unit = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.clip(x.times(unit * w[:-1]) + w[-1], -30, 30)
        slope = (1 / (1 + np.exp(-m)) - good) / n
        value = (np.logaddexp(0, m) - good * m).sum() / n + strength / 2 * (w[:-1] @ w[:-1])
        return value, np.append(unit * x.turned(slope) + strength * w[:-1], slope.sum())

    w = np.zeros(x.width + 1)
    share = np.clip(good.mean() if len(good) else 0.5, 1e-6, 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ITERATIONS):
        step, used = -slope, []
        for s, y in reversed(past):
            a = (s @ step) / (s @ y)
            used.append(a)
            step = step - a * y
        if past:
            step = step * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, y), a in zip(past, reversed(used), strict=True):
            step = step + s * (a - (y @ step) / (s @ y))
        size = 1.0 if past else 1 / max(np.abs(slope).sum(), 1.0)
        for _ in range(30):
            moved, new = loss(w + size * step)
            if moved <= value + 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        s, y = size * step, new - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-MEMORY:]
        done = abs(value - moved) <= 1e-7 * max(abs(value), 1e-12)
        w, value, slope = w + s, moved, new
        if done:
            break
    return np.append(w[:-1] * unit, w[-1])


def logistic(at: np.ndarray, values: np.ndarray, good: np.ndarray, size: int, strength: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the offset.

    Row i has values[i, k] at feature at[i, k]; a feature may occur twice in a row.
    """
    at = np.column_stack((at, np.full(len(at), size)))
    values = np.column_stack((values, np.ones(len(values))))
    weights = np.zeros(size + 1)
    penalty = np.append(np.full(size, strength * len(good)), 1e-6)
    flat = (at[:, :, None] * (size + 1) + at[:, None, :]).ravel()
    outer = values[:, :, None] * values[:, None, :]
    for _ in range(ITERATIONS):
        p = 1 / (1 + np.exp(-np.clip((values * weights[at]).sum(axis=1), -30, 30)))
        slope = np.bincount(at.ravel(), (values * (p - good)[:, None]).ravel(), size + 1) + penalty * weights
        bend = np.bincount(flat, (outer * (p * (1 - p))[:, None, None]).ravel(), (size + 1) ** 2)
        step = np.linalg.solve(bend.reshape(size + 1, size + 1) + np.diag(penalty + 1e-9), slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def calibration(margins: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights that turn margins (one column per view) into the log-odds seen on held-out rows, and an offset."""
    views = margins.shape[1]
    at = np.tile(np.arange(views), (len(margins), 1))
    return logistic(at, margins, good, views, 1e-4)


def limits(held_margin: np.ndarray, held_good: np.ndarray) -> tuple[float, float, float, float]:
    """slope, offset, and the probabilities from which a view may hand over good and bad (2 and -1: never)."""
    slope, offset = calibration(held_margin[:, None], held_good)
    p = 1 / (1 + np.exp(-np.clip(slope * held_margin + offset, -30, 30)))
    allowed = []
    for good, side, never in ((1, p >= CONFIDENT, 2.0), (0, p <= 1 - CONFIDENT, -1.0)):
        n = side.sum()
        right = n >= LEAST_EVIDENCE and (held_good[side] == good).sum() >= CONFIDENT * n
        allowed.append((CONFIDENT if good else 1 - CONFIDENT) if right else never)
    return float(slope), float(offset), *allowed


def handed_over(margin: F.Column, held_margin: np.ndarray, held_good: np.ndarray) -> F.Column:
    """The label that a view may hand over: 1, 0, or null for none."""
    slope, offset, high, low = limits(held_margin, held_good)
    p = 1 / (1 + F.exp(-(margin * slope + F.lit(offset))))
    return F.when(p >= high, 1.0).when(p <= low, 0.0)


@dataclass
class Classifier:
    """Two fitted views, their calibrations, and the weights that combine their margins."""

    text_weights: np.ndarray
    page_weights: np.ndarray
    held_margins: np.ndarray
    held_good: np.ndarray

    def margins(self, docs: DataFrame, *also: str) -> DataFrame:
        """doc_id, ``also``, text_margin and page_margin of every document, by whole text."""
        text, page = self.text_weights, self.page_weights
        names = ["doc_id", *also]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", HASHED_BYTES):
                    x = text_rows(part.column("text"))
                    pages = page_rows([part.column(c).to_numpy() for c in PAGE_COLUMNS])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[part.column(c) for c in names],
                            pa.array(x.times(text[:-1]) + text[-1]), pa.array(pages.times(page[:-1]) + page[-1]),
                        ],
                        [*names, "text_margin", "page_margin"],
                    )

        rows = docs.select(*names, "text", *page_features())
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
        return rows.mapInArrow(lambda batches: released(scored(batches)), f"{kinds}, text_margin double, page_margin double")

    def score(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """doc_id, text_probability, page_probability, good_probability and kept of every document."""
        scales = {v: calibration(self.held_margins[:, [i]], self.held_good) for i, v in enumerate(VIEWS)}
        joint = calibration(self.held_margins, self.held_good)

        def probability(weights: np.ndarray, views: tuple[str, ...]) -> F.Column:
            terms = [F.col(f"{v}_margin") * float(w) for v, w in zip(views, weights, strict=False)]
            return 1 / (1 + F.exp(-sum(terms, F.lit(float(weights[-1])))))

        quality = probability(joint, VIEWS)
        return self.margins(docs).select(
            "doc_id",
            *[probability(scales[v], (v,)).alias(f"{v}_probability") for v in VIEWS],
            quality.alias("good_probability"),
            (quality >= threshold).alias("kept"),
        )


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and good (1.0 or 0.0), one row each."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = labels.filter("doc_id is not null and quality is not null").select("doc_id", good.cast("double").alias("good"))
    return rows.groupBy("doc_id").agg(F.min("good").alias("good"))


FEATURES = "doc_id long, part string, good double, words binary, stats binary, _page0 int, _page1 int, _page2 int"


def _featured(rows: DataFrame) -> DataFrame:
    """``FEATURES`` of rows that have doc_id, part, good, text and the page columns."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED_BYTES):
                words = text_rows(part.column("text"))
                cuts = np.searchsorted(words.row, np.arange(part.num_rows + 1))
                made = {
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "words": pa.array([words.at[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    "stats": pa.array([r.astype("<f8").tobytes() for r in words.dense], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(c) if c not in made else None) for c in names], names)

    return rows.select("doc_id", "part", "good", "text", *PAGE_COLUMNS).mapInArrow(lambda batches: released(computed(batches)), FEATURES)


def _once(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: that of the shortest text, ties to the smaller one."""
    columns = [c for c in rows.columns if c != "doc_id"]
    best = F.min_by(F.struct(*columns), F.struct(F.coalesce(F.octet_length("text"), F.lit(0)), F.col("text")))
    return rows.groupBy("doc_id").agg(best.alias("_row")).select("doc_id", "_row.*")


def _sample(docs: DataFrame, known: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``FEATURES`` of the bounded labelled sample; part is train or held, by rank of a hash in each class."""
    named = docs.select("doc_id").join(small_side(known.select("doc_id")), "doc_id", "left_semi").distinct()
    chosen = scratch.save(first_by_hash(named, "doc_id", most, 17).join(known, "doc_id"))
    rank = f"row_number() over (partition by good order by xxhash64(23, doc_id), doc_id) % {HELD_OUT} = 1"
    # at most ``most`` ids
    chosen = chosen.withColumn("part", F.expr(f"if({rank}, 'held', 'train')"))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "part", "good", "text", *page_features())
    return scratch.save(_featured(_once(rows)))


FITTED = "text binary, page binary, margins binary, good binary"


def _fit(table: pa.Table) -> pa.Table:
    """Both views from the rows of a fit; none if train or held-out rows lack a class."""
    table = table.sort_by([("doc_id", "ascending"), ("part", "ascending")])
    part = np.array(table["part"].to_pylist())
    good = table["good"].to_numpy().astype(float)
    held = part == "held"
    if any(not (good[part == name] == value).any() for name in ("train", "held") for value in (0, 1)):
        return pa.table({f.split()[0]: pa.array([], pa.binary()) for f in FITTED.split(", ")})
    words = [np.frombuffer(w.as_buffer(), "<i4") for w in table["words"]]
    stats = np.array([np.frombuffer(x.as_buffer(), "<f8") for x in table["stats"]]).reshape(-1, STATS)
    pages = np.column_stack([table[c].to_numpy() for c in PAGE_COLUMNS])

    def of(rows: np.ndarray, view: str) -> Sparse:
        place = np.flatnonzero(rows)
        if view == "page":
            return page_rows(list(pages[place].T))
        sizes = np.array([len(words[i]) for i in place])
        row = np.repeat(np.arange(len(place), dtype=np.int32), sizes)
        value = np.repeat((1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32), sizes)
        at = np.concatenate([words[i] for i in place])
        return Sparse(len(place), WORD_FEATURES, row, at, value, stats[place])

    weights, margins = {}, []
    for view in VIEWS:
        own = np.isin(part, ["train", f"for {view}"])
        weights[view] = fitted(of(own, view), good[own])
        margins.append(of(held, view).times(weights[view][:-1]) + weights[view][-1])
    values = [weights["text"], weights["page"], np.column_stack(margins), good[held]]
    return pa.table([pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in values], names=["text", "page", "margins", "good"])


def _chosen(docs: DataFrame, model: Classifier, known: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``FEATURES`` of confident unlabelled documents; part names the view that they are for."""
    scored = model.margins(docs, "source", "lang")
    given = [
        F.struct(
            F.lit(f"for {other}").alias("part"),
            handed_over(F.col(f"{view}_margin"), model.held_margins[:, i], model.held_good).alias("good"),
        )
        for i, (view, other) in enumerate(zip(VIEWS, VIEWS[::-1], strict=True))
    ]
    sure = scored.select("doc_id", "source", "lang", F.inline(F.array(*given))).filter("good is not null")
    sure = scratch.save(sure.join(small_side(known.select("doc_id")), "doc_id", "left_anti").distinct())
    stratum = ["part", "good", "source", "lang"]
    counts = sure.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n"))
    strata = {(r["part"], r["good"]): r["strata"] for r in counts.groupBy("part", "good").agg(F.count(F.lit(1)).alias("strata")).collect()}
    if not strata:
        return sure.limit(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in FEATURES.split(", ")])
    quota = F.coalesce(*[F.when((F.col("part") == p) & (F.col("good") == g), F.lit(most / n)) for (p, g), n in strata.items()])
    counts = scratch.save(counts.withColumn("share", quota / F.col("n")).drop("n"))
    renamed = counts.select("share", *[F.col(c).alias(f"_{c}") for c in stratum])
    match = [sure[c].eqNullSafe(renamed[f"_{c}"]) for c in stratum]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(31), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = sure.join(small_side(renamed), match).filter(draw < F.col("share")).select("doc_id", "part", "good")
    # about ``most`` rows per view and class
    drawn = scratch.save(drawn.distinct())
    ids = F.broadcast(drawn.select("doc_id").distinct())
    rows = _once(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text", *page_features()))
    return scratch.save(_featured(rows.join(F.broadcast(drawn), "doc_id")))


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = LABELLED, chosen: int = CHOSEN, rounds: int = ROUNDS
) -> Classifier | None:
    """The classifier, or None where it cannot be learned."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null")
    known = scratch.save(labelled(labels))
    sample = _sample(docs, known, scratch, most)
    rows, model = sample, None
    for turn in range(rounds + 1):
        # the rows of a fit are bounded, see above
        found = rows.withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(_fit, FITTED).first()
        if found is None:
            return None
        text, page, margins, good = (np.frombuffer(bytes(found[c]), "<f8") for c in ("text", "page", "margins", "good"))
        model = Classifier(text, page, margins.reshape(-1, len(VIEWS)), good)
        if turn == rounds:
            break
        extra = _chosen(docs, model, known, scratch, chosen)
        if extra.isEmpty():
            break
        rows = sample.unionByName(extra)
    return model


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sizes: int) -> DataFrame:
    """doc_id, text_probability, page_probability, good_probability and kept of every document."""
    with Scratch(docs.sparkSession) as scratch:
        found = fit(docs, labels, scratch, **sizes)
        if found is not None:
            return found.score(docs, threshold)
        known = labelled(labels)
        share = known.agg(F.coalesce(F.avg("good"), F.lit(1.0))).first()[0]
        bad = scratch.kept(known.filter("good = 0").select(F.col("doc_id").alias("_bad")))
    rows = docs.select("doc_id").join(small_side(bad), F.col("doc_id") == F.col("_bad"), "left")
    share = F.lit(float(share))
    return rows.select(
        "doc_id",
        *[share.alias(f"{v}_probability") for v in VIEWS],
        share.alias("good_probability"),
        F.col("_bad").isNull().alias("kept"),
    )
