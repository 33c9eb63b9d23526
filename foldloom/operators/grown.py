"""Regression trees for every (dataset, held-out fold, trial) at once, grown level by level.

Features are cut into bins once.  At each level one pass over the rows adds up, for every open node of
every tree, the weight, sum and sum of squares of the target by feature and bin; where the sums of a
node meet, its best split is found, and only splits reach the driver.  So the number of jobs follows the
depth (times the rounds, for boosting), not datasets, folds, trials or trees.  All trees
of a forest grow side by side; boosted trials grow their trees one after another, beside all else.

Rows with the same bins are one cell: they go the same way in every tree.  Where a (dataset, held-out fold) has few
cells, one pass adds up weight, target and its square by tree and cell, whatever the number of trees, rounds and levels;
whole trees then grow where the sums of a tree (of a boosted trial: of all its rounds) meet, from cells instead of rows.
They stay in a stored table until they are asked for; what each trial predicts for each cell reaches the driver.

A node is split where the variance falls most (ties: the first feature, then the lowest cut); it stays a leaf at
the depth limit, where no split leaves enough rows on both sides, or where nothing is gained.  Bootstrap
weights and feature subsets come from hashes of row, trial, tree and node, so a task that runs again
gives the same sums.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.packed import HELD_BYTES, Block, Layout, Packed, blocks, collected, keyed_sums, partial_sums
from foldloom.session import checkpointed

BINS = 32
#: equally wide cells of a feature's range, of which cuts are chosen
CELLS = 1024
SEED = 42
MAX_DEPTH = 30
#: distinct rows of bins of a (dataset, held-out fold) from which its trees grow as a whole
KEPT_CELLS = 1 << 14
#: nodes that are held by the driver from the start
HELD_NODES = 200_000
SPLITS = (
    "dataset string, held_out int, task int, part int, feature int, bin int, gain double, "
    "w double, s double, ss double, wl double, sl double, ssl double"
)
#: feature matrix of a block for a held-out fold: (block, place of the fold, fold)
Features = Callable[[Block, int, int], np.ndarray]
Key = tuple[str, int]


@dataclass(frozen=True)
class TreeSpec:
    """A trial; ``kind`` is tree, forest or boosted."""

    trial: int
    kind: str = "tree"
    trees: int = 1
    depth: int = 5
    min_leaf: float = 1
    min_split: float = 2
    #: features tried at a node: all, sqrt, log2, or a share; for boosting the share is drawn per tree
    subset: str | float = "all"
    #: share of the rows that a tree sees; a forest draws them with replacement
    sample: float = 1.0
    rate: float = 0.1
    seed: int = SEED

    def width(self, features: int) -> int:
        if self.subset in ("all", None):
            return features
        if self.subset in ("sqrt", "log2"):
            return max(1, int(np.ceil(np.sqrt(features) if self.subset == "sqrt" else np.log2(max(features, 2)))))
        return max(1, min(features, int(np.ceil(float(self.subset) * features))))

    def tried(self, tree: int, node: int, features: int) -> np.ndarray:
        width = self.width(features)
        if width >= features:
            return np.arange(features)
        return _drawn((self.seed, self.trial, tree, 0 if self.kind == "boosted" else node), features, width)

    def weights(self, tree: int, row_id: np.ndarray) -> np.ndarray:
        if self.kind == "forest" and self.trees > 1:
            return _poisson(_uniform(row_id, self.seed, self.trial, tree), self.sample)
        if self.sample < 1:
            return (_uniform(row_id, self.seed, self.trial, tree) < self.sample).astype(float)
        return np.ones(len(row_id))


@lru_cache(maxsize=1 << 16)
def _drawn(salt: tuple[int, ...], features: int, width: int) -> np.ndarray:
    """Some of the features; a draw takes longer than a split, and datasets and folds share it."""
    return np.sort(np.random.default_rng(list(salt)).permutation(features)[:width])


def _uniform(row_id: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) from a hash of row and salt."""
    h = row_id.astype(np.int64).view(np.uint64)
    for s in (*salt, 0):
        h = (h ^ np.uint64(s & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(11)) / float(1 << 53)


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    term = total = np.exp(-mean)
    out = np.zeros(len(u))
    most = u.max(initial=0.0)
    for k in range(1, 200):
        if most < total:
            break
        out += u >= total
        term *= mean / k
        total += term
    return out


@dataclass
class Tree:
    """Nodes by number; ``feature`` is -1 at a leaf, the children are ``left`` and ``left`` + 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])
    #: nodes to be split at this level
    open: list[int] = field(default_factory=lambda: [0])

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        """The node at which each row stands."""
        feature, cut, left = (np.array(v) for v in (self.feature, self.bin, self.left))
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(max(self.level)):
            f = feature[node]
            inner = f >= 0
            node = np.where(inner, left[node] + (binned[rows, f] > cut[node]), node)
        return node

    def predict(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(binned)]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value; the rows of bin b and below are those up to cut b."""
    out = np.empty(x.shape, np.int32)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], "left")
    return out


def cuts_of(counts: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Cuts half-way between neighbouring filled cells: all of them, or those nearest to equal shares of the rows."""
    full = np.flatnonzero(counts > 0)
    between = (high[full[:-1]] + low[full[1:]]) / 2
    if len(between) < bins:
        return between
    below = np.cumsum(counts[full])[:-1]
    wanted = counts.sum() * np.arange(1, bins) / bins
    right = np.clip(np.searchsorted(below, wanted), 1, len(below) - 1)
    nearer = np.where(wanted - below[right - 1] <= below[right] - wanted, right - 1, right)
    return between[np.unique(nearer)]


def fit_cuts(
    packed: Packed, features: Features, bins: int = BINS
) -> tuple[dict[Key, list[np.ndarray]], dict[Key, float]]:
    """Cuts of every feature and the mean label per (dataset, held-out fold), from labelled training rows: two passes."""

    def training(block: Block, layout: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at, held_out in enumerate(layout.folds):
            rows = block.take(np.flatnonzero((block.fold != held_out) & ~np.isnan(block.y)))
            if len(rows.y):
                yield held_out, features(rows, at, held_out), rows.y

    def spans(block: Block, layout: Layout):
        for held_out, x, y in training(block, layout):
            yield held_out, 0, "sum", np.array([[len(y), y.sum()]])
            if x.shape[1]:
                yield held_out, 0, "min", x.min(0)[None, :]
                yield held_out, 0, "max", x.max(0)[None, :]

    span: dict[Key, dict[str, np.ndarray]] = {}
    for (d, h, _, op), v in collected(keyed_sums(packed, spans)).items():
        span.setdefault((d, h), {})[op] = v[0]

    def cells(block: Block, layout: Layout):
        for held_out, x, _ in training(block, layout):
            if not x.shape[1]:
                continue
            low, high = span[block.dataset, held_out]["min"], span[block.dataset, held_out]["max"]
            width = np.where(high > low, high - low, 1.0)
            cell = np.minimum(((x - low) / width * CELLS).astype(np.int64), CELLS - 1)
            flat = (cell + np.arange(x.shape[1]) * CELLS).ravel()
            size, shape = x.shape[1] * CELLS, (x.shape[1], CELLS)
            least, most = np.full(size, np.inf), np.full(size, -np.inf)
            np.minimum.at(least, flat, x.ravel())
            np.maximum.at(most, flat, x.ravel())
            yield held_out, 0, "sum", np.bincount(flat, minlength=size).reshape(shape)
            yield held_out, 0, "min", least.reshape(shape)
            yield held_out, 0, "max", most.reshape(shape)

    found = collected(keyed_sums(packed, cells))
    cuts = {
        (d, h): [cuts_of(*parts, bins) for parts in zip(*(found[d, h, 0, op] for op in ("sum", "min", "max")), strict=True)]
        if "min" in own
        else []
        for (d, h), own in span.items()
    }
    return cuts, {key: own["sum"][1] / own["sum"][0] for key, own in span.items()}


class Trees(dict):
    """Trees by (dataset, held-out fold, trial); those of a stored table are read when one of them is asked for."""

    stored: DataFrame | None = None

    def __missing__(self, key: tuple[str, int, int]) -> list[Tree]:
        if self.stored is None:
            raise KeyError(f"trees of {key} are not held here; ask for them on the driver first")
        rows, self.stored = self.stored.drop("at"), None
        for batch in rows.orderBy("dataset", "held_out", "trial", "tree").toArrow().to_batches(max_chunksize=1000):
            for r in batch.to_pylist():
                nodes = [array(code, r[name]) for name, code in _NODES.items()]
                self.setdefault((r["dataset"], r["held_out"], r["trial"]), []).append(Tree(*nodes, open=[]))
        return self[key]

    def __reduce__(self):
        return Trees, (dict(self),)


@dataclass
class Grown:
    """The trees of every (dataset, held-out fold) and trial."""

    cuts: Mapping[Key, list[np.ndarray]]
    #: mean label; the trees predict deviations from it
    center: Mapping[Key, float]
    specs: Mapping[int, TreeSpec]
    trees: Trees
    #: codes of the cells in order, where these are few
    cells: Mapping[Key, np.ndarray] = field(default_factory=dict)
    #: what a trial predicts for each of them
    tables: dict[tuple[str, int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, dataset: str, held_out: int, trial: int, x: np.ndarray) -> np.ndarray:
        key = (dataset, held_out)
        bins = binned(x, self.cuts[key])
        out = np.empty(len(bins))
        rest = np.ones(len(bins), bool)
        if key in self.cells:
            codes = coded(bins, self.cuts[key])
            at = np.minimum(np.searchsorted(self.cells[key], codes), len(self.cells[key]) - 1)
            rest = self.cells[key][at] != codes
            out[~rest] = self.tables[*key, trial][at[~rest]]
        if rest.any():
            out[rest] = self.combined(trial, self.trees[*key, trial], bins[rest])
        return self.center[key] + out

    def combined(self, trial: int, trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
        if not trees:
            return np.zeros(len(bins))
        each = [t.predict(bins) for t in trees]
        if self.specs[trial].kind == "boosted":
            return each[0] + self.specs[trial].rate * sum(each[1:], np.zeros(len(bins)))
        return sum(each) / len(each)


def best_split(numbers: np.ndarray, tried: np.ndarray, spec: TreeSpec) -> tuple:
    """feature, bin, gain, then weight, sum, sum of squares of the node and of its left side; gain 0 without a split."""
    whole = numbers[0].sum(0)
    w, s, ss = whole
    left = np.cumsum(numbers[tried], axis=1)[:, :-1]
    right = whole - left
    impurity = lambda v: np.maximum(v[..., 2] - v[..., 1] ** 2 / np.maximum(v[..., 0], 1e-300), 0.0)
    allowed = (left[..., 0] >= spec.min_leaf) & (right[..., 0] >= spec.min_leaf) & (left[..., 0] > 0) & (right[..., 0] > 0)
    own = max(ss - s * s / w, 0.0) if w > 0 else 0.0
    gain = np.where(allowed, own - impurity(left) - impurity(right), -np.inf)
    if w < spec.min_split or not gain.size or own <= 1e-12 * max(ss, 1e-300) or gain.max() <= 1e-12 * own:
        return -1, 0, 0.0, w, s, ss, 0.0, 0.0, 0.0
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(tried[f]), int(b), float(gain[f, b] / w), w, s, ss, *left[f, b])


def coded(bins: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A number for every row of bins."""
    out = np.zeros(len(bins), np.int64)
    for i, c in enumerate(cuts):
        out = out * (len(c) + 1) + bins[:, i]
    return out


def decoded(codes: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(codes), max(len(cuts), 1)), np.int64)
    for i in reversed(range(len(cuts))):
        codes, out[:, i] = np.divmod(codes, len(cuts[i]) + 1)
    return out


def _cells(packed: Packed, features: Features, cuts: Mapping[Key, list[np.ndarray]]) -> dict[Key, np.ndarray]:
    """The cells of all rows, labelled or not, of every (dataset, held-out fold) that has at most ``KEPT_CELLS``: one pass."""
    layout, most = packed.layout, KEPT_CELLS
    small = {key for key, own in cuts.items() if np.prod([len(c) + 1.0 for c in own]) < 1 << 62}
    schema = "dataset string, held_out int, codes array<long>"

    def table(found: Mapping[Key, np.ndarray]) -> pa.Table:
        # one cell too many stands for all
        kept = [(d, int(h), c[: most + 1]) for (d, h), c in found.items()]
        columns = (pa.array([r[i] for r in kept], k) for i, k in enumerate((pa.string(), pa.int32(), pa.list_(pa.int64()))))
        return pa.table(list(columns), names=["dataset", "held_out", "codes"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Key, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, layout) if batch.num_rows else ():
                for at, held_out in enumerate(layout[block.dataset].folds):
                    key = (block.dataset, held_out)
                    before = found.get(key, np.zeros(0, np.int64))
                    if key in small and len(before) <= most:
                        codes = coded(binned(features(block, at, held_out), cuts[key]), cuts[key])
                        found[key] = np.union1d(before, codes)
        yield from table(found).to_batches()

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        codes = np.unique(rows.column("codes").combine_chunks().flatten().to_numpy())
        return table({(key[0].as_py(), key[1].as_py()): codes})

    rows = packed.rows.mapInArrow(seen, schema).groupBy("dataset", "held_out").applyInArrow(joined, schema)
    found = rows.filter(F.size("codes").between(1, most)).toArrow().to_pylist()
    return {(r["dataset"], r["held_out"]): np.array(r["codes"]) for r in found}


def whole_tree(spec: TreeSpec, number: int, cells: np.ndarray, sums: np.ndarray, bins: int) -> Tree:
    """A tree from the weight, sum and sum of squares of every cell."""
    own = np.flatnonzero(sums[:, 0] > 0)
    columns, sums = cells[own].T, sums[own]
    width, tree = len(columns), Tree()
    bins = min(bins, int(columns.max(initial=0)) + 2)
    depth = min(spec.depth, MAX_DEPTH)
    place = np.zeros(len(own), np.int64)
    for level in range(1, depth + 2):
        opened, tree.open = tree.open, []
        if not opened or not len(place):
            break
        n = len(opened)
        cell = ((place * width + np.arange(width)[:, None]) * bins + columns).ravel()
        held = [np.bincount(cell, np.tile(v, width), n * width * bins) for v in sums.T]
        numbers = np.stack(held, axis=-1).reshape(n, width, bins, 3)
        whole = numbers[:, 0].sum(axis=1)
        left = np.cumsum(numbers, axis=2)[:, :, :-1]
        right = whole[:, None, None] - left
        w, s, ss = whole.T
        below, above = _impurity(left), _impurity(right)
        most = np.maximum(ss - s * s / w, 0.0)
        allowed = (left[..., 0] >= spec.min_leaf) & (right[..., 0] >= spec.min_leaf) & (left[..., 0] > 0) & (right[..., 0] > 0)
        split = (w >= spec.min_split) & (most > 1e-12 * np.maximum(ss, 1e-300)) & (level <= depth)
        if spec.width(width) < width:
            tried = np.zeros((n, width), bool)
            for i in np.flatnonzero(split).tolist():
                tried[i, spec.tried(number, opened[i], width)] = True
            allowed &= tried[:, :, None]
        gain = np.where(allowed, most[:, None, None] - below - above, -np.inf).reshape(n, -1)
        best = gain.argmax(axis=1)
        split &= gain[np.arange(n), best] > 1e-12 * most
        feature, cut = np.divmod(best, bins - 1)
        sides = np.stack([v[np.arange(n), feature, cut] for v in (left, right)], axis=1)
        means = sides[..., 1] / np.where(sides[..., 0] > 0, sides[..., 0], 1.0)
        found = zip(opened, (s / w).tolist(), split.tolist(), feature.tolist(), cut.tolist(), means.tolist(), strict=True)
        for node, value, inner, f, b, below_and_above in found:
            tree.value[node] = value
            if not inner:
                continue
            tree.feature[node], tree.bin[node], tree.left[node] = f, b, len(tree.feature)
            if level < depth:
                tree.open += (len(tree.feature), len(tree.feature) + 1)
            tree.feature += (-1, -1)
            tree.bin += (0, 0)
            tree.left += (0, 0)
            tree.value += below_and_above
            tree.level += (level, level)
        # cells of nodes that were split go on to the children, which are opened in order
        kept = split[place]
        place, columns, sums = place[kept], columns[:, kept], sums[kept]
        child = 2 * (np.cumsum(split) - 1)
        place = child[place] + (columns[feature[place], np.arange(len(place))] > cut[place])
    tree.open = []
    return tree


def _impurity(v: np.ndarray) -> np.ndarray:
    return np.maximum(v[..., 2] - v[..., 1] ** 2 / np.maximum(v[..., 0], 1e-300), 0.0)


_NODES = {"feature": "i", "bin": "i", "left": "i", "value": "d", "level": "i"}
TREES = (
    "dataset string, held_out int, trial int, tree int, feature array<int>, bin array<int>, left array<int>, "
    "value array<double>, level array<int>, at array<double>"
)


def _whole_trees(packed: Packed, features: Features, grown: Grown, bins: int) -> DataFrame:
    """The trees of all trials where cells are few: columns of ``TREES``; ``at`` is what the trees of a row predict for the cells."""
    specs, cuts, cells, center = grown.specs, grown.cuts, grown.cells, grown.center
    #: (trial, first tree): a tree of a forest, or all rounds of a boosted trial
    groups = [(t, n) for t, s in specs.items() for n in range(s.trees if s.kind == "forest" else 1)]
    rounds = max(max((s.trees for s in specs.values()), default=1), 1)
    sets = [
        (g, t, n + r) for g, (t, n) in enumerate(groups)
        for r in range(specs[t].trees if specs[t].kind == "boosted" and specs[t].sample < 1 else 1)
    ]

    def summing(some: Sequence[tuple[int, int, int]]):
        def kernel(block: Block, layout: Layout):
            parts = []
            for at, held_out in enumerate(layout.folds):
                key = (block.dataset, held_out)
                own = np.flatnonzero((block.fold != held_out) & ~np.isnan(block.y))
                if key in cells and len(own):
                    rows = block.take(own)
                    codes = coded(binned(features(rows, at, held_out), cuts[key]), cuts[key])
                    y = rows.y - center[key]
                    parts.append((held_out, own, np.searchsorted(cells[key], codes), y, y * y, len(cells[key])))
            for g, t, n in some if parts else ():
                weights = specs[t].weights(n, block.row_id)
                for held_out, own, cell, y, yy, size in parts:
                    w = weights[own]
                    sums = np.stack([np.bincount(cell, v, size) for v in (w, w * y, w * yy)], axis=1)
                    yield held_out, g * rounds + n - groups[g][1], "sum", sums.reshape(1, -1)

        return kernel

    # a task holds the sums of some trees alone; rows are read once for each such part
    bytes_of_set = 24 * sum(len(c) for c in cells.values())
    step = max(1, HELD_BYTES // max(1, bytes_of_set))
    parts = [sets[i : i + step] for i in range(0, len(sets), step)]
    cores = packed.rows.sparkSession.sparkContext.defaultParallelism
    few = Packed(packed.rows.coalesce(max(1, 2 * cores // len(parts))), packed.layout, packed.modes)
    sums = reduce(DataFrame.unionAll, [partial_sums(few, summing(p)) for p in parts])

    def trees(key: tuple, rows: pa.Table) -> pa.Table:
        dataset, held_out, group = (k.as_py() for k in key)
        t, first = groups[group]
        spec, own = specs[t], cuts[dataset, held_out]
        found: dict[int, np.ndarray] = {}
        for task, numbers in zip(rows.column("task").to_pylist(), rows.column("numbers"), strict=True):
            values = numbers.values.to_numpy(zero_copy_only=False).reshape(-1, 3)
            found[task % rounds] = found[task % rounds] + values if task % rounds in found else values
        b = decoded(cells[dataset, held_out], own)
        out, total = [], np.zeros(len(b))
        for r in range(spec.trees if spec.kind == "boosted" else 1):
            numbers = found.get(r if spec.sample < 1 else 0, np.zeros((len(b), 3)))
            if r:
                numbers = _residual(numbers, total)
            tree = whole_tree(spec, first + r, b, numbers, bins)
            at = tree.predict(b)
            total = total + spec.rate * at if r else at
            out.append((first + r, tree))
        n = len(out)
        last = [None] * (n - 1) + [total]
        columns = [
            pa.array([dataset] * n), pa.array([held_out] * n, pa.int32()), pa.array([t] * n, pa.int32()),
            pa.array([i for i, _ in out], pa.int32()),
            *(pa.array([getattr(tree, f) for _, tree in out], pa.list_(pa.float64() if f == "value" else pa.int32())) for f in _NODES),
            pa.array(last, pa.list_(pa.float64())),
        ]
        return pa.table(columns, names=[f.split()[0] for f in TREES.split(", ")])

    # growing takes time, not bytes, so tasks are not joined by their size; a tree's draws are shared by all datasets and folds
    by = sums.withColumn("run", F.expr(f"task div {rounds}").cast("int")).repartition(4 * cores, "run")
    return checkpointed(by.groupBy("dataset", "held_out", "run").applyInArrow(trees, TREES))


def _residual(numbers: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Sums of twice the residuals of the cells, by their means and the squares about these."""
    w, s, ss = numbers.T
    mean = s / np.where(w > 0, w, 1.0)
    gap = np.where(w > 0, mean - predicted, 0.0)
    about = np.maximum(ss - s * mean, 0.0)
    return np.stack((w, 2 * w * gap, 4 * (about + w * gap * gap)), axis=1)


def _tables(grown: Grown, rows: DataFrame) -> None:
    """What every trial predicts for the cells; its trees stay where they are, if they are many."""
    forests = {t: s.trees for t, s in grown.specs.items() if s.kind == "forest"}
    schema = "dataset string, held_out int, trial int, at array<double>"

    def joined(key: tuple, found: pa.Table) -> pa.Table:
        numbered = sorted(zip(found.column("tree").to_pylist(), found.column("at"), strict=True), key=lambda r: r[0])
        total = sum(v.values.to_numpy() for _, v in numbered)
        out = total / forests.get(key[2].as_py(), 1)
        return pa.table([pa.array([k.as_py()], f) for k, f in zip(key, (pa.string(), pa.int32(), pa.int32()), strict=True)]
                        + [pa.array([out], pa.list_(pa.float64()))], names=["dataset", "held_out", "trial", "at"])

    by = rows.filter("at is not null").select("dataset", "held_out", "trial", "tree", "at").groupBy("dataset", "held_out", "trial")
    for r in by.applyInArrow(joined, schema).toArrow().to_pylist():
        grown.tables[r["dataset"], r["held_out"], r["trial"]] = np.array(r["at"])
    grown.trees.stored = rows
    key = next(iter(grown.tables), None)
    if key and rows.agg(F.sum(F.size("feature"))).first()[0] <= HELD_NODES:
        grown.trees[key]


def grow(packed: Packed, features: Features, specs: Iterable[TreeSpec], bins: int = BINS) -> Grown:
    specs = {s.trial: s for s in specs}
    grown = Grown(*fit_cuts(packed, features, bins), specs, Trees())
    grown.cells = _cells(packed, features, grown.cuts)
    if grown.cells:
        _tables(grown, _whole_trees(packed, features, grown, bins))
    #: trees that grow now: (dataset, held-out fold, trial, number)
    growing: dict[tuple[str, int, int, int], Tree] = {}
    for (d, h), cuts in grown.cuts.items():
        for t, spec in specs.items() if (d, h) not in grown.cells else ():
            grown.trees[d, h, t] = []
            for n in range(spec.trees if spec.kind == "forest" else 1):
                growing[d, h, t, n] = Tree()
    while growing:
        _level(packed, features, grown, growing, bins)
        for (d, h, t, n), tree in sorted(growing.items()):
            if tree.open:
                continue
            del growing[d, h, t, n]
            grown.trees[d, h, t].append(tree)
            if specs[t].kind == "boosted" and n + 1 < specs[t].trees:
                growing[d, h, t, n + 1] = Tree()
    return grown


def _level(packed: Packed, features: Features, grown: Grown, growing: dict, bins: int) -> None:
    """Split the open nodes of all trees that grow."""
    specs, cuts = grown.specs, grown.cuts
    tasks = sorted({(t, n) for _, _, t, n in growing})
    number = {task: i for i, task in enumerate(tasks)}
    by_fold: dict[Key, list[tuple[int, int, Tree]]] = {}
    for (d, h, t, n), tree in sorted(growing.items()):
        by_fold.setdefault((d, h), []).append((t, n, tree))
    before = {(d, h, t): grown.trees[d, h, t] for d, h, t, _ in growing if specs[t].kind == "boosted"}

    def kernel(block: Block, layout: Layout):
        for at, held_out in enumerate(layout.folds):
            key = (block.dataset, held_out)
            rows = block.take(np.flatnonzero((block.fold != held_out) & ~np.isnan(block.y)))
            if key not in by_fold or not len(rows.y):
                continue
            b = binned(features(rows, at, held_out), cuts[key])
            width = max(b.shape[1], 1)
            columns = np.ascontiguousarray(b.T if b.shape[1] else np.zeros((1, len(b)), b.dtype)).astype(np.int64)
            for t, n, tree in by_fold[key]:
                y = rows.y - grown.center[key]
                if specs[t].kind == "boosted" and n:
                    y = 2 * (y - grown.combined(t, before[(*key, t)], b))
                slot = np.full(len(tree.feature), -1)
                slot[tree.open] = np.arange(len(tree.open))
                slot = slot[tree.leaves(b)]
                w = specs[t].weights(n, rows.row_id)
                own = np.flatnonzero((slot >= 0) & (w > 0))
                first, w, y = slot[own] * bins, w[own], y[own]
                wy, wyy = w * y, w * y**2
                sums = np.empty((len(tree.open), width, bins, 3))
                for f in range(width):
                    cell = first + columns[f, own]
                    for i, v in enumerate((w, wy, wyy)):
                        sums[:, f, :, i] = np.bincount(cell, v, minlength=len(tree.open) * bins).reshape(-1, bins)
                yield held_out, number[t, n], "sum", sums.reshape(len(tree.open), width * bins * 3)

    opened = {(d, h, number[t, n]): tree.open for (d, h, t, n), tree in growing.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t, n = tasks[r["task"]]
                sums = np.array(r["numbers"]).reshape(-1, bins, 3)
                tried = specs[t].tried(n, opened[r["dataset"], r["held_out"], r["task"]][r["part"]], len(sums))
                found = best_split(sums, tried, specs[t])
                out.append((r["dataset"], r["held_out"], r["task"], r["part"], *found))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], NAMES).cast(SCHEMA) if out else EMPTY

    sums = keyed_sums(packed, kernel)
    found = {(r["dataset"], r["held_out"], r["task"], r["part"]): r for r in sums.mapInArrow(split, SPLITS).collect()}
    for (d, h, t, n), tree in growing.items():
        opened_now, tree.open = tree.open, []
        for part, node in enumerate(opened_now):
            r = found.get((d, h, number[t, n], part))
            if r is None or not r["w"]:
                continue
            tree.value[node] = r["s"] / r["w"]
            level = tree.level[node] + 1
            if r["feature"] < 0 or level > min(specs[t].depth, MAX_DEPTH):
                continue
            left = (r["wl"], r["sl"], r["ssl"])
            right = (r["w"] - r["wl"], r["s"] - r["sl"], r["ss"] - r["ssl"])
            tree.feature[node], tree.bin[node], tree.left[node] = r["feature"], r["bin"], len(tree.feature)
            for w, s, _ in (left, right):
                if level < min(specs[t].depth, MAX_DEPTH):
                    tree.open.append(len(tree.feature))
                tree.feature.append(-1)
                tree.bin.append(0)
                tree.left.append(0)
                tree.value.append(s / w)
                tree.level.append(level)


_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_FIELDS = [f.split() for f in SPLITS.split(", ")]
NAMES = [n for n, _ in _FIELDS]
SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in _FIELDS])
EMPTY = pa.RecordBatch.from_pylist([], SCHEMA)
