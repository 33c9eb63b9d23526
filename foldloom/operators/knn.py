"""Exact k-nearest-neighbour join and prediction.

Few points (a checked number of values) are shipped to the tasks that hold the
queries.  More points are placed in cells around pivot vectors and the triangle
inequality decides which blocks of points a query has to meet:

* the k smallest pivot distances of every cell bound the k-th neighbour distance
  of a query from above;
* a block of points whose pivot distances lie in [low, high] cannot hold a
  neighbour closer than ``max(low - d, d - high)`` for a query at distance d from
  the same pivot.

Vectors are shuffled once as points and once as queries, into packs of bounded size
that hold neighbouring cells; only the packs of points are stored.  A pack of queries
meets each pack of points that one of its queries needs, in one task that reads the
stored packs one after the other, so disk grows with the rows alone, also where the
triangle inequality rules out nothing.  Inside a pair of packs, groups of queries meet
blocks of points and only the k best per query leave the task.  Exact copies of a point
beyond the k smallest ids per fold are left out first, so copies cannot form a hot
block.  Nothing is capped: a query visits every block it cannot rule out.  Manhattan
distances, which are no matrix product, are sifted by sums of bytes (``_Bytes``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.session import checkpointed

LOCAL_VALUES = 4_000_000
PIVOTS = 128
BLOCK_POINTS = 2_000
GROUP_QUERIES = 2_000
CHUNK_VALUES = 4_000_000
#: numbers of a pack of points, and of queries
PACK_VALUES = 1_000_000
QUERY_VALUES = 128_000
#: bytes of points in a stored partition
SIDE_BYTES = 64 << 20
#: hashes of vectors with many copies that are broadcast
COPIED_HASHES = 100_000
#: distances that are summed up by coordinate while they stay in a core's cache
TILE = 1 << 17
#: coordinates whose rounded distances are summed up in a byte, and the share of the pairs that these may leave to be measured
GROUP = 16
LEFT = 1 / 16
NEIGHBOUR = "query_id long, neighbour_id long, distance double, label double"


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to all rows of ``b``, in bounded chunks."""
    out = np.empty((len(a), len(b)))
    step = max(1, CHUNK_VALUES // max(1, b.size))
    for i in range(0, len(a), step):
        gap = np.abs(a[i : i + step, None, :] - b[None, :, :])
        if p == 2:
            out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
        elif p == 1:
            out[i : i + step] = gap.sum(axis=2)
        else:
            out[i : i + step] = (gap**p).sum(axis=2) ** (1.0 / p)
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _close(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the power p up to an error, and the error bound of each row."""
    width = a.shape[1]
    if p not in (1, 2):
        near = distances(a, b, p) ** p
        return near, 1e-9 * near.max(axis=1, initial=0.0)
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    if p == 2:
        own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
        near = a @ (-2 * b.T)
        near += own[:, None]
        near += other
        return near, 4 * (width + 16) * np.finfo(float).eps * (own + other.max(initial=0.0))
    reach = np.abs(a).sum(axis=1) + np.abs(b).sum(axis=1).max(initial=0.0)
    kind = np.float32 if reach.max(initial=0.0) < 1e30 else np.float64
    a, across = a.astype(kind), np.ascontiguousarray(b.T.astype(kind))
    near = np.zeros((len(a), len(b)), kind)
    step = max(1, TILE // max(1, len(b)))
    gap = np.empty((step, len(b)), kind)
    for i in range(0, len(a), step):
        total = near[i : i + step]
        part = gap[: len(total)]
        for j in range(width):
            np.subtract(a[i : i + step, j, None], across[j], out=part)
            np.abs(part, out=part)
            total += part
    return near, 2 * (width + 8) * np.finfo(kind).eps * reach


class _Bytes:
    """Lower bounds of Manhattan distances, from coordinates rounded to bytes.

    |a - b| is 2 max(a, b) - a - b, so a group of coordinates takes two operations on bytes for each.  Sums wrap around at
    256: that only makes a distance smaller, as does cutting off what lies outside the range of a byte.
    """

    def __init__(self, sample: np.ndarray):
        sample = sample[(np.abs(sample) < 1e30).all(axis=1)][:PIVOTS]
        if not len(sample):
            sample = np.zeros((1, sample.shape[1]))
        # a group of a usual pair does not reach 256
        widest = max(float(np.quantile(distances(g, g, 1), 0.999)) for g in np.split(sample, range(GROUP, sample.shape[1], GROUP), axis=1))
        self.step = widest / 250 if widest > 0 else 1.0
        self.low = np.median(sample, axis=0) - 127.5 * self.step
        self.groups = -(-sample.shape[1] // GROUP)

    def rounded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of rows, their sums by group, and by how much the coordinates were changed in all."""
        at = np.clip((x - self.low) / self.step, 0, 255)
        out = np.zeros((len(x), self.groups * GROUP), np.uint8)
        out[:, : x.shape[1]] = np.rint(at)
        return out, out.reshape(len(x), -1, GROUP).sum(axis=2, dtype=np.uint8), np.abs(at - out[:, : x.shape[1]]).sum(axis=1)

    def near(self, a: tuple, b: tuple, bound: np.ndarray) -> np.ndarray:
        """Which rows of ``a`` may be within their bound of which rows of ``b``."""
        (rows, own, moved), (points, other, away) = a, b
        kind = np.uint16 if self.groups <= 257 else np.uint32
        most = np.floor((bound / self.step + moved + away.max()) * (1 + 1e-9)) + 1
        most = np.minimum(most, np.iinfo(kind).max).astype(kind)
        points, other = np.ascontiguousarray(points.T), np.ascontiguousarray(other.T)
        larger = np.empty(points.shape, np.uint8)
        by_group = larger.reshape(self.groups, GROUP, -1)
        out = np.empty((len(rows), points.shape[1]), bool)
        step = max(1, TILE // max(1, other.size))
        sums = np.empty((step, *other.shape), np.uint8)
        for at in range(0, len(rows), step):
            part = sums[: len(rows) - at]
            for i in range(len(part)):
                np.maximum(points, rows[at + i][:, None], out=larger)
                np.add.reduce(by_group, axis=1, dtype=np.uint8, out=part[i])
            part += part
            part -= other
            part -= own[at : at + step, :, None]
            total = part[:, 0].astype(kind)
            for g in range(1, self.groups):
                total += part[:, g]
            np.less_equal(total, most[at : at + step, None], out=out[at : at + step])
        return out


class _Nearest:
    """The k nearest allowed points that each query has met, ties by id.

    Points are sifted by distances with a known error; those that may be among the k best are measured exactly.
    Manhattan distances are bounded by bytes first, once the k best are near enough for that to leave few points.
    """

    def __init__(self, vectors, ids, folds, k: int, skip_self: bool, p: float, bound=None, coarse: _Bytes | None = None):
        self.vectors, self.ids, self.folds = vectors, ids, folds
        self.k, self.skip_self, self.p = k, skip_self, p
        self.coarse = coarse if p == 1 and np.isfinite(vectors).all() else None
        self.rounded: tuple | None = None
        #: blocks to be met before bytes are tried again, and how many that are when they leave too much
        self.wait = self.waits = 0
        self.bound = np.full(len(ids), np.inf) if bound is None else bound.copy()
        self.found = np.zeros(len(ids), int)
        self.distance = np.full((len(ids), k), np.inf)
        self.neighbour: np.ndarray | None = None
        self.label = np.full((len(ids), k), np.nan)

    def meet(self, rows: np.ndarray, vectors, ids, folds, labels) -> None:
        """Let the queries at ``rows`` meet some points."""
        if not len(rows) or not len(ids):
            return
        near = self._bounded(rows, vectors)
        if near is None:
            near, error = _close(self.vectors[rows], vectors, self.p)
            # copies of the bound: distances to the power p, and room for rounding
            most = self.bound[rows] ** self.p * (1 + 1e-9) + error
            away = near > most[:, None]
            if away.size - np.count_nonzero(away) > 4 * self.k * len(rows):
                away |= ~self._allowed(rows, slice(None), ids, folds)
                if len(ids) >= self.k:
                    kth = np.partition(np.where(away, np.inf, near), self.k - 1, axis=1)[:, self.k - 1]
                    away |= near > (kth + error * 2 + np.abs(kth) * 1e-9)[:, None]
            near = ~away
        i, j = np.divmod(np.flatnonzero(near), len(ids))
        allowed = self._allowed(rows, i, ids, folds, j)
        i, j = i[allowed], j[allowed]
        exact = np.empty(len(i))
        # pairs whose gaps stay in a core's cache
        step = max(1, TILE // max(1, vectors.shape[1]))
        for at in range(0, len(i), step):
            gap = np.abs(self.vectors[rows[i[at : at + step]]] - vectors[j[at : at + step]])
            if self.p == 2:
                exact[at : at + step] = np.sqrt((gap * gap).sum(axis=1))
            elif self.p == 1:
                exact[at : at + step] = gap.sum(axis=1)
            else:
                exact[at : at + step] = (gap**self.p).sum(axis=1) ** (1.0 / self.p)
        # none of what lies beyond the bound, nor at no distance at all
        known = exact <= self.bound[rows[i]] * (1 + 1e-9)
        self._merge(rows[i[known]], exact[known], ids[j[known]], labels[j[known]])

    def _bounded(self, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray | None:
        """Which pairs the bytes do not rule out; none if these would be too many to be measured."""
        if self.coarse is None:
            return None
        if self.wait or not np.isfinite(self.bound[rows]).all() or not np.isfinite(vectors).all():
            self.wait = max(0, self.wait - 1)
            return None
        if self.rounded is None:
            self.rounded = self.coarse.rounded(self.vectors)
        near = self.coarse.near(tuple(v[rows] for v in self.rounded), self.coarse.rounded(vectors), self.bound[rows])
        if np.count_nonzero(near) <= LEFT * near.size:
            self.waits = 0
            return near
        self.wait = self.waits = min(2 * self.waits + 1, 64)
        return None

    def _allowed(self, rows, at, ids, folds, points=None) -> np.ndarray:
        own_fold, own_id = self.folds[rows][at], self.ids[rows][at]
        if points is None:
            own_fold, own_id = own_fold[:, None], own_id[:, None]
        else:
            folds, ids = folds[points], ids[points]
        allowed = folds != own_fold
        return allowed & (ids != own_id) if self.skip_self else allowed

    def _merge(self, query, distance, ids, labels) -> None:
        if not len(query):
            return
        if self.neighbour is None:
            self.neighbour = np.zeros((len(self.ids), self.k), ids.dtype)
        rows = np.unique(query)
        held, place = np.nonzero(np.arange(self.k) < self.found[rows][:, None])
        held = rows[held]
        query = np.concatenate((held, query))
        distance = np.concatenate((self.distance[held, place], distance))
        ids = np.concatenate((self.neighbour[held, place], ids))
        labels = np.concatenate((self.label[held, place], labels))
        order = np.lexsort((ids, distance, query))
        query = query[order]
        start = np.searchsorted(query, query)
        rank = np.arange(len(query)) - start
        best = rank < self.k
        query, rank, order = query[best], rank[best], order[best]
        self.distance[query, rank] = distance[order]
        self.neighbour[query, rank] = ids[order]
        self.label[query, rank] = labels[order]
        self.found[rows] = np.bincount(query, minlength=len(self.ids))[rows]
        self.bound[rows] = np.minimum(self.bound[rows], self.distance[rows, self.k - 1])

    def rows(self) -> pd.DataFrame:
        query, place = np.nonzero(np.arange(self.k) < self.found[:, None])
        if not len(query):
            return pd.DataFrame(
                {"query_id": [], "neighbour_id": [], "distance": [], "label": []}
            ).astype({"query_id": "int64", "neighbour_id": "int64"})
        return pd.DataFrame(
            {
                "query_id": self.ids[query], "neighbour_id": self.neighbour[query, place],
                "distance": self.distance[query, place], "label": self.label[query, place],
            }
        )


def _prepare(df: DataFrame, row_id: str, vector: str, fold: str | None, label: str | None) -> DataFrame:
    return df.select(
        F.col(row_id).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        (F.col(fold).cast("long") if fold else F.lit(0).cast("long")).alias("fold"),
        (F.col(label).cast("double") if label else F.lit(None).cast("double")).alias("label"),
    )


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    row_id: str = "row_id",
    vector: str = "vector",
    label: str | None = None,
    fold: str | None = None,
    skip_self: bool = False,
    p: float = 2,
    local_values: int = LOCAL_VALUES,
    pivots: int = PIVOTS,
    block_points: int = BLOCK_POINTS,
    group_queries: int = GROUP_QUERIES,
    pack_values: int = PACK_VALUES,
) -> DataFrame:
    """``(query_id, neighbour_id, distance, label)``: the k nearest points of each query.

    With ``fold`` a query only meets points of other folds (out-of-fold kNN in one
    join, without a copy of the points per fold).
    """
    q = _prepare(queries, row_id, vector, fold, None).drop("label")
    if fold is None:
        q = q.withColumn("fold", F.lit(-1).cast("long"))
    s = _prepare(points, row_id, vector, fold, label)
    size = s.agg(F.sum(F.size("v").cast("long") + 3)).first()[0] or 0
    if size <= local_values:
        return _join_local(q, s, k, skip_self, p)
    return _join_cells(q, s, k, skip_self, p, pivots, block_points, group_queries, pack_values)


def _join_local(q: DataFrame, s: DataFrame, k: int, skip_self: bool, p: float) -> DataFrame:
    held = s.toArrow().to_pandas()  # at most LOCAL_VALUES numbers, checked by the caller
    points = _matrix(held["v"])
    shared = q.sparkSession.sparkContext.broadcast(
        (points, held["id"].to_numpy(), held["fold"].to_numpy(), held["label"].to_numpy(dtype=float))
    )
    coarse = _Bytes(points[:: -(-len(points) // PIVOTS)]) if p == 1 and points.size else None

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, ids, folds, labels = shared.value
        step = max(1, min(GROUP_QUERIES, CHUNK_VALUES // BLOCK_POINTS))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                best = _Nearest(
                    _matrix(part["v"]), part["id"].to_numpy(), part["fold"].to_numpy(), k, skip_self, p, coarse=coarse
                )
                every = np.arange(len(part))
                for at in range(0, len(ids), BLOCK_POINTS):
                    cut = slice(at, at + BLOCK_POINTS)
                    best.meet(every, vectors[cut], ids[cut], folds[cut], labels[cut])
                yield best.rows()

    return q.mapInPandas(search, NEIGHBOUR)


def _blob(vectors: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = vectors.astype("<f4")
    kept = single if (single == vectors).all() else vectors.astype("<f8")
    return [v.tobytes() for v in kept]


def _vectors(blobs: pd.Series, width: int) -> np.ndarray:
    sizes = blobs.map(len).to_numpy()
    out = np.empty((len(blobs), width))
    for size, kind in ((4 * width, "<f4"), (8 * width, "<f8")):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join(blobs.iloc[at]), kind).reshape(len(at), width)
    return out


class _Deal:
    """Which pack a row goes to: neighbouring cells share packs, larger cells are cut into rings and by a hash."""

    def __init__(self, cells: Sequence[tuple[int, int, float]], most: int):
        self.most = most
        size = max((c for c, _, _ in cells), default=0) + 1
        self.rings, self.reach = np.ones(size, int), np.zeros(size)
        for cell, n, reach in cells:
            self.rings[cell], self.reach[cell] = -(-n // most), reach
        self.packs = 0
        self.first: dict[tuple[int, int], tuple[int, int]] = {}

    def ring(self, cell: np.ndarray, r: np.ndarray) -> np.ndarray:
        reach, rings = self.reach[cell], self.rings[cell]
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.where(reach > 0, r / reach * rings, 0.0)
        return np.clip(np.nan_to_num(at), 0, rings - 1).astype("int32")

    def number(self, counts: Sequence[tuple[int, int, int]]) -> _Deal:
        """Packs of (cell, ring, rows) in order; a row of none of these, if rounding differs when it is read again, goes to the first."""
        filled = self.most
        for cell, ring, n in sorted(counts):
            subs = -(-n // self.most)
            if subs > 1 or filled + n > self.most:
                self.first[cell, ring] = (self.packs, subs)
                self.packs += subs
                filled = n if subs == 1 else self.most
            else:
                self.first[cell, ring] = (self.packs - 1, 1)
                filled += n
        return self

    def pack(self, cell: np.ndarray, ring: np.ndarray, mark: np.ndarray) -> np.ndarray:
        places = np.array([self.first.get((c, g), (0, 1)) for c, g in zip(cell.tolist(), ring.tolist(), strict=True)]).reshape(-1, 2)
        return (places[:, 0] + mark % places[:, 1]).astype("int32")


def _without_copies(s: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` rows per (vector, fold), those of smallest id.

    Only rows whose hash is that frequent are shuffled to be compared.
    """
    copies = Window.partitionBy("v", "fold").orderBy("id")

    def few(rows: DataFrame) -> DataFrame:
        # the row_number filter is applied map-side
        return rows.withColumn("__c", F.row_number().over(copies)).filter(F.col("__c") <= keep).drop("__c")

    hashed = s.withColumn("__h", F.xxhash64("v", "fold"))
    frequent = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > keep).select("__h")
    held = frequent.limit(COPIED_HASHES + 1).collect()
    if not held:
        return s
    if len(held) > COPIED_HASHES:
        return few(s)
    hot = F.broadcast(s.sparkSession.createDataFrame(held, "__h long"))
    rest = hashed.join(hot, "__h", "left_anti").drop("__h")
    return rest.unionByName(few(hashed.join(hot, "__h", "left_semi").drop("__h")))


POINTS = "pack int, v binary, id binary, fold binary, label binary, cell binary, r binary"
QUERIES = "pack int, v binary, id binary, fold binary, theta binary, need array<int>"


def _join_cells(q, s, k, skip_self, p, pivots, block_points, group_queries, pack_values) -> DataFrame:
    keep = k + 1 if skip_self else k
    # the hashes decide which vectors become pivots, and only those vectors are sent
    finite = s.filter("forall(v, x -> abs(x) < double('infinity'))").select("v", F.xxhash64("v").alias("__h"))
    hashes = finite.select("__h").distinct().orderBy("__h").limit(pivots).collect()
    if not hashes:
        return q.sparkSession.createDataFrame([], NEIGHBOUR)
    among = finite.filter(F.col("__h").isin([r["__h"] for r in hashes]))
    chosen = among.groupBy("v").agg(F.min("__h").alias("__h")).orderBy("__h").limit(pivots).collect()
    centers = np.array([r["v"] for r in chosen], dtype=float)
    width = centers.shape[1]
    coarse = _Bytes(centers) if p == 1 else None
    members = _without_copies(s, keep)

    # a point that holds a NaN is at no distance from anything
    def nearest_pivot(batch: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(batch["v"])
        d = distances(vectors, centers, p)
        cell = d.argmin(axis=1)
        r = d[np.arange(len(d)), cell]
        known = ~np.isnan(r)
        return batch.assign(v=_blob(vectors), cell=cell.astype("int32"), r=r)[known]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield nearest_pivot(batch)[["cell", "fold", "r"]]

    placed = checkpointed(members.select("v", "fold").mapInPandas(place, "cell int, fold long, r double"))
    # one row per pivot
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("reach")).collect()
    deal = _Deal([(r["cell"], r["n"], r["reach"]) for r in cells], max(block_points, pack_values // width))

    def ringed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ring=deal.ring(batch["cell"].to_numpy(), batch["r"].to_numpy()))

    # a row per pivot and one per full pack
    rings = placed.select("cell", "r").mapInPandas(ringed, "cell int, r double, ring int")
    deal.number([(r["cell"], r["ring"], r["n"]) for r in rings.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch = nearest_pivot(batch)
                cell, r = batch["cell"].to_numpy(), batch["r"].to_numpy()
                yield batch.assign(pack=deal.pack(cell, deal.ring(cell, r), batch.pop("mark").to_numpy()))

    numbered = members.withColumn("mark", F.pmod(F.xxhash64("v"), F.lit(1 << 30))).mapInPandas(
        dealt, "id long, v binary, fold long, label double, cell int, r double, pack int"
    )

    def stored(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "r"])
        out = {"pack": [int(rows["pack"].iloc[0])], "v": [b"".join(_blob(_vectors(rows["v"], width)))]}
        for name, kind in (("id", "<i8"), ("fold", "<i8"), ("label", "<f8"), ("cell", "<i4"), ("r", "<f8")):
            out[name] = [rows[name].astype(kind).to_numpy().tobytes()]
        return pd.DataFrame(out)

    # a group is one pack; they are dealt evenly
    sides = max(1, -(-sum(r["n"] for r in cells) * (8 * width + 36) // SIDE_BYTES))
    shared = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sides = max(sides, min(deal.packs, shared))
    points = checkpointed(numbered.repartitionById(sides, "pack").groupBy("pack").applyInPandas(stored, POINTS))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                cell, r = np.frombuffer(row.cell, "<i4"), np.frombuffer(row.r, "<f8")
                out += [(row.pack, c, r[cell == c].min(), r[cell == c].max()) for c in np.unique(cell).tolist()]
            yield pd.DataFrame(out, columns=["pack", "cell", "low", "high"])

    # where the points of a pack lie: at most a row for each pivot and pack that share points
    lies = points.select("pack", "cell", "r").mapInPandas(spans, "pack int, cell int, low double, high double").collect()
    l_pack, l_cell = (np.array([r[c] for r in lies], dtype=int) for c in ("pack", "cell"))
    l_low, l_high = (np.array([r[c] for r in lies], dtype=float) for c in ("low", "high"))

    # k smallest pivot distances per (cell, fold): at most pivots x folds x k numbers
    nearest = Window.partitionBy("cell", "fold").orderBy("r")
    bound_rows = (
        placed.select("cell", "fold", "r")
        .withColumn("__n", F.row_number().over(nearest))
        .filter(F.col("__n") <= keep)
        .select("cell", "fold", "r")
        .toArrow()
        .to_pandas()
    )
    b_cell, b_fold, b_r = (bound_rows[c].to_numpy() for c in ("cell", "fold", "r"))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"cell": distances(_matrix(batch["v"]), centers, p).argmin(axis=1).astype("int32")})

    home = q.select("v").mapInPandas(homes, "cell int").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    most = max(1, min(QUERY_VALUES, pack_values) // width)
    asked = _Deal([], most).number([(r["cell"], 0, r["n"]) for r in home])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Upper bound of the k-th distance and the pack of every query."""
        step = max(1, CHUNK_VALUES // max(1, len(b_r)))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                vectors = _matrix(part["v"])
                d = distances(vectors, centers, p)
                bound = d[:, b_cell] + b_r
                bound[b_fold[None, :] == part["fold"].to_numpy()[:, None]] = np.inf
                theta = (
                    np.partition(bound, keep - 1, axis=1)[:, keep - 1]
                    if bound.shape[1] >= keep
                    else np.full(len(part), np.inf)
                )
                pack = asked.pack(d.argmin(axis=1), np.zeros(len(part), int), part["mark"].to_numpy())
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(), "fold": part["fold"].to_numpy(), "v": _blob(vectors),
                        "theta": theta * (1 + 1e-9) + 1e-12, "pack": pack,
                    }
                )

    def reached(d: np.ndarray, bound: np.ndarray, cell, low, high) -> np.ndarray:
        """Whether points of a cell between two distances from its pivot may be within the bound of a query."""
        at = d[:, cell]
        return (at + bound >= low) & (at - bound <= high) & ((at - d.min(axis=1)) / 2 <= bound)

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        vectors, theta = _vectors(rows["v"], width), rows["theta"].to_numpy()
        d = distances(vectors, centers, p)
        need = {int(l_pack[i]) for i in range(len(lies)) if reached(d, theta, l_cell[i], l_low[i], l_high[i]).any()}
        out = {"pack": [int(rows["pack"].iloc[0])], "v": [b"".join(_blob(vectors))], "need": [sorted(need)]}
        for name, kind in (("id", "<i8"), ("fold", "<i8"), ("theta", "<f8")):
            out[name] = [rows[name].astype(kind).to_numpy().tobytes()]
        return pd.DataFrame(out)[["pack", "v", "id", "fold", "theta", "need"]]

    routed = q.withColumn("mark", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInPandas(
        route, "id long, fold long, v binary, theta double, pack int"
    )
    # a partition is one pack
    groups = routed.repartitionById(max(1, asked.packs), "pack").groupBy("pack").applyInPandas(gathered, QUERIES)
    queries = groups.select(
        F.col("pack").alias("q_pack"), F.col("v").alias("q_v"), F.col("id").alias("q_id"),
        F.col("fold").alias("q_fold"), "theta", "need",
    )
    # packs, not rows, meet here, and only those that the bounds do not rule out; neither side is shuffled again.  A task
    # holds one pack of queries and reads the partitions of points in turn, so a query's k best leave one task alone
    pairs = points.coalesce(1).join(queries.hint("shuffle_replicate_nl"), F.expr("array_contains(need, pack)")).drop("need")

    def matrix(blob: bytes, n: int) -> np.ndarray:
        return np.frombuffer(blob, "<f4" if len(blob) == 4 * n * width else "<f8").reshape(n, width).astype(float)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[int, tuple[_Nearest, np.ndarray]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q_pack not in met:
                    ids = np.frombuffer(row.q_id, "<i8")
                    best = _Nearest(
                        matrix(row.q_v, len(ids)), ids, np.frombuffer(row.q_fold, "<i8"), k, skip_self, p,
                        np.frombuffer(row.theta, "<f8"), coarse,
                    )
                    met[row.q_pack] = (best, distances(best.vectors, centers, p))
                best, d = met[row.q_pack]
                cell, r = np.frombuffer(row.cell, "<i4"), np.frombuffer(row.r, "<f8")
                ids, folds, labels = (np.frombuffer(b, t) for b, t in ((row.id, "<i8"), (row.fold, "<i8"), (row.label, "<f8")))
                vectors = matrix(row.v, len(ids))
                step = max(1, min(group_queries, CHUNK_VALUES // block_points))
                # blocks of points that lie in one order around the pivots of the pack
                for low in range(0, len(ids), block_points):
                    cut = slice(low, low + block_points)
                    own = [(c, r[cut][cell[cut] == c]) for c in np.unique(cell[cut]).tolist()]
                    for at in range(0, len(d), step):
                        part = d[at : at + step]
                        bound = best.bound[at : at + step] * (1 + 1e-9) + 1e-12
                        near = np.zeros(len(part), bool)
                        for c, x in own:
                            near |= reached(part, bound, c, x[0], x[-1])
                        best.meet(at + np.flatnonzero(near), vectors[cut], ids[cut], folds[cut], labels[cut])
        for best, _ in met.values():
            yield best.rows()

    found = pairs.mapInPandas(search, NEIGHBOUR)
    final = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("__n", F.row_number().over(final)).filter(F.col("__n") <= k).drop("__n")


def _weights(weights: str):
    """Uniform, or one over the distance; exact hits take all the weight."""
    if weights == "uniform":
        return F.lit(1.0)
    hit = F.min("distance").over(Window.partitionBy("query_id")) == 0.0
    return F.when(hit, (F.col("distance") == 0.0).cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )


def knn_regress(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    w = neighbours.withColumn("__w", _weights(weights))
    return w.groupBy("query_id").agg(
        (F.sum(F.col("__w") * F.col("label")) / F.sum("__w")).alias("y_pred")
    )


def knn_classify(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """Heaviest label among the neighbours, smallest on ties."""
    w = neighbours.withColumn("__w", _weights(weights))
    votes = w.groupBy("query_id", "label").agg(F.sum("__w").alias("__w"))
    return votes.groupBy("query_id").agg(
        F.min_by("label", F.struct(-F.col("__w"), F.col("label"))).alias("y_pred")
    )


def feature_vector(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])
