import random

import numpy as np
import pytest

from foldloom.operators import knn


def _points(n=240, dim=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all points are copies of one vector
        v = [0.5] * dim if i % 3 == 0 else [round(rng.gauss(i % 5, 1.0), 3) for _ in range(dim)]
        rows.append((i, v, float(i % 7), i % 4))
    return rows


def _brute(queries, points, k, p=2, fold=True, skip_self=False):
    out = {}
    for qid, qv, _, qf in queries:
        found = []
        for sid, sv, label, sf in points:
            if (fold and sf == qf) or (skip_self and sid == qid):
                continue
            d = float((np.abs(np.array(qv) - np.array(sv)) ** p).sum() ** (1 / p))
            found.append((round(d, 9), sid, label))
        out[qid] = sorted(found)[:k]
    return out


SCHEMA = "row_id long, vector array<double>, label double, fold int"


@pytest.mark.parametrize("local", [10**9, 0])
@pytest.mark.parametrize("p", [1, 2, 3])
def test_equals_brute_force(spark, local, p):
    rows = _points()
    df = spark.createDataFrame(rows, SCHEMA)
    near = knn.knn_join(
        df, df, 5, label="label", fold="fold", p=p, local_values=local, pivots=6, block_points=20, group_queries=30
    )
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["neighbour_id"], r["label"]))
    assert {q: sorted(v) for q, v in got.items()} == _brute(rows, rows, 5, p)


@pytest.mark.parametrize("local", [10**9, 0])
def test_skip_self_and_fewer_points_than_k(spark, local):
    rows = _points(12)
    df = spark.createDataFrame(rows, SCHEMA)
    near = knn.knn_join(df, df, 20, label="label", skip_self=True, local_values=local, pivots=3, block_points=4)
    assert near.groupBy("query_id").count().filter("count <> 11").count() == 0
    assert near.filter("query_id = neighbour_id").count() == 0


def test_predictions(spark):
    near = spark.createDataFrame(
        [(1, 10, 0.0, 5.0), (1, 11, 0.0, 7.0), (1, 12, 1.0, 100.0), (2, 10, 1.0, 2.0), (2, 11, 2.0, 5.0), (2, 12, 2.0, 5.0)],
        knn.NEIGHBOUR,
    )
    uniform = {r[0]: r[1] for r in knn.knn_regress(near).collect()}
    weighted = {r[0]: r[1] for r in knn.knn_regress(near, "distance").collect()}
    assert uniform[1] == pytest.approx(112 / 3) and weighted[1] == pytest.approx(6.0)
    assert weighted[2] == pytest.approx((2 * 1 + 5 * 0.5 + 5 * 0.5) / 2)
    assert {r[0]: r[1] for r in knn.knn_classify(near).collect()} == {1: 5.0, 2: 5.0}
    assert {r[0]: r[1] for r in knn.knn_classify(near, "distance").collect()}[2] == 2.0


@pytest.mark.parametrize("p", [1, 2])
def test_packs_equal_brute_force(spark, monkeypatch, p):
    monkeypatch.setattr(knn, "SIDE_BYTES", 3_000)
    monkeypatch.setattr(knn, "QUERY_VALUES", 60)
    rows = _points()
    df = spark.createDataFrame(rows, SCHEMA)
    near = knn.knn_join(
        df, df, 5, label="label", fold="fold", p=p, local_values=0, pivots=6, block_points=7, group_queries=4, pack_values=80
    )
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["neighbour_id"], r["label"]))
    assert {q: sorted(v) for q, v in got.items()} == _brute(rows, rows, 5, p)


def test_vectors_far_from_the_origin_and_nan(spark):
    rows = [(i, [1e9 + x for x in v], label, f) for i, v, label, f in _points(120)]
    df = spark.createDataFrame([*rows, (500, [float("nan")] * 4, 1.0, 0)], SCHEMA)
    for p in (1, 2):
        near = knn.knn_join(df, df, 5, label="label", fold="fold", p=p, local_values=0, pivots=4, block_points=30)
        got = {}
        for r in near.collect():
            got.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["neighbour_id"], r["label"]))
        assert {q: sorted(v) for q, v in got.items()} == _brute(rows, rows, 5, p)


def test_no_shuffle_copies_vectors_to_the_blocks_they_meet(spark):
    df = spark.createDataFrame(_points(60), SCHEMA)
    near = knn.knn_join(df, df, 5, label="label", fold="fold", local_values=0, pivots=6, block_points=5, group_queries=5)
    plan = near._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "explode" not in plan


def test_stored_bytes_follow_the_vectors_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), 1.0, i % 4) for i, v in enumerate(rng.normal(size=(2_000, 64)).astype("f4").astype(float))]
    df = spark.createDataFrame(rows, SCHEMA)
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        near = knn.knn_join(df, df, 5, fold="fold", local_values=0, pivots=6, block_points=250, group_queries=250)
        stored = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
        assert near.count() == 5 * len(rows)
    finally:
        if folder is not None:
            context._jsc.sc().setCheckpointDir(folder)
    assert 256 * len(rows) < stored < 1.8 * 256 * len(rows)


def test_the_nearest_of_a_query_leave_one_task(spark, monkeypatch):
    monkeypatch.setattr(knn, "SIDE_BYTES", 1_000)
    df = spark.createDataFrame(_points(), SCHEMA)
    near = knn.knn_join(df, df, 5, fold="fold", local_values=0, pivots=6, block_points=5, group_queries=5, pack_values=80)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    # the stored points are read in turn, not dealt over tasks that each send a query's k best
    assert plan[plan.index("Join Inner") :].count("Repartition 1, false") == 1


@pytest.mark.parametrize("most", [0, 100_000])
def test_copies_beyond_those_kept_go(spark, monkeypatch, most):
    monkeypatch.setattr(knn, "COPIED_HASHES", most)
    rows = [(i, [float(i % 3 == 0 or i), 1.0], None, i % 2) for i in range(60)] + [(60, [-0.0, 1.0], None, None)] * 4
    s = spark.createDataFrame([(i, v, f, y) for i, v, y, f in rows], "id long, v array<double>, fold long, label double")
    kept = sorted((r["id"], r["fold"] is None) for r in knn._without_copies(s, 3).collect())
    groups = {}
    for i, v, _, f in rows:
        groups.setdefault((tuple(v), f), []).append(i)
    assert kept == sorted((i, f is None) for (_, f), ids in groups.items() for i in sorted(ids)[:3])
    unique = s.filter("id % 3 <> 0")
    assert "Window" not in knn._without_copies(unique, 3)._jdf.queryExecution().toString()


@pytest.mark.parametrize("width", [3, 16, 37])
def test_bytes_rule_out_no_pair_within_its_bound(width):
    draw = np.random.default_rng(width)
    points = draw.normal(size=(300, width)) * draw.choice([0.0, 0.1, 5.0], width) + draw.normal(size=width) * 1e4
    points[:20] += draw.normal(size=(20, width)) * 1e6
    queries = np.concatenate((points[::7], draw.normal(size=(40, width))))
    exact = knn.distances(queries, points, 1)
    for sample in (points[100:150], points[100:101], points[:25]):
        coarse = knn._Bytes(sample)
        for k in (0, 5, 150):
            bound = np.sort(exact, axis=1)[:, k]
            near = coarse.near(coarse.rounded(queries), coarse.rounded(points), bound)
            assert near[exact <= bound[:, None]].all()
    usual = knn._Bytes(points[100:])
    near = usual.near(usual.rounded(points[100:]), usual.rounded(points[100:]), np.zeros(200))
    assert near.mean() < 0.5


def test_manhattan_distances_are_mostly_ruled_out_by_bytes(monkeypatch):
    draw = np.random.default_rng(5)
    points = draw.normal(size=(6_000, 64))
    ids, queries = np.arange(6_000), points[:300]
    summed, close = [], knn._close
    monkeypatch.setattr(knn, "_close", lambda a, b, p: summed.append(len(a) * len(b)) or close(a, b, p))
    best = knn._Nearest(queries, ids[:300], ids[:300] % 10, 7, False, 1, coarse=knn._Bytes(points[::50]))
    for at in range(0, 6_000, 500):
        cut = slice(at, at + 500)
        best.meet(np.arange(300), points[cut], ids[cut], ids[cut] % 10, ids[cut] / 7)
    assert sum(summed) <= 300 * 6_000 / 3
    exact = knn.distances(queries, points, 1)
    exact[ids[:300, None] % 10 == ids[None] % 10] = np.inf
    want = np.lexsort((np.broadcast_to(ids, exact.shape), exact), axis=1)[:, :7]
    assert (best.neighbour == want).all()
    assert (best.distance == np.take_along_axis(exact, want, axis=1)).all()
