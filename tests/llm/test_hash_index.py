import numpy as np
import pytest

from foldloom.llm import hash_index

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=10):
    ids = np.array([r[0] for r in rows])
    data = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.sqrt(((data - data[i]) ** 2).sum(axis=1))
        score[i] = np.inf
        best = np.lexsort((ids, score))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in best if np.isfinite(score[j])]
    return out


def search(spark, rows, **options):
    vectors = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = hash_index.search(vectors, vectors.filter("vec_id % 100 = 0"), hash_index.fit(vectors), **options)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def test_substrings_retrieve_every_code_within_the_radius():
    rnd = np.random.default_rng(0)
    words = rnd.integers(0, 1 << 20, (400, 2)).astype(np.uint64)
    words[200:] = words[:200] ^ (np.uint64(1) << rnd.integers(0, 20, (200, 2)).astype(np.uint64))
    index = hash_index.SubstringIndex(words, [20, 20])
    for radius in (0, 1, 3, 7, 12, 40):
        for i in range(0, 400, 29):
            want = np.flatnonzero(np.bitwise_count(words ^ words[i]).sum(axis=1) <= radius)
            assert index.within(words[i], radius).tolist() == want.tolist()


def test_the_radius_holds_k_codes_a_margin_inside():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 12, (300, 1)).astype(np.uint64)
    index = hash_index.SubstringIndex(words, [12])
    for query in range(0, 300, 37):
        far = np.bitwise_count(words ^ words[query]).sum(axis=1)
        others = np.arange(300) != query
        kth = np.sort(far[others])[9]
        found = index.nearest(words[query], 10, 2, ~others)
        assert set(found) == set(np.flatnonzero(others & (far <= kth + 2)))
        assert set(index.nearest(words[query], 300, 2, ~others)) == set(np.flatnonzero(others))


def check_recall(rows, found):
    want = brute(rows)
    assert found.keys() == want.keys()
    exact = {q: dict(own) for q, own in brute(rows, len(rows)).items()}
    for query, own in found.items():
        assert len(own) == 10 and own == sorted(own, key=lambda x: (x[1], x[0]))
        assert all(exact[query][v] == s for v, s in own)
    hits = sum(len(dict(found[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 200, "query_rows": 3}])
def test_recall_on_the_test_vectors(spark, sf, limits):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_recall(rows, search(spark, rows, **limits))


def test_clustered_vectors_need_few_codes(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(200, 64))
    data = centres[rnd.integers(0, 200, 6000)] + 0.3 * rnd.normal(size=(6000, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]
    check_recall(rows, search(spark, rows))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes = hash_index.fit(vectors)
    words = codes.encode(data)
    index = hash_index.SubstringIndex(words, [r.shape[1] for r in codes.rotations])
    probed = []
    for i in range(0, 6000, 100):
        seen = np.zeros(6000, bool)
        index.nearest(words[i], 11, round(hash_index.MARGIN_SHARE * codes.bits), seen)
        probed.append(seen.mean())
    assert np.mean(probed) < 0.3


def test_few_and_equal_vectors_give_all_candidates(spark):
    rows = [(i, [1.0, 2.0, float(i % 3)]) for i in range(0, 900, 50)]
    found, want = search(spark, rows, k=30), brute(rows, 30)
    assert {q: [v for v, _ in own] for q, own in found.items()} == {q: [v for v, _ in own] for q, own in want.items()}


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 2, "query_rows": 1}])
def test_vectors_that_take_no_part(spark, limits):
    bad = [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (600, [float("inf"), 1.0])]
    rows = [(0, [1.0, 0.0]), *bad, (500, [1.0, 0.0]), (7, [0.5, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (700, [])]
    found = search(spark, rows, **limits)
    assert {q: [v for v, _ in own] for q, own in found.items()} == {0: [500, 7], 500: [0, 7]}
    assert search(spark, []) == {} and search(spark, bad) == {}
