import numpy as np
import pandas as pd
import pytest

from foldloom.llm import robust_outliers as robust

SCHEMA = "doc_id long, text string, lang string, source string, distance string"


def plain_estimate(x):
    """The same estimate on one pool in memory."""
    units = x / robust.UNIT
    n = robust.N

    def regular(cov):
        out = robust.SHRINK * cov
        np.fill_diagonal(out, np.maximum(np.diag(cov), robust.FLOORS**2))
        return out

    def middle(v):
        v = np.sort(v)
        return v[int(np.searchsorted(np.arange(1, len(v) + 1), len(v) / 2))]

    mean = np.array([middle(x[:, i]) for i in range(n)])
    spread = np.array([1.4826 * middle(np.abs(x[:, i] - mean[i])) for i in range(n)]) / robust.UNIT
    mean = mean / robust.UNIT
    scale = np.maximum(spread, robust.FLOORS)
    z = (units - mean) / scale
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    starts = [(mean, np.diag(scale**2))]
    for scores in (np.tanh(z), np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)):
        scores = np.rint(10000 * scores)
        cov = np.cov(scores.T, bias=True)
        root = np.sqrt(np.diag(cov))
        shape = cov / np.outer(root, root) if (root > 0).all() else np.eye(n)
        shape = np.where(np.eye(n, dtype=bool), 1, 0.95 * shape)
        starts.append((mean, shape * np.outer(scale, scale)))

    def d2(model):
        y = np.linalg.solve(np.linalg.cholesky(model[1]), (units - model[0]).T)
        return (y**2).sum(axis=0)

    for _ in range(robust.STEPS):
        new = []
        for model in starts:
            bins = np.floor(8 * np.log2(1 + 64 * d2(model)))
            order = np.sort(np.unique(bins))
            upto = np.cumsum([(bins == b).sum() for b in order])
            own = units[bins <= order[np.searchsorted(upto, robust.SHARE * len(units))]]
            cov = np.cov(own.T, bias=True).reshape(n, n) * robust.SHARE / robust.WITHIN_SHARE
            new.append((own.mean(axis=0), regular(cov)))
        starts = new
    best = min(starts, key=lambda m: np.linalg.slogdet(m[1])[1])
    own = units[d2(best) <= robust.CHI_975]
    final = (own.mean(axis=0), regular(np.cov(own.T, bias=True).reshape(n, n) * 0.975 / robust.WITHIN_975))
    return d2(final)


def test_estimates_match_a_plain_version(spark):
    rnd = np.random.default_rng(3)
    frames = []
    for pool, size in (("a", 400), ("b", 90), ("c", 3), ("d", 1)):
        x = rnd.normal([1600, 300, 100, 50], [60, 200, 300, 100], (size, robust.N))
        x[: size // 6] += [0, 4000, 0, 2500]
        frames.append(pd.DataFrame(np.rint(x).astype(int), columns=[f"x{i}" for i in range(robust.N)]).assign(pool=pool))
    rows = spark.createDataFrame(pd.concat(frames))
    found = rows.join(robust.estimates(rows), "pool").selectExpr("pool", "x0", "x1", "x2", "x3", f"{robust.distance()} as d2").toPandas()
    for frame in frames:
        own = found[found["pool"] == frame["pool"].iloc[0]]
        x = own[["x0", "x1", "x2", "x3"]].to_numpy(float)
        np.testing.assert_allclose(own["d2"].to_numpy(), plain_estimate(x), rtol=1e-6, atol=1e-9)


def test_floors_bound_a_spread_from_below_only():
    spread = np.array([0.01, 2.0, 0.1, 3.0])
    found = robust._regular(np.outer(spread, spread))  # features that vary together
    np.testing.assert_allclose(np.sqrt(np.diag(found)), np.maximum(spread, robust.FLOORS))
    assert found[1, 3] == pytest.approx(robust.SHRINK * 6) and np.linalg.eigvalsh(found).min() > 0


@pytest.mark.parametrize("n", [60, 30])
def test_outliers_are_judged_by_their_pool(spark, n):
    rnd = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(words, 40)), "en", f"s{i % 2}", "x") for i in range(2 * n)]
    rows += [(1000, " ".join(w + "###" for w in rnd.choice(words, 40)), "en", "s0", "x")]
    rows += [(1001, "a b c", "en", "s0", "x"), (1002, "a b c d e f " * 9, "en", "s0", "x"), (1003, None, None, None, "x")]
    found = {r["doc_id"]: r for r in robust.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    assert not found[1000]["base_failed"] and not found[1000]["kept"]
    assert all(found[i]["base_failed"] and not found[i]["kept"] for i in (1001, 1002, 1003))
    assert all(found[i]["kept"] for i in range(2 * n))


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", None, "x")] * 3, SCHEMA)
    assert [r["kept"] for r in robust.judge(docs).collect()] == [True] * 3
    assert robust.judge(docs.limit(0)).count() == 0


def test_labelled_junk_goes_and_good_documents_stay(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = robust.judge(documents).join(labels, "doc_id").filter("not base_failed").toPandas()
    kept = rows.groupby("quality")["kept"].mean()
    assert kept[1] > 0.98 and kept.get(0, 0) < 0.3


def test_each_statistic_alone_leads_to_rejection(spark):
    rnd = np.random.default_rng(7)
    word = [f"w{i:04d}" for i in range(3000)]
    rows = [(i, " ".join(rnd.choice(word, 40, replace=False)), "en", "s", "x") for i in range(100)]
    menu = "\n".join(f"share\nlikes\nmenus\n{w}" for w in word[:30])
    phrase = word[:7] + word[100:160] + word[:7]
    planted = [
        " ".join("w" + w * 3 for w in word[:40]),
        " ".join("#" + w[1:] for w in word[:40]),
        menu,
        " ".join(phrase + word[200:206]),
    ]
    rows += [(1000 + i, text, "en", "s", "x") for i, text in enumerate(planted)]
    found = {r["doc_id"]: r for r in robust.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert [found[1000 + i]["kept"] for i in range(4)] == [False] * 4
    assert all(found[i]["kept"] for i in range(100))


def test_copies_that_are_a_third_of_a_pool_are_rejected(spark):
    rnd = np.random.default_rng(9)
    word = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(word, 40)), "en", "s", "x") for i in range(100)]
    junk = " ".join(f"###{w}" for w in rnd.choice(word, 40, replace=False))
    rows += [(1000 + i, junk, "en", "s", "x") for i in range(50)]
    found = {r["doc_id"]: r for r in robust.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert not any(found[1000 + i]["kept"] for i in range(50))
    assert all(found[i]["kept"] for i in range(100))
