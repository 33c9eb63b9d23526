import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldloom.llm import cotraining

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def table(spark):
    """Good pages of good sites, bad pages of bad ones; both views know."""
    import random

    rnd = random.Random(1)
    good, bad = [f"clear{i}" for i in range(80)], [f"spam{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(1200):
        fine = i % 3 > 0
        own = rnd.choices(good if fine else bad, k=40) + rnd.choices(good + bad, k=15)
        rows.append((i, " ".join(own), "en", ("site" if fine else "farm") + str(rnd.randrange(4)), 300, "x"))
        if i % 2:
            labels.append((i, int(fine), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(table):
    docs, labels = table
    rows = cotraining.judge(docs, labels).collect()
    assert len(rows) == 1200
    unseen = [r for r in rows if r["doc_id"] % 2 == 0]
    assert sum(r["kept"] == (r["doc_id"] % 3 > 0) for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_probability", "page_probability", "good_probability"))


def test_views_hand_over_what_they_know(spark):
    good = np.arange(400) % 2.0
    knows, guesses = np.where(good == 1, 4.0, -4.0), 0.01 * (np.arange(400) % 7)

    def labels(margin, held, held_good):
        rows = spark.createDataFrame([(i, float(m)) for i, m in enumerate(margin)], "i int, m double")
        return [r[0] for r in rows.orderBy("i").select(cotraining.handed_over(F.col("m"), held, held_good)).collect()]

    assert labels(knows, knows, good) == good.tolist()
    assert set(labels(guesses, guesses, good)) == {None}
    # a class without evidence stays at home
    assert set(labels(knows, knows[:30], good[:30])[::2]) != {0.0}


def test_a_fit_equals_plain_gradient_descent():
    rnd = np.random.default_rng(2)
    dense = (rnd.random((300, 12)) < 0.3) * rnd.random((300, 12))
    good = (dense[:, 0] + dense[:, 3] - dense[:, 5] + rnd.normal(size=300) / 5 > 0.1).astype(float)
    row, at = np.nonzero(dense)
    first = at < 9
    rows = cotraining.Sparse(300, 9, row[first], at[first], dense[row, at][first], dense[:, 9:])
    got = cotraining.fitted(rows, good)
    spread = dense.std(0)
    x, w, c = dense / spread, np.zeros(12), 0.0
    for _ in range(20_000):
        slope = 1 / (1 + np.exp(-(x @ w + c))) - good
        w -= 0.1 * (x.T @ slope / 300 + cotraining.STRENGTH * w)
        c -= 0.1 * slope.mean()
    np.testing.assert_allclose(got, [*(w / spread), c], atol=0.02)


def test_a_round_equals_a_plain_version(spark, table):
    """One round by numpy alone, over the same rows."""
    docs, labels = table
    from foldloom.llm.store import Scratch

    def plain(rows):
        texts, columns = rows.column("text").combine_chunks(), [rows[c].to_numpy() for c in cotraining.PAGE_COLUMNS]
        return {"text": cotraining.text_rows(texts), "page": cotraining.page_rows(columns)}

    with Scratch(spark) as scratch:
        known = scratch.save(cotraining.labelled(labels))
        model = cotraining.fit(docs, labels, scratch, rounds=0)
        chosen = cotraining._chosen(docs, model, known, scratch, 10_000).toArrow().to_pylist()
    all_rows = docs.select("doc_id", "text", *cotraining.page_features()).toArrow().sort_by("doc_id")
    ids = all_rows["doc_id"].to_numpy()
    x = plain(all_rows)
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    wanted = set()
    for i, (view, other) in enumerate((("text", "page"), ("page", "text"))):
        weights = getattr(model, f"{view}_weights")
        margin = x[view].times(weights[:-1]) + weights[-1]
        slope, offset, high, low = cotraining.limits(model.held_margins[:, i], model.held_good)
        p = 1 / (1 + np.exp(-(slope * margin + offset)))
        for doc, q in zip(ids.tolist(), p, strict=True):
            if doc not in label and (q >= high or q <= low):
                wanted.add((doc, f"for {other}", float(q >= high)))
    assert {(r["doc_id"], r["part"], r["good"]) for r in chosen} == wanted and len(wanted) > 500


def test_confident_rows_come_from_every_source(spark, table):
    docs, labels = table
    from foldloom.llm.store import Scratch

    with Scratch(spark) as scratch:
        known = scratch.save(cotraining.labelled(labels))
        model = cotraining.fit(docs, labels, scratch, rounds=0)
        few = cotraining._chosen(docs, model, known, scratch, 40).select("doc_id", "part", "good").collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    assert 60 < len(few) < 260 and len({source[r["doc_id"]] for r in few}) == 8


def test_many_sources_keep_weights_of_their_own(spark):
    docs = spark.createDataFrame([(i, "t", "en", f"source{i}", 10, "x") for i in range(3000)], DOCS)
    held = docs.select(*cotraining.page_features()).groupBy("_page0").count().toPandas()["count"]
    assert (held * (held - 1)).sum() / 3000 < 0.2


def test_logistic_regression_finds_the_odds():
    at = np.array([[0]] * 100 + [[1]] * 100)
    good = np.array([1.0] * 80 + [0.0] * 20 + [1.0] * 30 + [0.0] * 70)
    weights = cotraining.logistic(at, np.ones((200, 1)), good, 2, 1e-9)
    odds = weights[:2] + weights[2]
    np.testing.assert_allclose(odds, [np.log(4), np.log(3 / 7)], atol=1e-3)


def test_labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, 0), (5, 1, None), (6, 1, 0), (6, 0, 0), (None, 1, 0)]
    found = cotraining.labelled(spark.createDataFrame(rows, LABELS)).collect()
    assert {r["doc_id"]: r["good"] for r in found} == {1: 1.0, 2: 0.0, 3: 0.0, 5: 1.0, 6: 0.0}


def test_tables_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "a", "en", "s", 1, "x"), (None, "b", "en", "s", 1, "x")], DOCS)
    one = spark.createDataFrame([(1, 0, 0)], LABELS)
    assert {r["doc_id"]: r["kept"] for r in cotraining.judge(docs, one).collect()} == {1: False, 2: True, None: True}
    assert [r["kept"] for r in cotraining.judge(docs, one.limit(0)).collect()] == [True] * 3
    assert cotraining.judge(docs.limit(0), one.limit(0)).count() == 0


def test_null_columns_are_scored(spark, table):
    docs, labels = table
    odd = spark.createDataFrame([(5000, None, None, None, None, "x"), (None, "", None, "s", 3, "x"), (5001, "x " * 20000, "en", None, 9, "x")], DOCS)
    rows = cotraining.judge(docs.unionByName(odd), labels).filter("doc_id is null or doc_id >= 5000").collect()
    assert len(rows) == 3 and all(r["good_probability"] is not None for r in rows)


def test_words_of_a_large_vocabulary_have_weights_of_their_own():
    words = cotraining.text_rows(pa.array([f"word{i}" for i in range(20_000)]))
    held = np.bincount(words.at)
    # others that share a word's weight, on average
    assert (held * (held - 1)).sum() / 20_000 < 1


def test_held_out_rows_of_each_class(spark, table):
    docs, labels = table
    from foldloom.llm.store import Scratch

    rare = labels.filter("quality = 1").unionByName(labels.filter("quality = 0").limit(2))
    with Scratch(spark) as scratch:
        rows = cotraining._sample(docs, scratch.save(cotraining.labelled(rare)), scratch, 10_000)
        parts = {(r["part"], r["good"]): r["count"] for r in rows.groupBy("part", "good").count().collect()}
    assert parts["held", 0.0] == parts["train", 0.0] == 1 and parts["held", 1.0] == 80


def test_repeated_rows_are_learned_from_once(spark, table):
    docs, labels = table
    twice = docs.unionByName(docs.filter("doc_id % 4 = 1").withColumn("text", F.concat("text", F.lit(" longer"))))
    one = {r["doc_id"]: r["good_probability"] for r in cotraining.judge(docs, labels, rounds=0).collect()}
    rows = cotraining.judge(twice, labels, rounds=0).collect()
    assert len(rows) == 1500 and all(min(abs(r["good_probability"] - one[r["doc_id"]]) for r in rows if r["doc_id"] == i) < 1e-9 for i in (1, 2, 5))
