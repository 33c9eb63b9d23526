import hashlib
import math

import pytest

from foldloom.llm.poisson_mix import STEP, rates, replicate

SCHEMA = "doc_id long, text string, source string, copy string"


def drawn(doc_id, rate, seed=7):
    """Inversion of the Poisson distribution, summed over parts."""
    parts = max(1, math.ceil(rate / STEP))
    count = 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        term = total = math.exp(-rate / parts)
        k = 0
        while total <= u:
            k += 1
            term *= rate / parts / k
            total += term
        count += k
    return count


@pytest.fixture
def docs(spark):
    rows = [(i, "x" * (i % 50), f"s{i % 3}" if i % 4 else "big", "z") for i in range(2000)]
    rows += [(5000, None, "empty", "z"), (5001, "", "empty", "z"), (5002, "abc", None, "z")]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_are_the_inverted_distribution(docs):
    rate = {r["source"]: r["rate"] for r in rates(docs).collect()}
    found = replicate(docs)
    assert found.columns == ["doc_id", "text", "source", "copy"]
    copies = {}
    for row in found.collect():
        copies.setdefault(row["doc_id"], []).append(row["copy"])
    for row in docs.collect():
        want = drawn(row["doc_id"], rate[row["source"]]) if row["source"] in rate else 0
        assert sorted(copies.get(row["doc_id"], [])) == list(range(1, want + 1))


def test_sizes_follow_the_weights(spark, docs):
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 3.0), ("unknown", 9.0)], "source string, weight double")
    table = {r["source"]: r for r in rates(docs, weights, scale=2.0).collect()}
    total = sum(r["size"] for r in table.values())
    assert table["s1"]["rate"] * table["s1"]["size"] == pytest.approx(2 * total * 3 / 4)
    assert table["big"]["rate"] == 0 and "empty" not in table
    out = replicate(docs, weights, scale=2.0).groupBy("source").sum("copy").count()
    assert out == 2
    sizes = {r[0]: r[1] for r in replicate(docs, weights, scale=2.0).selectExpr("source", "length(text) as n").groupBy("source").sum("n").collect()}
    assert sizes["s1"] / sizes["s0"] == pytest.approx(3, rel=0.2)


def test_large_rates_are_drawn_in_parts(spark):
    docs = spark.createDataFrame([(1, "a", "small", "z"), (2, "b" * 3000, "large", "z")], SCHEMA)
    weights = spark.createDataFrame([("small", 1.0), ("large", 0.0)], "source string, weight double")
    assert rates(docs, weights).filter("source = 'small'").first()["rate"] == 3001
    n = replicate(docs, weights).count()
    assert abs(n - 3001) < 300


def test_order_is_shuffled_and_repeatable(docs):
    first = [(r["doc_id"], r["copy"]) for r in replicate(docs).collect()]
    assert sorted(first) == sorted((r["doc_id"], r["copy"]) for r in replicate(docs.repartition(5)).collect())
    ids = [d for d, _ in first]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_nothing(docs):
    assert replicate(docs.limit(0)).count() == 0
    assert replicate(docs.filter("source = 'empty'")).count() == 0
