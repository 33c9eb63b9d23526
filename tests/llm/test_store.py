from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldloom.llm import census as counting
from foldloom.llm.lexicon_bpe import frequent_words
from foldloom.llm.queries import tokenizer
from foldloom.llm.store import Scratch, attach, bounded, first_by_hash, shared_folder


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows", [0, 200_000])
def test_attach_joins_hot_and_other_keys(spark, how, rows):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + [None] * 30 + ["a", "b", "none"])], "k string, i int")
    table = spark.createDataFrame([("hot", 5000, 1), (None, 3, 2), ("a", 1, 3), ("b", 1, 4), ("unused", 1, 5)], "k string, n long, v int")
    found = {r["i"]: (r["k"], r["v"]) for r in attach(left, table, ["k"], "n", how, rows).collect()}
    value = {"hot": 1, None: 2, "a": 3, "b": 4}
    want = {r["i"]: (r["k"], value.get(r["k"])) for r in left.collect() if how == "left" or r["k"] in value}
    assert found == want


def test_first_by_hash_is_the_sorted_head(spark):
    rows = spark.range(20000)
    order = [r["id"] for r in rows.orderBy(F.xxhash64(F.lit(3), "id")).collect()]
    top = [r["id"] for r in rows.orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 11)).limit(700).collect()]
    assert [r["id"] for r in first_by_hash(rows, "id", 700, 3).collect()] == top
    assert [r["id"] for r in first_by_hash(rows, "id", 30000, 3).collect()] == order
    assert first_by_hash(rows.limit(0), "id", 5, 3).count() == 0


def test_scratch_tables_go_and_settings_return(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with Scratch(spark) as scratch:
        table = scratch.save(spark.range(5))
        folder = Path(scratch.folders[0].removeprefix("file:"))
        kept = scratch.kept(table)
        assert folder.exists() and str(folder).startswith(shared_folder(spark).removeprefix("file:"))
    assert not folder.exists() and kept.count() == 5
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert bounded(spark.range(5), 5) and not bounded(spark.range(6), 5)


@pytest.mark.parametrize("small", [1 << 18, 40])
def test_census(spark, monkeypatch, small):
    monkeypatch.setattr(counting, "SMALL", small)
    rnd = np.random.default_rng(2)
    rows = [(int(i), rnd.integers(0, 300, rnd.integers(0, 40)).astype(np.uint64) << np.uint64(55)) for i in range(60)]
    rows = [(i, t | np.uint64(1)) for i, t in rows] + [(7, rows[7][1] | np.uint64(1))]
    table = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in rows], "id long, tokens binary")

    def finish(table, docs, first):
        return pa.table(
            {"id": table["id"], "tokens": table["tokens"], "docs": pa.array([d.tolist() for d in docs], pa.list_(pa.int64())),
             "first": pa.array([f.tolist() for f in first], pa.list_(pa.int64()))}
        )

    found = counting.census(table, finish, "id long, tokens binary, docs array<long>, first array<long>").collect()
    holders = defaultdict(set)
    for i, tokens in rows:
        for t in tokens.tolist():
            holders[t].add(i)
    assert len(found) == len(rows)
    for r in found:
        tokens = np.frombuffer(r["tokens"], np.uint64).tolist()
        assert r["docs"] == [len(holders[t]) for t in tokens]
        assert r["first"] == [min(holders[t]) for t in tokens]
    assert counting.census(table.limit(0), finish, "id long, tokens binary, docs array<long>, first array<long>").count() == 0


def test_chunks_grow_once_there_are_many():
    assert [counting.parts_of(n) for n in (0, 1 << 18, 1 << 28, 1 << 29, 1 << 34, 1 << 40)] == [1, 1, 1 << 10, 1 << 11, 1 << 11, 1 << 17]


def test_frequent_words_take_whole_bands(spark):
    text = " ".join(f"w{i}" + f" w{i}" * (2 ** (i // 3)) for i in range(12))
    docs = spark.createDataFrame([(text,), (None,)], "text string")
    path = tokenizer("word_bpe_49k.json")
    assert frequent_words(docs, path, 0) == []
    everything = set(frequent_words(docs, path, 1000))
    assert {b"w", b"1", b"9"} <= everything
    some = set(frequent_words(docs, path, 4))
    assert 0 < len(some) <= 4 and b"w" in some
