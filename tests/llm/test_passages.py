import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldloom.llm import passages
from foldloom.llm.store import sifted

AFTER_ALL = 1 << 63


def brute(rows, words, window):
    docs = [(doc if doc is not None else AFTER_ALL, words(text), doc) for doc, text in rows]
    first = {}
    for doc, own, _ in docs:
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, own, name in docs:
        keep = [True] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < doc:
                keep[i : i + window] = [False] * window
        kept = [w for w, k in zip(own, keep, strict=True) if k]
        out.append((name, len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def shared_passages(seed, n, vocabulary, longest):
    rnd = random.Random(seed)
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, longest))] for _ in range(6)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rnd.randint(0, 4)):
            part = rnd.choice(base)
            if part and rnd.random() < 0.7:
                at = rnd.randrange(len(part))
                own += part[at : at + rnd.randint(0, longest)]
            else:
                own += [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))]
        doc = rnd.randint(0, 3 * n) if rnd.random() < 0.1 else i if rnd.random() > 0.03 else None
        rows.append((doc, rnd.choice([" ", "\n", "  "]).join(own) if rnd.random() > 0.03 else None))
    return rows


def result(docs, **options):
    found = passages.repeated_passages(docs, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize(
    ("vocabulary", "longest", "options"),
    [
        (["a", "b"], 40, {"window": 10, "phrase": 5}),
        (["a", "b", "é", "d", "e"], 60, {"window": 10, "phrase": 5, "shard_bytes": 200, "stream_bytes": 300}),
        ([f"w{i}" for i in range(300)], 150, {}),
    ],
)
def test_removal_matches_brute_force(spark, words, vocabulary, longest, options):
    rows = shared_passages(5, 120, vocabulary, longest)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, words, options.get("window", passages.WINDOW))
    assert any(0 < r[2] < r[1] for r in want)
    assert result(docs, **options) == want


def test_test_documents_match_brute_force(spark, documents, words):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert result(documents) == brute(rows, words, passages.WINDOW)


def test_text_without_passages(spark, words):
    rows = shared_passages(8, 60, ["a", "b", "c", "é"], 50)
    rows = [(i, t, "x") for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    left = passages.without_passages(docs, window=10, phrase=5)
    want = {r[0]: r[3] for r in brute([r[:2] for r in rows], words, 10)}
    found = left.collect()
    assert left.columns == docs.columns and len(found) == len(rows)
    for row in found:
        assert hashlib.sha256(b" ".join(words(row["text"]))).hexdigest() == want[row["doc_id"]]


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert result(docs) == [] and passages.without_passages(docs).count() == 0


def test_equal_windows_select_the_same_phrase():
    rnd = np.random.default_rng(1)
    part = rnd.integers(0, 1 << 60, 40).astype(np.uint64)
    left = np.concatenate((rnd.integers(0, 1 << 60, 13).astype(np.uint64), part))
    right = np.concatenate((part, part))
    for reach in (6, 26):
        a = left[passages.selected(left, np.arange(13, 13 + 40 - reach + 1), reach)]
        b = right[passages.selected(right, np.arange(40 - reach + 1), reach)]
        assert a.tolist() == b.tolist() == [part[i : i + reach].min() for i in range(40 - reach + 1)]
    same = np.zeros(1000, np.uint64)
    assert len(np.unique(passages.selected(same, np.arange(975), 26))) <= 40


def test_automaton_extends_matches_to_smaller_documents_only():
    own = [b"p%d" % i for i in range(60)]
    rows = pa.table(
        {"owner": [3], "words": [b" ".join(own)], "phrases": [np.array([5, 31], "<i4").tobytes()]}
    )
    machine = passages.Automaton(rows, 50, 25)
    text = b" ".join([b"new", *own[2:58], b"other"])
    assert machine.runs(9, text) == {(1, 57)}
    assert machine.runs(3, text) == set() and machine.runs(2, text) == set()
    assert machine.runs(9, b" ".join(own[5:40])) == set()


def test_runs_of_repetitive_text_are_told_together():
    line = [b"w%d" % i for i in range(5)]
    owner = [*line * 60, b"end"]
    places = np.arange(0, 275, 5, dtype="<i4").tobytes()
    machine = passages.Automaton(pa.table({"owner": [3], "words": [b" ".join(owner)], "phrases": [places]}), 50, 25)
    assert machine.runs(9, b" ".join([b"new", *line * 40, b"other"])) == {(1, 201)}
    twice = [b"new", *line * 40, b"other", *line * 30]
    assert machine.runs(9, b" ".join(twice)) == {(1, 201), (202, 352)}


def test_rows_of_confirmed_runs_follow_the_words_not_the_repeats(spark, words, monkeypatch):
    rows = [(i, " ".join([f"a{i}", *["to be or not to"] * (40 + i), f"b{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    confirm, counts = passages.confirm, []

    def counted(*given):
        found = confirm(*given)
        counts.append(found.count())
        return found

    monkeypatch.setattr(passages, "confirm", counted)
    assert result(docs) == brute(rows, words, passages.WINDOW)
    assert sum(counts) <= 2 * len(rows)


@pytest.mark.parametrize("step", ["phrases", "windows_left"])
def test_texts_are_hashed_in_small_slices_and_memory_is_given_back(monkeypatch, step):
    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    taken, given = [], []
    words_of, released = passages.words_of, passages.released
    monkeypatch.setattr(passages, "words_of", lambda texts: taken.append(texts.nbytes) or words_of(texts))
    monkeypatch.setattr(passages, "released", lambda batches: given.append(1) or released(batches))
    n = 400
    none = np.zeros(0, "<i4").tobytes()
    batch = pa.record_batch(
        {
            "doc_id": pa.array(range(n), pa.int64()), "key": pa.array(range(n), pa.int64()),
            "text": [f"w{i} " * 1000 for i in range(n)], "places": [none] * n, "first": [none] * n,
            "runs": pa.nulls(n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
    )
    list(getattr(passages, step)(Docs(), 50, 25).run(iter([batch])))
    assert 4 < len(taken) and max(taken) < 300_000 and given


def hash_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_are_not_shuffled_again_for_each_join(spark, words, monkeypatch):
    """Only the runs and places are, also where they are too large to broadcast."""
    rows = shared_passages(6, 120, [f"w{i}" for i in range(300)], 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(passages, "bounded", lambda df: False, raising=False)
    counts = {}
    for step in ("cut", "windows_left", "_judged"):
        run = getattr(passages, step)

        def counted(df, *given, step=step, run=run):
            counts.setdefault(step, []).append(hash_exchanges(df))
            return run(df, *given)

        monkeypatch.setattr(passages, step, counted)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = result(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert found == brute(rows, words, passages.WINDOW)
    assert counts == {"cut": [0, 1], "windows_left": [1], "_judged": [1]}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("table_")]


def test_only_repeated_word_sequences_are_joined_to_the_documents(spark, words, monkeypatch):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(60))) for i in range(20)]
    rows += [(30, rows[3][1]), (31, rows[3][1] + " "), (2, rows[5][1]), (5, rows[5][1]), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    attach, sizes = passages.attach, []

    def counted(df, table, keys, *given):
        sizes.extend([table.count()] * (keys == ["words_sha256"]))
        return attach(df, table, keys, *given)

    monkeypatch.setattr(passages, "attach", counted)
    assert result(docs) == brute(rows, words, passages.WINDOW)
    assert sizes == [2, 2]


def test_many_ids_are_sifted_by_bits_without_a_shuffle_of_the_rows(spark):
    ids = spark.range(0, 40_000, 8).select((F.col("id") * F.col("id") - 7).alias("doc_id"))
    docs = spark.range(40_000).select((F.col("id") * F.col("id") - 7).alias("doc_id"), F.lit("x").alias("text"))
    left = sifted(docs, ids, "doc_id")
    assert left.columns == docs.columns and hash_exchanges(left) == 0
    assert left.join(ids, "doc_id", "left_semi").count() == 5_000
    assert left.count() - 5_000 < 35_000 / 12
    assert sifted(docs, ids.limit(0), "doc_id").count() == 0
