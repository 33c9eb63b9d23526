import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldloom.operators import models
from foldloom.plans import features as fe
from foldloom.plans import recommend
from foldloom.sources import logs
from foldloom.sources.model_store import Entry, ModelStore
from foldloom.sources.snapshots import Conflict, Snapshots

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def frame(spark):
    return spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 4).cast("int").alias("fold"),
        (F.col("id") % 13).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"),
        (F.col("id") % 13 * 3 - F.col("id") * 7 % 11).cast("double").alias("y"),
    )


def rows(spark, values, schema="dataset string, n int"):
    return spark.createDataFrame(values, schema)


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_kept_apart(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s")
    assert store.version() == 0 and store.read("t") is None
    store.commit({"t": rows(spark, [("a", 1)]), "u": rows(spark, [("x", 9)])})
    store.commit({"t": rows(spark, [("b", 2)])})
    assert pairs(store.read("t")) == [("b", 2)] and pairs(store.read("t", 1)) == [("a", 1)]
    assert pairs(store.read("u")) == [("x", 9)]


def test_merge_is_repeatable_and_keeps_other_rows(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s")
    store.merge("t", rows(spark, [("a", 1), (None, 2), ("b", 3)]), ["dataset"])
    for _ in range(2):
        store.merge("t", rows(spark, [(None, 7), ("b", 4), ("c", 5)]), ["dataset"])
    assert pairs(store.read("t")) == sorted([("a", 1), (None, 7), ("b", 4), ("c", 5)], key=repr)


def test_the_slower_writer_starts_over(spark, tmp_path, monkeypatch):
    one, two = Snapshots(spark, f"{tmp_path}/s"), Snapshots(spark, f"{tmp_path}/s")
    one.commit({"t": rows(spark, [("a", 1)])})
    with pytest.raises(Conflict):
        two.commit({"t": rows(spark, [("z", 0)])}, base=0)
    assert pairs(one.read("t")) == [("a", 1)]
    commit, calls = Snapshots.commit, []

    def raced(self, tables, base=None):
        if not calls:
            calls.append(1)
            commit(one, {"t": rows(spark, [("a", 1), ("b", 2)])})
        return commit(self, tables, base)

    monkeypatch.setattr(Snapshots, "commit", raced)
    two.merge("t", rows(spark, [("c", 3)]), ["dataset"])
    assert pairs(one.read("t")) == [("a", 1), ("b", 2), ("c", 3)]


def test_half_written_versions_are_never_read(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, f"{tmp_path}/s")
    store.commit({"t": rows(spark, [("a", 1)])})
    monkeypatch.setattr(Snapshots, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.commit({"t": rows(spark, [("half", 0)])})
    monkeypatch.undo()
    (tmp_path / "s/commits/.aside").write_text('{"t": ')
    again = Snapshots(spark, f"{tmp_path}/s")
    assert again.version() == 1 and pairs(again.read("t")) == [("a", 1)]
    assert len(again.vacuum()) == 1 and pairs(again.read("t")) == [("a", 1)]


def test_models_predict_alike_in_a_new_session(spark, frame, tmp_path):
    packed = models.assemble(frame, ["a", "b"], "y", ["row_id", "fold"]).persist()
    store = ModelStore(spark, f"{tmp_path}/m")
    for algorithm, params in (("decision_tree", {"max_depth": 3}), ("random_forest", {"n_estimators": 3})):
        fitted = models.fit_by_fold(packed, algorithm, params)
        store.save(Entry("d", f, algorithm, m, params) for f, m in fitted.items())
        want = models.predict_with(fitted, packed)
        want.write.parquet(f"{tmp_path}/{algorithm}")
    packed.select("row_id", "fold", "features", "target").write.parquet(f"{tmp_path}/packed")
    assert store.index().count() == 8 and store.load("d", 2, "random_forest")[1] == {"n_estimators": 3}
    with pytest.raises(KeyError):
        store.load("d", 9, "random_forest")
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from foldloom.operators import models
from foldloom.session import build_session
from foldloom.sources.model_store import ModelStore
spark = build_session("again", "local[2]", 2)
store, packed = ModelStore(spark, "{tmp_path}/m"), spark.read.parquet("{tmp_path}/packed")
for name in ("decision_tree", "random_forest"):
    got = models.predict_with(store.folds("d", name), packed)
    want = spark.read.parquet(f"{tmp_path}/{{name}}")
    assert got.count() == 400 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
print("EQUAL")
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert "EQUAL" in ran.stdout, ran.stderr[-2000:]


def test_a_saved_model_is_replaced_and_the_old_one_vacuumed(spark, frame, tmp_path):
    packed = models.assemble(frame, ["a", "b"], "y", ["row_id", "fold"]).persist()
    store = ModelStore(spark, f"{tmp_path}/m")
    for depth in (1, 3):
        model = models.make_estimator("decision_tree", {"max_depth": depth}).estimator.fit(packed)
        store.save([Entry("d", None, "tree", model, {"max_depth": depth})])
    assert store.load("d", None, "tree")[0].depth == 3
    assert len(store.vacuum()) > 0
    assert ModelStore(spark, f"{tmp_path}/m").load("d", None, "tree")[0].depth == 3


def test_feature_states_survive(spark, frame, tmp_path):
    raw = frame.withColumn("kind", F.when(F.col("a") > 4, "x").when(F.col("a") > 2, "y")).withColumn(
        "a", F.when(F.col("row_id") % 9 > 0, F.col("a"))
    )
    clean = fe.fit_clean_features(raw, "y", ["row_id", "fold"])
    clean.save(f"{tmp_path}/clean")
    again = fe.CleanFeatures.load(spark, f"{tmp_path}/clean")
    assert pairs(again.transform(raw)) == pairs(clean.transform(raw))
    auto = fe.fit_auto_features(clean.transform(raw), "y", ["row_id", "fold"])
    auto.save(f"{tmp_path}/auto")
    again = fe.SelectedFeatures.load(spark, f"{tmp_path}/auto")
    assert again == auto
    assert pairs(again.transform(clean.transform(raw))) == pairs(auto.transform(clean.transform(raw)))


def test_recommender_survives(spark, tmp_path):
    meta = spark.range(40).select(
        F.col("id").alias("dataset_id"), (F.col("id") % 7).cast("double").alias("n"), (F.col("id") % 3).cast("double").alias("m"),
        F.when(F.col("id") % 3 == 0, "knn").otherwise("random_forest").alias("algorithm"),
        F.create_map(F.lit("n_estimators"), (F.col("id") + 50).cast("string")).alias("params"),
    )
    heads = recommend.fit_heads(meta, ["n", "m"])
    store = ModelStore(spark, f"{tmp_path}/m")
    recommend.save_heads(store, "first", heads)
    again = recommend.load_heads(ModelStore(spark, f"{tmp_path}/m"), "first")
    as_text = lambda h: pairs(recommend.predict_heads(h, meta).withColumn("hyperparams", F.to_json("hyperparams")))
    assert as_text(again) == as_text(heads)
    assert not store.vacuum() or recommend.load_heads(store, "first").labels == heads.labels
    with pytest.raises(KeyError):
        recommend.load_heads(store, "second")


def test_repeated_searches_do_not_double_the_log(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/log")
    trials = rows(spark, [(1, "ridge", 0, 0.5), (1, "ridge", 1, 0.6)], "trial long, algorithm string, fold int, r2 double")
    logs.merge_trials(store, "a", trials.limit(1))
    for _ in range(2):
        logs.merge_trials(store, "a", trials)
        logs.merge_trials(store, "b", trials)
    assert store.read("trials").groupBy("dataset").count().orderBy("dataset").collect() == [("a", 2), ("b", 2)]
