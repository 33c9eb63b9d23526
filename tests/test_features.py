import math

import pytest
from pyspark.sql import functions as F

from foldloom.operators import clean, columns, derive, scale
from foldloom.plans import features as fe


def _mixed(spark, n=300):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row_id"),
        F.when(i % 7 != 0, F.sin(i) * 10).alias("a"),
        (i % 13).cast("int").alias("b"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(4.0).alias("flat"),
        F.when(i % 5 == 0, None).otherwise(F.concat(F.lit("c"), i % 4)).alias("kind"),
        (i * 2.0).alias("target"),
    )


def test_no_missing_or_infinite_cells_and_same_schema(spark):
    df = _mixed(spark)
    train, test = df.filter("row_id % 10 <> 0"), df.filter("row_id % 10 = 0")
    fitted = fe.fit_manual_features(train, "target", ["row_id"])
    # new category, missing column, extra column in the later frame
    later = test.withColumn("kind", F.lit("zz_new")).drop("b").withColumn("extra", F.lit(1))
    a, b = fitted.transform(train), fitted.transform(later)
    assert a.columns == b.columns == ["row_id", "target", *fitted.names]
    for out in (a, b):
        row = clean.remaining_issues(out).first()
        assert (row["missing"], row["infinite"]) == (0, 0)


def test_width_follows_the_column_kinds(spark):
    def width(non_negative, categorical):
        i = F.col("id")
        df = spark.range(40).select(
            *[((i * (j + 3)) % (j + 5)).cast("double").alias(f"x{j}") for j in range(non_negative)],
            *[F.concat(F.lit("v"), i % 3).alias(f"c{j}") for j in range(categorical)],
            i.cast("double").alias("target"),
        )
        return len(fe.fit_manual_features(df, "target").names)

    assert width(11, 1) == 93
    assert len(fe.feature_names([f"x{j}" for j in range(81)], [], {f"x{j}": 0.0 for j in range(81)})) == 440
    assert width(1, 0) == 1 + 4


def test_wide_frame_runs(spark):
    i = F.col("id")
    df = spark.range(60).select(
        *[((i * (j + 3)) % (j + 5)).cast("double").alias(f"x{j}") for j in range(81)], i.cast("double").alias("target")
    )
    fitted = fe.fit_manual_features(df, "target")
    assert len(fitted.names) == 440
    assert fitted.transform(df).count() == 60


def test_test_rows_never_change_the_state(spark):
    df = _mixed(spark)
    train = df.filter("row_id < 200")
    fitted = fe.fit_manual_features(train, "target", ["row_id"])
    alone = fitted.transform(train.limit(5)).collect()
    mixed = fitted.transform(df.withColumn("a", F.when(F.col("row_id") >= 200, 1e9).otherwise(F.col("a"))))
    wanted = {r["row_id"]: r for r in alone}
    for r in mixed.filter(F.col("row_id").isin(list(wanted))).collect():
        assert r == wanted[r["row_id"]]


def test_save_and_load(spark, tmp_path):
    df = _mixed(spark)
    fitted = fe.fit_manual_features(df, "target", ["row_id"])
    fitted.save(f"{tmp_path}/state")
    again = fe.ManualFeatures.load(spark, f"{tmp_path}/state")
    assert fitted.transform(df).exceptAll(again.transform(df)).count() == 0


def test_transform_accepts_a_stream(spark, tmp_path):
    df = _mixed(spark)
    fitted = fe.fit_manual_features(df, "target", ["row_id"])
    df.write.parquet(f"{tmp_path}/in")
    stream = fitted.transform(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("engineered").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("engineered").exceptAll(fitted.transform(df)).count() == 0


def test_clean_features_drop_constant_and_cap(spark):
    df = _mixed(spark)
    train, test = df.filter("row_id % 10 <> 0"), df.filter("row_id % 10 = 0")
    fitted = fe.fit_clean_features(train, "target", ["row_id"], test)
    assert set(fitted.selected) == {"a", "b", "kind"}
    out = fitted.transform(test)
    assert out.columns == ["row_id", "target", "a", "b", "kind"]
    assert clean.remaining_issues(out).first()["missing"] == 0
    auto = fe.fit_auto_features(fitted.transform(train), "target", ["row_id"], cap=2)
    assert len(auto.selected) == 2
    assert auto.transform(out).count() == test.count()


def test_selection_prefers_the_informative_feature(spark):
    i = F.col("id")
    df = spark.range(400).select(
        F.sin(i * 12.9898).alias("signal"), F.cos(i * 78.233).alias("noise"),
        (F.sin(i * 12.9898) * 5 + F.cos(i * 3.7) * 0.1).alias("target"),
    )
    assert fe.select_features(df, ["noise", "signal"], "target", 1) == ["signal"]


def test_infinite_cells_of_an_all_infinite_column(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),)], "x double")
    out = clean.clip_infinite(df, clean.fit_clip(df, ["x"]), ["x"])
    assert [r[0] for r in out.collect()] == [0.0, 0.0]


def test_clean_for_folds_replaces_infinities_by_the_median(spark):
    rows = [(i, float(i), "k", float(i)) for i in range(9)] + [(9, float("inf"), None, float("-inf")), (10, float("nan"), "j", None)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, y double")
    out = {r["row_id"]: r for r in fe.clean_for_folds(df, "y", ["row_id"]).collect()}
    assert all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in out.values())
    assert out[10]["x"] == 4.5 and out[9]["c"] == 1 and out[10]["c"] == 0


def test_row_stats_skip_missing_cells(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    rows = derive.with_row_stats(df, ["a", "b", "c"]).collect()
    assert rows[0]["row_mean"] == 2.0 and rows[0]["row_std"] == pytest.approx(math.sqrt(2)) and rows[0]["row_range"] == 2.0
    assert rows[1]["row_mean"] is None and rows[1]["row_std"] == 0.0
    assert rows[2]["row_std"] == 0.0
    medians = df.selectExpr(f"{derive.row_median(['a', 'b', 'c'])} as m").collect()
    assert [r["m"] for r in medians] == [2.0, None, 2.0]


def test_nested_columns_are_rejected(spark):
    with pytest.raises(TypeError, match="nested"):
        columns.column_kinds(spark.createDataFrame([([1],)], "a array<int>"))


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r[0] for r in scale.standard_scale(df, scale.fit_standard(df, ["x"]), ["x"]).collect()] == [0.0, 0.0]
