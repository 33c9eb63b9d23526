import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from foldloom.operators import grown, linear, metrics, models
from foldloom.operators.packed import Packed, pack
from foldloom.plans import features as fe
from foldloom.plans import grid, grouped


def frame(spark, rows=240, shift=0, seed=3):
    """Two numeric columns with gaps, a constant, a text with rare values, four folds."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        a, b, c = float(draw.integers(0, 9)), float(np.round(draw.normal(), 2)), ["x", "y", "z", None, f"r{i % 17}"][draw.integers(0, 5)]
        y = 3 * a - 2 * b + (c == "x") * 5 + draw.normal() + shift
        out.append((i + shift, i % 4, None if i % 11 == 0 else a, None if i % 13 == 0 else b, 7.0, c, None if i % 29 == 0 else float(y)))
    schema = "row_id long, fold int, a double, b double, same double, c string, y double"
    return spark.createDataFrame(out, schema)


def described(states, key):
    s = states[key]
    return [*map(np.ndarray.tolist, (s.fill, s.center, s.scale, s.log_center, s.log_scale, s.low)), s.kept, s.selected]


def fitted(packed):
    states = grouped.fit_clean(packed)
    grouped.select(packed, states)
    return states


TRIALS = [
    grid.Trial(7, "ridge", {"alpha": "2.0"}), grid.Trial(8, "lasso", {"alpha": "0.05"}),
    grid.Trial(9, "decision_tree", {"max_depth": "3", "min_samples_leaf": "5"}),
    grid.Trial(10, "random_forest", {"n_estimators": "3", "max_depth": "3", "max_features": "sqrt", "bootstrap": "x"}),
    grid.Trial(11, "gradient_boosting", {"n_estimators": "3", "max_depth": "2", "learning_rate": "0.3", "subsample": "0.8"}),
]


def test_no_row_of_a_fold_touches_its_state_or_models(spark):
    raw = frame(spark)
    own = F.col("fold") == 2
    changed = raw.withColumns({
        "y": F.when(own, F.col("y") * -9 + 1000).otherwise(F.col("y")),
        "a": F.when(own, F.lit(-500.0)).otherwise(F.col("a")),
        "same": F.when(own, F.col("row_id").cast("double")).otherwise(F.col("same")),
        "c": F.when(own, F.concat(F.lit("aa"), F.col("row_id"))).otherwise(F.col("c")),
    })
    models_of = []
    for df in (raw, changed):
        packed = pack({"d": (df, "y")})
        states = fitted(packed)
        models_of.append((states, grid.fit(packed, states, TRIALS)))
    (s1, f1), (s2, f2) = models_of
    assert described(s1, ("d", 2)) == described(s2, ("d", 2))
    assert described(s1, ("d", 1)) != described(s2, ("d", 1))
    assert f1.weights["d", 2].tolist() == f2.weights["d", 2].tolist()
    for i in (2, 3, 4):
        assert f1.forests.trees["d", 2, i] == f2.forests.trees["d", 2, i]


def test_state_equals_that_of_a_dataset_alone(spark):
    raw = frame(spark)
    packed = pack({"d": (raw, "y"), "e": (frame(spark, 90, 5, 8), "y")})
    states = grouped.fit_clean(packed)
    got = grouped.engineered(packed, states)
    for held_out in (0, 3):
        alone = fe.fit_clean_features(raw.filter(F.col("fold") != held_out), "y", ["row_id", "fold"])
        want = {r["row_id"]: r for r in alone.transform(raw).collect()}
        layout, state = packed.layout["d"], states["d", held_out]
        names = [layout.names[c] for c in state.kept]
        assert set(names) == set(alone.selected) and "same" not in names
        for r in got.filter(f"dataset = 'd' and held_out = {held_out}").collect():
            assert r["features"] == pytest.approx([want[r["row_id"]][n] for n in names], abs=1.1e-3)


def test_jobs_do_not_grow_with_datasets_and_trials(spark):
    def jobs(sets, trials):
        group = f"count-{sets}-{len(trials)}"
        packed = pack({f"d{i}": (frame(spark, 60, i), "y") for i in range(sets)})
        spark.sparkContext.setJobGroup(group, group)
        try:
            grid.scores(packed, grid.fit(packed, fitted(packed), trials))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    tree = [grid.Trial(i, "decision_tree", {"max_depth": "2"}) for i in range(6)]
    assert jobs(4, tree) <= jobs(1, tree[:1])


def few_values(spark, n=600):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 12, (n, 3)).astype(float)
    y = x[:, 0] * (x[:, 1] > 5) + np.sqrt(x[:, 2]) + draw.normal(size=n) / 7
    rows = [(i, i % 2, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, fold int, f0 double, f1 double, f2 double, y double")


@pytest.mark.parametrize("kind", ["tree", "boosted"])
def test_trees_equal_those_of_spark(spark, kind):
    """On features of few distinct values, where both have the same bins."""
    df = few_values(spark)
    packed = pack({"d": (df, "y")})
    spec = grown.TreeSpec(0, kind, 4 if kind == "boosted" else 1, depth=4, min_leaf=6, rate=0.2)
    got = grown.grow(packed, lambda b, at, h: b.x, [spec])
    vectors = models.assemble(df, ["f0", "f1", "f2"], "y", ["row_id", "fold"])
    common = dict(featuresCol="features", labelCol="target", maxDepth=4, minInstancesPerNode=6, predictionCol="p")
    for held_out in (0, 1):
        own = DecisionTreeRegressor(**common) if kind == "tree" else GBTRegressor(**common, maxIter=4, stepSize=0.2)
        model = own.fit(vectors.filter(F.col("fold") != held_out))
        want = [(r["features"].toArray(), r["p"]) for r in model.transform(vectors).collect()]
        p = got.predict("d", held_out, 0, np.array([x for x, _ in want]))
        assert p == pytest.approx(np.array([v for _, v in want]), abs=1e-9)


def test_ensembles_do_not_depend_on_partitions(spark):
    df = few_values(spark)
    specs = [grown.TreeSpec(0, "forest", 5, depth=4, subset="sqrt"), grown.TreeSpec(1, "boosted", 3, depth=2, sample=0.6, subset=0.5)]
    one, many = (
        grown.grow(Packed(p.rows.repartition(n), p.layout, p.modes), lambda b, at, h: b.x, specs)
        for p in [pack({"d": (df, "y")})]
        for n in (1, 5)
    )
    x = np.random.default_rng(0).integers(0, 12, (50, 3)).astype(float)
    for trial in (0, 1):
        assert one.predict("d", 0, trial, x) == pytest.approx(many.predict("d", 0, trial, x))
    trees = one.trees["d", 0, 0]
    assert len(trees) == 5 and len({tuple(t.feature) for t in trees}) > 1


def test_scores_equal_the_metrics_of_the_predictions(spark):
    packed = pack({"d": (frame(spark), "y"), "e": (frame(spark, 100, 3, 5), "y")})
    fit = grid.fit(packed, fitted(packed), TRIALS)
    rows = grid.predictions(packed, fit)
    assert rows.count() == 340 * len(TRIALS)
    want = {
        (r["dataset"], r["trial"], r["fold"]): (r["n"], r["mse"], r["mae"], r["r2"], r["rmse"])
        for r in metrics.regression_metrics(rows, ["dataset", "trial", "fold"]).collect()
    }
    scores = grid.scores(packed, fit).collect()
    assert len(scores) == len(want) == 2 * 4 * len(TRIALS)
    for r in scores:
        got = (r["n"], r["mse"], r["mae"], r["r2"], r["rmse"])
        assert got == pytest.approx(want[r["dataset"], r["trial"], r["fold"]], rel=1e-9)
    assert max(r["r2"] for r in scores) > 0.4
    assert grid.tree_spec(TRIALS[3], 0)[1] == ("bootstrap",)
    best = {(r["dataset"], r["algorithm"]): r["n_trials"] for r in grid.best_trials(grid.scores(packed, fit)).collect()}
    assert len(best) == 10 and set(best.values()) == {1}


def test_linear_weights_solve_the_normal_equations(spark):
    packed = pack({"d": (frame(spark), "y")})
    states = fitted(packed)
    weights = grid.fit(packed, states, TRIALS[:1]).weights["d", 1][0]
    rows = grouped.engineered(packed, states).filter("held_out = 1 and fold <> 1 and y is not null").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + 2 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    assert weights[:-1] == pytest.approx(want)
    assert isinstance(grouped.moments_of(np.eye(3), ["f"]), linear.Moments)


def test_odd_datasets(spark):
    none = spark.createDataFrame([], "row_id long, fold int, a double, y double")
    gaps = spark.createDataFrame(
        [(i, i % 2, None, float("nan") if i % 3 else float("inf"), None if i % 2 else float(i)) for i in range(12)],
        "row_id long, fold int, a double, b double, y double",
    )
    texts = spark.createDataFrame([(i, i % 2, f"t{i}", float(i % 2)) for i in range(10)], "row_id long, fold int, c string, y double")
    lone = spark.createDataFrame([(i, 0, float(i), float(i)) for i in range(5)], "row_id long, fold int, a double, y double")
    packed = pack({"none": (none, "y"), "gaps": (gaps, "y"), "texts": (texts, "y"), "lone": (lone, "y")})
    assert "none" not in packed.layout
    fit = grid.fit(packed, fitted(packed), [TRIALS[0], TRIALS[2]])
    found = {(r["dataset"], r["fold"]): r["n"] for r in grid.scores(packed, fit).filter("trial = 7").collect()}
    # all labels of gaps are in fold 0, the one fold of lone has no training rows
    assert found == {("texts", 0): 5, ("texts", 1): 5}
    assert ("gaps", 1) in fit.weights and ("gaps", 0) not in fit.weights
    with pytest.raises(ValueError, match="no grouped form"):
        grid.fit(packed, {}, [grid.Trial(0, "knn", {})])


def test_cuts_are_chosen_near_equal_shares():
    counts, edge = np.ones(100), np.arange(100.0)
    cuts = grown.cuts_of(counts, edge, edge, 4)
    assert cuts.tolist() == [24.5, 49.5, 74.5]
    assert grown.cuts_of(counts[:3], edge[:3], edge[:3], 32).tolist() == [0.5, 1.5]


def test_selection_votes_are_of_row_subsets(spark):
    packed = pack({"d": (frame(spark, 400), "y")})
    states = grouped.fit_clean(packed)
    key = ("d", 1)
    candidates = states[key].candidates()
    rows = grouped.engineered(packed, states).filter("held_out = 1 and fold <> 1 and y is not null").collect()
    ids, y = np.array([r["row_id"] for r in rows]), np.array([r["y"] for r in rows])
    grouped.select(packed, states, cap=4)
    # by hand, from the rows of each run
    state = states[key]
    blocks = {r["row_id"]: r for r in rows}
    layout = packed.layout["d"]
    x = np.array([[blocks[i]["features"][list(state.kept).index(c)] for c, _ in candidates] for i in ids])
    for j, (c, step) in enumerate(candidates):
        if step == "log":
            x[:, j] = np.log(np.maximum(x[:, j], state.low[c]))
        elif step:
            x[:, j] = np.sqrt(np.maximum(x[:, j], state.low[c])) if step == "sqrt" else np.abs(x[:, j])
    number = grouped.row_blocks(ids, 10)
    votes, weight = np.zeros(len(candidates)), np.zeros(len(candidates))
    for run in range(5):
        own = number % 5 != run
        v = np.concatenate((np.ones((own.sum(), 1)), x[own], y[own, None]), axis=1)
        w, _, _ = grouped.importance(v.T @ v, grouped.SELECTION_ALPHA)
        votes, weight = votes + (w > 0), weight + w
    order = sorted(range(len(candidates)), key=lambda i: (-votes[i], -round(weight[i], 9)))
    assert set(state.selected) <= {candidates[i] for i in order if votes[i] >= votes[order[3]]}
    assert len(state.selected) == 4 and state.names(layout)


def test_outer_labels_do_not_change_the_choice(spark):
    raw = frame(spark)
    trials = [grid.Trial(i, "ridge", {"alpha": a}) for i, a in enumerate(("0.1", "50", "5000"))]
    changed = raw.withColumn("y", F.when(F.col("fold") == 2, -40 * F.col("y")).otherwise(F.col("y")))
    found = []
    for df in (raw, changed):
        packed = pack({"d": (df, "y")})
        found.append({r["fold"]: r for r in grid.nested_linear(packed, fitted(packed), trials).collect()})
    a, b = found[0][2], found[1][2]
    assert (a["trial"], a["inner_r2"]) == (b["trial"], b["inner_r2"]) and a["mse"] != b["mse"]
    assert len(found[0]) == 4 and found[0][1]["inner_r2"] != found[1][1]["inner_r2"]
    with pytest.raises(ValueError, match="linear"):
        grid.nested_linear(packed, {}, TRIALS)


def test_nested_errors_equal_those_of_the_rows(spark):
    packed = pack({"d": (frame(spark), "y")})
    states = fitted(packed)
    trial = [grid.Trial(0, "ridge", {"alpha": "2.0"})]
    nested = {r["fold"]: r for r in grid.nested_linear(packed, states, trial).collect()}
    for r in grid.scores(packed, grid.fit(packed, states, trial)).collect():
        assert (nested[r["fold"]]["n"], nested[r["fold"]]["mse"]) == (r["n"], pytest.approx(r["mse"]))


def test_profiles_share_their_plan(spark):
    from foldloom.operators import profile, profiles

    frames = {f"d{i}": (frame(spark, 50 + i, i).drop("fold"), "y") for i in range(5)}
    frames["none"] = (spark.createDataFrame([], "row_id long, a double, y double"), "y")
    frames["text"] = (spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "row_id long, c string, y double"), "y")
    rows, widths = profiles.profile_rows(frames, {"d1": 9}, ("row_id",))
    got = {r["dataset"]: r for r in profiles.profiles(rows, widths).collect()}
    for name, (df, target) in frames.items():
        want = profile.profile(df, name, target, widths[name].engineered, ["row_id"]).first()
        if name == "none":
            assert name not in got
            continue
        for c in want.asDict():
            assert got[name][c] == (pytest.approx(want[c], abs=1e-9) if isinstance(want[c], float) else want[c]), (name, c)
    operators = lambda n: profiles.profiles(
        spark.createDataFrame([("d", [1.0], 0, 1.0)], rows.schema), {f"d{i}": profiles.Width(1, 0, 1) for i in range(n)} | {"d": profiles.Width(1, 0, 1)}
    )._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert operators(1) == operators(200)


def test_bootstrap_weights_end_with_the_last_row_that_grows():
    class Counted(np.ndarray):
        passes = 0

        def __ge__(self, other):
            Counted.passes += 1
            return np.asarray(self) >= other

    u = grown._uniform(np.arange(5000), 1, 2)
    for mean in (0.5, 1.0):
        term = total = np.exp(-mean)
        want = np.zeros(len(u))
        for k in range(1, 200):
            want += u >= total
            term *= mean / k
            total += term
        Counted.passes = 0
        assert (grown._poisson(u.view(Counted), mean) == want).all()
        assert Counted.passes < 20


#: nodes of so many rows that no two cuts of them are equally good
SPECS = [
    grown.TreeSpec(0, "tree", depth=20, min_leaf=30, min_split=70), grown.TreeSpec(1, "tree", depth=9, min_leaf=30, subset="log2"),
    grown.TreeSpec(2, "forest", 6, depth=11, min_leaf=30, subset="sqrt"),
    grown.TreeSpec(3, "boosted", 5, depth=4, min_leaf=30, sample=0.7, subset=0.6),
    grown.TreeSpec(4, "boosted", 4, depth=3, min_leaf=30, rate=0.3), grown.TreeSpec(5, "tree", depth=0),
]


@pytest.mark.parametrize("held", [0, 10**6])
def test_trees_from_cells_equal_those_from_rows(spark, monkeypatch, held):
    raw = few_values(spark, 4_000).withColumn("y", F.when(F.col("row_id") % 9 != 0, F.col("y")))
    alone = spark.createDataFrame([(i, i % 2, float(i % 5)) for i in range(20)], "row_id long, fold int, y double")
    packed = pack({"d": (raw, "y"), "none": (alone, "y")})
    features = lambda b, at, h: b.x + (h == 1) * 0.25
    monkeypatch.setattr(grown, "HELD_NODES", held)
    cells = grown.grow(packed, features, SPECS)
    monkeypatch.setattr(grown, "KEPT_CELLS", 0)
    rows = grown.grow(packed, features, SPECS)
    assert len(cells.cells) == 4 and not rows.cells and len(cells.trees) == (0 if held == 0 else 4 * len(SPECS))
    seen = np.array([r["x"] for r in packed.rows.filter("dataset = 'd'").collect()])
    unseen = np.random.default_rng(0).uniform(0, 12, (200, 3))
    for key in [(d, h, s.trial) for d in ("d", "none") for h in (0, 1) for s in SPECS]:
        for x in (seen, unseen) if key[0] == "d" else (np.zeros((3, 0)),):
            x = x + (key[1] == 1) * 0.25 if key[0] == "d" else x
            assert cells.predict(*key, x) == pytest.approx(rows.predict(*key, x), abs=1e-9)
        # those of a forest come as they end, or by number
        ordered = ([sorted(t, key=lambda t: (*t.feature, *t.bin)) if key[2] == 2 else t for t in (g.trees[key] for g in (cells, rows))])
        for a, b in zip(*ordered, strict=True):
            assert [list(a.feature), list(a.bin), list(a.left), list(a.level)] == [b.feature, b.bin, b.left, b.level]
            assert list(a.value) == pytest.approx(b.value, abs=1e-9)


def test_jobs_do_not_grow_with_rounds_and_levels(spark):
    packed = pack({"d": (few_values(spark), "y")})

    def jobs(rounds, depth):
        group = f"rounds-{rounds}-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            specs = [grown.TreeSpec(0, "boosted", rounds, depth=depth, sample=0.8), grown.TreeSpec(1, "forest", rounds, depth=depth)]
            grown.grow(packed, lambda b, at, h: b.x, specs)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # Spark may run a small stage or two as jobs of their own
    assert jobs(40, 9) <= jobs(2, 2) + 3


def test_the_search_runs_every_parameter_as_drawn(spark, sf, monkeypatch):
    from foldloom.catalog import QUERIES
    from foldloom.operators import hyperparams

    run, fitted_trials = grid.fit, []

    def small(packed, states, trials):
        fitted_trials.extend(trials)
        # what is fitted is looked at; how it is grown is tested above
        return run(packed, states, [t for t in trials if t.algorithm in grid.LINEAR])

    monkeypatch.setattr(grid, "fit", small)
    QUERIES["grid_search"](spark, sf)
    spaces = {a: {name: (kind, *rest) for name, kind, *rest in s} for a, s in hyperparams.SEARCH_SPACES.items()}
    assert {t.algorithm for t in fitted_trials} == {"ridge", "lasso", "decision_tree", "random_forest", "gradient_boosting"}
    for t in fitted_trials:
        assert set(t.params) == set(spaces[t.algorithm])
        for name, value in t.params.items():
            kind, *rest = spaces[t.algorithm][name]
            assert value in rest[0] if kind == "choice" else rest[0] <= float(value) <= rest[1]
    # beyond the former limit
    assert max(int(t.params["max_depth"]) for t in fitted_trials if t.algorithm == "decision_tree") > 6
    assert all(int(t.params["n_estimators"]) >= 50 for t in fitted_trials if "n_estimators" in t.params)
