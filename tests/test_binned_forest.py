"""Forest importances from sums per combination of bins, against the ML library's forest."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import binned_forest, selection


@pytest.fixture(scope="module")
def measured(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=2000), rng.integers(0, 5, 2000), rng.normal(size=2000)
    y = 3 * a + b + 0.2 * rng.normal(size=2000)
    rows = [(i, float(a[i]), int(b[i]), float(c[i]), float(y[i]), "high" if y[i] > 3 else "low" if y[i] < 0 else "middle") for i in range(2000)]
    return spark.createDataFrame(rows, "id long, a double, b int, c double, y double, k string").cache()


@pytest.mark.parametrize("target, make", [("y", RandomForestRegressor), ("k", RandomForestClassifier)])
def test_importances_are_those_of_the_library_forest(measured, target, make):
    names = ["a", "b", "c"]
    found = selection.importances(measured.select("id", *names, target), target, ["id"], trees=40, depth=6)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(measured)
    if target == "k":
        label = F.when(F.col("k") == "high", 0.0).when(F.col("k") == "low", 1.0).otherwise(2.0)
    else:
        label = F.col("y")
    known = make(numTrees=40, maxDepth=6, seed=42, featuresCol="features", labelCol="label").fit(ready.withColumn("label", label))
    assert np.allclose([found[n] for n in names], known.featureImportances.toArray(), atol=0.05)


def test_a_tree_grows_as_the_library_grows_it():
    """One feature parts two values, the other tells nothing more: one split, and its leaves are not split again."""
    cells = np.zeros((3, 2, 3))
    for i in range(2):
        for j in range(3):
            cells[:, i, j] = 10.0, 10.0 * (5 if i else 1), 10.0 * (25 if i else 1)
    found = [binned_forest._Tree(cells, None, 5, np.random.default_rng(s)).gains for s in range(6)]
    assert any(np.allclose(g, [4.0 * 60, 0.0]) for g in found)
    assert all(g[1] < 1e-9 for g in found)
    assert not binned_forest._Tree(np.zeros((3, 2, 3)), None, 5, np.random.default_rng(0)).gains.any()


def test_thresholds_and_weights():
    assert binned_forest.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5]
    cuts = binned_forest.thresholds(np.arange(1000.0), 10)
    assert len(cuts) == 9 and np.all(np.abs(np.diff(cuts) - 100) <= 1)
    weights = binned_forest._Poisson().draw(np.random.default_rng(1), 200_000)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02 and abs((weights == 0).mean() - np.exp(-1)) < 0.01


def test_few_features_never_meet_rows_times_trees_times_levels(measured, monkeypatch):
    """With few combinations of bins the rows are read for the sums alone; no forest of the library passes over them once a level."""
    def refused(*args):
        raise AssertionError("a pass over all rows for every level of every tree")

    df = measured.select("id", "a", "b", "c", "y")
    monkeypatch.setattr(selection, "_forest", refused)
    assert selection.rfe_select(df, "y", 1, key=["id"], trees=10).columns == ["id", "a", "y"]
    assert "a" in selection.select_from_model(df, "y", "mean", ["id"], trees=10).columns


def test_many_features_take_the_library_forest(measured):
    wide = measured.select("id", "y", "a", "c", *[(F.col("a") * F.lit(k) + F.sin(F.col("c") * k)).alias(f"f{k}") for k in range(1, 5)])
    assert len(selection.importances(wide, "y", ["id"], trees=3, depth=3)) == 6
    assert selection.rfe_select(wide, "y", 5, key=["id"], trees=3, depth=3).columns[:2] == ["id", "y"]


def test_a_label_without_a_number_is_refused(measured):
    with pytest.raises(Exception, match="MUST NOT"):
        selection.select_from_model(measured.select("id", "a", "c", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("y")).alias("y")), "y", key=["id"], trees=3)
