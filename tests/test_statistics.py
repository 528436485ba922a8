"""Tests, drift and exploratory statistics with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import pvalues
from tabloom.operators import describe, drift, hypothesis


def frame(spark, x, y=None):
    rows = [(float(v),) for v in x] if y is None else list(zip(map(float, x), y))
    return spark.createDataFrame(rows, "x double" if y is None else "x double, g string")


def test_tail_probabilities_match_tables():
    assert abs(pvalues.chi2_tail(3.841459, 1) - 0.05) < 1e-6
    assert abs(pvalues.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(pvalues.f_tail(4.964603, 1, 10) - 0.05) < 1e-6
    assert pvalues.ks_tail(0.0, 10, 10) == 1.0 and pvalues.ks_tail(1.0, 500, 500) < 1e-10


def test_shapiro_wilk_known_value():
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = describe.shapiro_wilk(np.array(x, dtype=float))
    assert abs(w - 0.7888) < 5e-4 and abs(p - 0.0067) < 1e-3


def test_normality_and_k2(spark):
    rng = np.random.default_rng(0)
    normal = describe.normality_test(frame(spark, rng.normal(size=2000)), "x").first()
    skewed = describe.normality_test(frame(spark, rng.exponential(size=2000)), "x").first()
    assert normal.is_normal_dagostino and normal.is_normal_shapiro and not skewed.is_normal_dagostino and not skewed.is_normal_shapiro


def test_mannwhitney_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 300)
    g = ["a" if i % 3 == 0 else "b" for i in range(300)]
    a, b = [v for v, k in zip(x, g) if k == "a"], [v for v, k in zip(x, g) if k == "b"]
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    assert hypothesis.mannwhitney(frame(spark, x, g), "x", "g", rows_per_bucket=3).first().statistic == u


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=400), np.concatenate([rng.normal(0.5, 1, 300), np.full(200, 0.3)])
    grid = np.unique(np.concatenate([a, b]))
    want = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    got = drift.ks_statistics(frame(spark, a), frame(spark, b), ["x"], rows_per_bucket=50)["x"][0]
    assert abs(got - want) < 1e-6


def test_psi_and_js_formulas(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=500), rng.normal(0.4, 1.2, 700)
    pooled = np.concatenate([a, b])
    edges = np.unique(np.percentile(pooled, np.linspace(0, 100, 11)))
    p = (np.histogram(a, edges)[0] + 1e-6) / (len(a) + 1e-5)
    q = (np.histogram(b, edges)[0] + 1e-6) / (len(b) + 1e-5)
    assert abs(drift.psi(frame(spark, a), frame(spark, b), "x") - np.sum((q - p) * np.log(q / p))) < 2e-6
    same = frame(spark, a)
    assert drift.psi(same, same, "x") == 0.0 and drift.js_divergence(same, same, "x") == 0.0
    flat = frame(spark, [3.0] * 10)
    assert drift.psi(flat, flat, "x") == 0.0 and drift.js_divergence(flat, flat, "x") == 0.0


def test_drift_report_with_nulls_and_label(spark):
    ref = spark.createDataFrame([(float(i), "a" if i % 2 else "b", i % 2, None) for i in range(100)], "x double, s string, y int, n double")
    cur = spark.createDataFrame([(float(i + 80), "a" if i % 5 else None, 1, None) for i in range(100)], "x double, s string, y int, n double")
    features, summary = drift.run_drift_report(ref, cur, "y")
    got = {r.column: r for r in features.collect()}
    assert set(got) == {"x", "s"} and got["x"].severity == "HIGH"
    row = summary.first()
    assert row.label_column == "y" and row.label_severity == "HIGH" and row.total_columns == 2
    assert {r.column: r.error for r in drift.compare_distributions(ref, cur).collect()}["n"] == "insufficient data"


def test_vif_and_mutual_information(spark):
    rng = np.random.default_rng(8)
    a, noise, c = (rng.normal(size=500) for _ in range(3))
    rows = [(float(p), float(2 * p + 0.01 * q), float(r), int(p > 0)) for p, q, r in zip(a, noise, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    got = {r.column: r.vif for r in describe.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] > 100 and got["b"] > 100 and got["c"] < 1.1
    exact = {r.column: r.vif for r in describe.vif(df.withColumn("d", F.col("a") * 3), ["a", "c", "d"]).collect()}
    assert exact["a"] == exact["d"] == float("inf") and exact["c"] < 1.1
    mi = [r.feature for r in describe.mutual_information(df, "y").collect()]
    assert mi[-1] == "c"
    with pytest.raises(ValueError):
        describe.vif(df.select("a"))


def test_shape_of_chart_data(spark):
    rng = np.random.default_rng(9)
    df = frame(spark, rng.normal(size=1000))
    q = describe.qq_points(df, "x").collect()
    assert abs(q[0].slope - 1) < 0.1 and abs(q[0].intercept) < 0.1
    d = describe.violin_density(df, "x").orderBy("x").collect()
    assert abs(sum(r.density for r in d) * (d[1].x - d[0].x) - 1) < 0.05
    assert describe.histogram(df, "x", 7).agg(F.sum("count")).first()[0] == 1000


@pytest.mark.parametrize("classes", [True, False])
def test_joint_counts_give_the_plain_information(spark, monkeypatch, classes):
    """One set of passes finds all edges; NULLs take the median, a constant tells nothing."""
    rng = np.random.default_rng(7)
    rows = [(float(rng.normal()), None if i % 7 == 0 else float(i % 13), 1.0, f"k{i % 3}" if classes else float(rng.normal()) + i % 13) for i in range(600)]
    df = spark.createDataFrame(rows, f"a double, b double, c double, y {'string' if classes else 'double'}")
    calls, real = [], describe.exact_quantiles
    monkeypatch.setattr(describe, "exact_quantiles", lambda *args: calls.append(1) or real(*args))
    monkeypatch.setattr(describe, "JOINT_CELLS", 50)
    got = {r.feature: r.mutual_information for r in describe.mutual_information(df, "y").collect()}

    def binned(v):
        edges = sorted(set(real(spark.createDataFrame([(x,) for x in v], "v double"), ["v"], [i / 10 for i in range(11)])["v"]))
        return [sum(x > e for e in edges[1:-1]) for x in v]

    y = [r[3] for r in rows] if classes else binned([r[3] for r in rows])
    for i, n in enumerate("abc"):
        known = sorted(r[i] for r in rows if r[i] is not None)
        middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if n == "b" else 0.0
        if n == "b":
            edges = sorted(set(real(df, ["b"], [k / 10 for k in range(11)])["b"]))
            x = [sum((middle if r[i] is None else r[i]) > e for e in edges[1:-1]) for r in rows]
        else:
            x = [0] * 600 if n == "c" else binned([r[i] for r in rows])
        joint = {k: sum(p == k for p in zip(x, y)) for k in set(zip(x, y))}
        want = sum(k / 600 * math.log(k * 600 / (x.count(p) * y.count(q))) for (p, q), k in joint.items())
        assert abs(got[n] - max(want, 0.0)) < 1e-9
    assert len(calls) == 1 and set(got) == {"a", "b", "c"}


@pytest.mark.parametrize("edges", [[-1.0, 0.0, 0.5, 2.0], [-1.0, 0.0, float("nan")], [1.0]])
def test_bins_of_tasks_are_those_of_the_expression(spark, edges):
    from tabloom.operators.scale import right_closed_code

    values = [-2.0, -1.0, -0.0, 0.3, 0.5, 2.0, 3.0, float("nan"), float("inf")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    want = [r.code for r in df.select("i", right_closed_code(F.col("v"), edges).alias("code")).orderBy("i").collect()]
    assert [None if k < 0 else k for k in describe._bins(np.array(values), edges).tolist()] == want
