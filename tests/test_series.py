"""Panels, splits and time series."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import ordered, panel, series, splits


@pytest.fixture(scope="module")
def monthly(spark):
    rng = np.random.default_rng(7)
    rows = [(datetime.date(2020 + i // 12, i % 12 + 1, 15), math.sin(2 * math.pi * i / 12) + 0.1 * float(rng.normal()), g)
            for i in range(60) for g in ("g", "h")]
    return spark.createDataFrame(rows, "date date, value double, group string").cache()


def test_dense_panel_aligns_and_keeps_duplicates(spark):
    d = datetime.date
    df = spark.createDataFrame([("a", d(2020, 1, 3), 1.0), ("a", d(2020, 1, 31), 2.0), ("a", d(2020, 3, 1), None), ("b", d(2020, 2, 29), 5.0), (None, d(2020, 2, 1), 1.0)],
                               "g string, t date, v double")
    out = sorted(map(tuple, panel.dense_panel(df, "t", ["g"]).collect()), key=str)
    assert len(out) == 10 and ("a", d(2020, 1, 31), 1.0) in out and ("a", d(2020, 3, 31), 0.0) in out and (None, d(2020, 3, 31), 0.0) in out


def test_chunked_series_match_plain_windows(spark, monthly):
    for build in (lambda m: panel.create_lag_features(monthly, "value", [1, 5], ["group"], "date", max_rows=m),
                  lambda m: panel.create_rolling_features(monthly, "value", [4], ["group"], "date", "std", max_rows=m),
                  lambda m: panel.create_lead_target(monthly, "value", [2], ["group"], "date", max_rows=m)):
        assert sorted(map(tuple, build(10 ** 6).collect()), key=str) == sorted(map(tuple, build(7).collect()), key=str)


def test_null_group_keys_get_no_lag(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 3.0), ("a", 2, 4.0)], "g string, t int, v double")
    got = {(r.g, r.t): r.v_lag_1 for r in panel.create_lag_features(df, "v", [1], ["g"], "t").collect()}
    assert got[("a", 2)] == 3.0 and got[(None, 2)] is None


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("hot"))
    for parts in (1, 4, 17):
        got = ordered.with_position(df.repartition(parts), ["hot", "id"], rows_per_bucket=300).orderBy("hot", "id").select("_pos").collect()
        assert [r[0] for r in got] == list(range(5000))


def test_chronological_split_with_ties_and_nulls(spark):
    rows = [(i, None if i % 10 == 0 else i // 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t int")
    train, test = splits.chronological_split(df, "t", 0.25, ["id"])
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert {r.id for r in train.collect()} == {r[0] for r in order[:150]} and test.count() == 50
    with pytest.raises(ValueError):
        splits.chronological_split(df.limit(2), "t", 0.5, ["id"])


def test_rank_selection_narrows(spark):
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    want = sorted((r.h, r.id) for r in df.collect())[:1234]
    cut = ordered.rows_up_to_rank(df, ["h", "id"], 1234, final_rows=20)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(ordered.sort_keys(df, ["h", "id"]))])
    assert sorted((r.h, r.id) for r in df.where(key < cut).collect()) == want


def test_random_split_is_repeatable_and_stratified(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = splits.random_split(df, ["id"], 0.2, 1, "y")[1]
    b = splits.random_split(df.repartition(9), ["id"], 0.2, 1, "y")[1]
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert {r.y: r["count"] for r in a.groupBy("y").count().collect()} == {0: 180, 1: 20}


def test_seasonal_decomposition_finds_the_cycle(monthly):
    out = series.seasonal_decompose(monthly, "value", ["date"], ["group"], 12)
    strength = {r.group: r.seasonal_strength for r in series.seasonal_strength(out, ["group"]).collect()}
    assert all(v > 0.9 for v in strength.values())
    worst = out.agg(F.max(F.abs(F.col("observed") - F.col("trend") - F.col("seasonal") - F.col("resid")))).first()[0]
    assert worst < 1e-9
    chunked = series.seasonal_decompose(monthly, "value", ["date"], ["group"], 12, max_rows=25)
    key = lambda r: (r.group, r.position)
    a, b = sorted(out.collect(), key=key), sorted(chunked.collect(), key=key)
    assert np.allclose([r.trend for r in a], [r.trend for r in b])


def test_acf_pacf_of_an_autoregression(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(999):
        x.append(0.7 * x[-1] + float(rng.normal()))
    df = spark.createDataFrame(list(enumerate(x)), "t long, v double")
    got = {r.lag: r for r in series.acf_pacf(df, "v", ["t"], nlags=5).collect()}
    centred = np.array(x) - np.mean(x)
    for k in range(6):
        assert abs(got[k].acf - centred[k:] @ centred[:len(x) - k] / (centred @ centred)) < 1e-9
    assert abs(got[1].pacf - 0.7) < 0.08 and abs(got[3].pacf) < 0.1


def test_stationarity_verdicts_and_forecast(spark):
    rng = np.random.default_rng(5)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    rows = [("noise", i, float(v)) for i, v in enumerate(noise)] + [("walk", i, float(v)) for i, v in enumerate(walk)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    got = {r.s: r for r in series.stationarity_test(df, "v", ["t"], ["s"]).collect()}
    assert got["noise"].verdict == "Stationary" and not got["walk"].adf_is_stationary
    line = spark.createDataFrame([(i, 2.0 * i + 5 + (i % 2) * 0.01) for i in range(60)], "t long, v double")
    steps = series.forecast_ar(line, "v", ["t"], horizon=3, max_order=2).orderBy("step").collect()
    assert abs(steps[2].forecast - (2.0 * 62 + 5)) < 0.5 and steps[0].lower <= steps[0].forecast <= steps[0].upper
