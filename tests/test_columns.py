"""Cleaning, imputation, scaling and encoding on small frames with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import aggregate, clean, dates, encode, impute, scale
from tabloom.operators.joins import lookup_join
from tabloom.operators.quantiles import exact_quantiles, grouped_quantiles


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    rows = [(i, float(rng.normal()), float(rng.exponential(2)), float(rng.integers(0, 5)), "XYZ"[i % 3], i % 2) for i in range(50)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, cat string, target long").cache()


def test_errors_carry_a_reason(mixed):
    for call in (lambda: clean.select_columns(mixed, ["nope"]), lambda: clean.rename_columns(mixed, {"x": "y"}),
                 lambda: clean.drop_constant(mixed), lambda: clean.clip_values(mixed, "a"), lambda: clean.winsorize(mixed, 0.9, 0.1),
                 lambda: scale.power_transform(mixed, "box-cox", ["a"]), lambda: scale.cyclical_encode(mixed, "cat", 3),
                 lambda: encode.target_encode(mixed, ["cat"], "missing"), lambda: aggregate.groupby_aggregate(mixed, [], {"a": "sum"})):
        with pytest.raises(ValueError):
            call()


def test_standard_scale_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, k double")
    out = [r.x for r in scale.standard_scale(df).collect()]
    assert out[2] is None
    assert np.allclose([v for v in out if v is not None], np.array([-1, 0, 1]) / math.sqrt(2 / 3))
    assert {r.k for r in scale.standard_scale(df).collect()} == {0.0}


def test_fitted_statistics_apply_to_other_rows(spark, mixed):
    fitted = scale.fit_minmax_scale(mixed, ["a"])
    low = mixed.agg(F.min("a")).first()[0]
    other = spark.createDataFrame([(low,)], "a double")
    assert fitted.transform(other).first()["a"] == 0.0


def test_power_transform_makes_skewed_data_symmetric(spark, mixed):
    out = scale.power_transform(mixed, "yeo-johnson", ["b"])
    row = out.agg(F.skewness("b").alias("s"), F.avg("b").alias("m"), F.stddev_pop("b").alias("d")).first()
    assert abs(row.s) < 0.3 and abs(row.m) < 1e-9 and abs(row.d - 1) < 1e-9
    lam = scale.fit_power_transform(mixed, "box-cox", ["b"]).state["lambdas"]["b"]
    x = np.array([r.b for r in mixed.collect()])

    def loglik(v):
        y = np.log(x) if abs(v) < 1e-9 else (x ** v - 1) / v
        return -len(x) / 2 * np.log(y.var()) + (v - 1) * np.log(x).sum()

    assert loglik(lam) >= max(loglik(v) for v in np.linspace(-2, 2, 401)) - 1e-4


def test_quantile_transform_is_monotone_and_bounded(mixed):
    out = scale.quantile_transform(mixed.select("id", F.col("a").alias("raw"), "a"), "uniform", 20, ["a"]).orderBy("raw").collect()
    values = [r.a for r in out]
    assert values == sorted(values) and values[0] == 0.0 and values[-1] == 1.0


def test_bins_are_right_closed_with_merged_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4]] + [(None,)], "x double")
    codes = {r.x: r.x_bin for r in scale.bin_numeric(df, "x", 4).collect()}
    assert codes[None] is None and codes[1.0] == 0 and codes[4.0] == max(v for v in codes.values() if v is not None)


def test_exact_quantiles_narrow_to_the_same_answer(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(4000, 7.0), rng.normal(size=5000), rng.integers(0, 3, 3000)]).tolist()
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    found = exact_quantiles(df, ["x", "y"], probs, direct_rows=10, final_values=5)
    assert np.allclose(found["x"], np.quantile(values, probs)) and np.allclose(found["y"], np.quantile([-v for v in values], probs))


def test_grouped_quantiles_with_one_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", float((i * 37) % 1001)) for i in range(3000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    a = {r.g: (r.n, r.q) for r in grouped_quantiles(df, ["g"], "x", [0.25, 0.5]).collect()}
    b = {r.g: (r.n, r.q) for r in grouped_quantiles(df, ["g"], "x", [0.25, 0.5], direct_rows=10).collect()}
    assert a.keys() == b.keys()
    for g in a:
        assert a[g][0] == b[g][0] and (a[g][1] is None) == (b[g][1] is None)
        if a[g][1]:
            assert np.allclose(a[g][1], b[g][1])


def test_a_thousand_quantiles_need_few_expressions(spark):
    """Every rank shares one sketch and one count a column, so many ranks cost no more passes or expressions than few."""
    import time

    rng = np.random.default_rng(2)
    values = np.round(np.concatenate([rng.normal(size=6000), np.full(1500, 0.25)]), 3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    probs = np.linspace(0, 0.999, 1000)
    begun = time.monotonic()
    found = exact_quantiles(df, ["x"], probs.tolist(), direct_rows=10, final_values=5)["x"]
    assert time.monotonic() - begun < 60
    ordered = np.append(np.sort(values), np.nan)
    at = probs * (len(ordered) - 1)
    low, high = ordered[np.floor(at).astype(int)], ordered[np.ceil(at).astype(int)]
    assert np.allclose(found, low + (high - low) * (at - np.floor(at)))


def test_grouped_quantiles_do_not_gather_a_group(spark):
    df = spark.range(2000).selectExpr("CASE WHEN id % 5 = 0 THEN NULL ELSE 'hot' END AS g", "CAST(id * 37 % 1009 AS DOUBLE) AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = grouped_quantiles(df, ["g"], "x", [0.5], direct_rows=10)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert {r.g: (r.n, r.q) for r in out.collect()} == {r.g: (r.n, r.q) for r in grouped_quantiles(df, ["g"], "x", [0.5]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_terms_shuffle_no_pairs_of_documents_and_terms(spark):
    from tabloom.operators.text import top_terms

    rows = [(1, "a a b"), (None, "a"), (3, None), (4, ""), (5, "c b d")]
    once, twice = (spark.createDataFrame(r, "id int, t string") for r in (rows, rows + [(1, "b c"), (None, "a d")]))
    assert [tuple(r) for r in top_terms(once, "t", "id", 3).collect()] == [("a", 3, 2), ("b", 2, 2), ("c", 1, 1)]
    assert [tuple(r) for r in top_terms(twice, "t", "id", 3).collect()] == [("a", 4, 2), ("b", 3, 2), ("c", 2, 2)]
    assert "Aggregate [key" not in top_terms(once, "t", "id", 3)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_a_lookup_and_of_a_forest_grow_in_number_with_the_rows(spark):
    from tabloom.operators import joins, selection

    df = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.col("id") % 90).alias("k"))
    table = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = joins.lookup_join(df, table, ["k"], "n", broadcast_rows=10, rows_per_task=50)
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.top) for r in out.collect()} == {(r.id, r.top) for r in joins.lookup_join(df, table, ["k"], "n").collect()}
    points = df.selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y", "CAST(id < 450 AS INT) AS t").coalesce(1)
    dealt = selection._spread(points, 100)
    assert dealt.count() == 900 and dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] <= 110
    assert selection._spread(points, 1000) is points


def test_imputers_leave_no_gap(spark, mixed):
    gappy = mixed.select("id", F.when(F.col("id") % 5 != 0, F.col("a")).alias("a"), F.when(F.col("id") % 7 != 0, F.col("b")).alias("b"),
                         F.when(F.col("id") % 6 != 0, F.col("cat")).alias("cat"), F.lit(None).cast("double").alias("nothing"))
    out = impute.impute_missing(gappy)
    counts = impute.null_counts(out)
    assert counts["a"] == counts["b"] == counts["cat"] == 0 and counts["nothing"] == 50
    assert impute.null_counts(impute.knn_impute(gappy, 3, ["a", "b"], key="id"))["a"] == 0
    assert impute.null_counts(impute.iterative_impute(gappy, 2, ["a", "b"]))["b"] == 0
    filled = impute.constant_impute(gappy, fill_value=0)
    assert sum(impute.null_counts(filled).values()) == 0
    assert "a_was_missing" in impute.add_missing_indicators(gappy).columns


def test_iterative_impute_recovers_a_linear_relation(spark):
    df = spark.createDataFrame([(float(i), None if i % 10 == 3 else 2.0 * i + 1) for i in range(100)], "x double, y double")
    got = {r.x: r.y for r in impute.iterative_impute(df, 10).collect()}
    assert abs(got[43.0] - 87.0) < 0.1


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, None, 2.0), (3, "a", 3.0), (4, "b", 4.0)], "id int, s string, y double")
    assert {r.id: r.s for r in encode.ordinal_encode(df, ["s"]).collect()} == {1: 2, 2: 0, 3: 1, 4: 2}
    assert {r.id: r.s for r in encode.label_encode(df, "s", ["id"]).collect()} == {1: 0, 2: -1, 3: 1, 4: 0}
    fitted = encode.fit_ordinal_encode(df, ["s"])
    assert fitted.transform(spark.createDataFrame([("zzz",)], "s string")).first()["s"] == -1
    freq = {r.id: r.s_freq for r in encode.frequency_encode(df, ["s"]).collect()}
    assert freq[2] == 0 and abs(freq[1] - 2 / 3) < 1e-12
    enc = encode.fit_target_encode(df, ["s"], "y", 10.0)
    assert abs(enc.transform(spark.createDataFrame([("zzz", 0.0)], "s string, y double")).first()["s"] - 2.5) < 1e-12
    assert len(encode.hash_encode(df, ["s"], 16, expand=True).columns) == 18
    hot = encode.one_hot_encode(df, ["s"]).orderBy("id").collect()
    assert [r["s_a"] for r in hot] == [False, False, True, False]


def test_lookup_join_plans_agree_on_hot_and_null_keys(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else ("hot" if i % 3 else f"k{i}")) for i in range(600)], "id int, k string")
    table = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    small = lookup_join(df, table, ["k"], "n")
    large = lookup_join(df, table, ["k"], "n", broadcast_rows=1)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-29",), ("2021-01-04",)], "ds string")
    rows = dates.encode_dates(df).collect()
    assert [(r.ds_year, r.ds_day, r.ds_dayofweek) for r in rows] == [(2020, 29, 5), (2021, 4, 0)]
    odd = spark.createDataFrame([("2020-13-40",), ("12x",), ("",), ("01/02/2020",)], "d string")
    assert [r.d is None for r in dates.datetime_parse(odd, ["d"]).collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        dates.datetime_parse(spark.createDataFrame([("abc",)], "d string"), ["d"])


def test_empty_and_all_null_frames(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert aggregate.profile(empty).first()["row_count"] == 0
    assert clean.filter_outliers(empty).count() == 0
    assert exact_quantiles(empty, ["x"], [0.5]) == {"x": [None]}
    assert impute.impute_missing(empty).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "x double, s string")
    assert clean.constant_columns(nulls) == ["x", "s"]
    assert aggregate.outlier_summary(nulls.select("x", F.lit(1.0).alias("one"))).count() == 1
