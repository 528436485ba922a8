"""Imputation by neighbours and by rounds of regressions; sketches, lagged sums, steps, profiles."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.operators import aggregate, describe, impute, lagged, masked, ordered, series, sketch, text


def gaps(seed, rows, columns, share=0.3, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, columns)) * spread
    x[rng.random(x.shape) < share] = np.nan
    return x


def frame(spark, x):
    names = [f"v{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(k, *[None if math.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)], ", ".join(["id long", *[f"{n} double" for n in names]])), names


def brute_donors(x, k):
    out = {}
    for i in range(len(x)):
        for f in np.flatnonzero(np.isnan(x[i])):
            near = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, f]) and both.any():
                    near.append((((x[i, both] - x[j, both]) ** 2).sum() * x.shape[1] / both.sum(), j))
            near = sorted(near)[:k]
            if near:
                out[i, int(f)] = np.mean([x[j, f] for _, j in near])
    return out


@pytest.mark.parametrize("columns, share, block", [(3, 0.4, 2_000), (6, 0.2, 40), (2, 0.6, 25)])
def test_donor_means_match_brute_force(spark, columns, share, block):
    x = gaps(columns, 400, columns, share)
    x[:60, 0] = np.round(x[:60, 0])  # ties
    df, names = frame(spark, x)
    got = {(r._id, f): r[f"_fill_{f}"] for r in masked.donor_means(df, "id", names, 4, block).collect() for f in range(columns) if r[f"_fill_{f}"] is not None}
    want = brute_donors(x, 4)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cells_bound_every_donor():
    x = gaps(1, 300, 4)
    cell = np.arange(300) % 7
    parts = [x[cell == k] for k in range(7)]
    with np.errstate(all="ignore"):
        cells = masked.Cells(np.array([len(p) for p in parts]), np.array([(~np.isnan(p)).sum(axis=0) for p in parts]),
                             np.array([np.nanmin(p, axis=0) for p in parts]), np.array([np.nanmax(p, axis=0) for p in parts]))
    least, most, _ = cells.bounds(x)
    for i in range(0, 300, 7):
        for k, part in enumerate(parts):
            both = ~np.isnan(x[i]) & ~np.isnan(part)
            with np.errstate(all="ignore"):
                d = np.where(both, x[i] - part, 0) ** 2
                d = d.sum(axis=1) * 4 / both.sum(axis=1)
            d = d[both.any(axis=1)]
            assert not len(d) or least[i, k] <= d.min() + 1e-9 and d.max() <= most[i, k] + 1e-9


def test_neighbours_of_patterns_are_one_join(spark):
    df, names = frame(spark, gaps(2, 200, 3))
    plan = masked.masked_neighbours(df, "id", names, 3)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FlatMapCoGroupsInPandas") == 1 and "CartesianProduct" not in plan


def test_far_donors_are_passed_over(spark):
    x = np.concatenate([gaps(3, 300, 3, 0.2, 0.1) + 100 * k for k in range(8)])
    df, names = frame(spark, x)
    means = [r[f"_fill_{f}"] for r in masked.donor_means(df, "id", names, 3).collect() for f in range(3) if r[f"_fill_{f}"] is not None]
    assert len(means) > 300 and all(abs(m - 100 * round(m / 100)) < 1 for m in means)


def test_rows_meet_few_cells_of_a_table_and_all_that_matter():
    """However many points there are, a row meets a few cells, and its k nearest points lie in these."""
    rng = np.random.default_rng(9)
    met = []
    for depth in (7, 10):
        points = rng.normal(size=(64 << depth, 3)) * [1.0, 5.0, 0.0]
        table = masked.Halves(points[::8], np.array([0, 1]), depth, 4)
        leaf = table.leaf(points)
        some = np.unique(leaf)
        ends = lambda g: np.array([g(points[leaf == k], axis=0) for k in some])
        table.bounded(some, np.bincount(leaf)[some], ends(np.min), ends(np.max))
        asking = rng.normal(size=(150, 3)) * [1.0, 5.0, 0.0]
        row, cell = table.wanted(asking, 5)
        pairs = set(zip(row.tolist(), cell.tolist()))
        for i, x in enumerate(asking):
            nearest = np.argsort(((points - x) ** 2).sum(axis=1))[:5]
            assert {(i, int(leaf[j]) >> 4) for j in nearest} <= pairs
        met.append(len(row) / len(asking))
    assert max(met) < 4


def test_few_patterns_with_many_ties_match_brute_force(spark):
    """More equal points than neighbours, cells smaller than a pattern, a feature known nowhere beside its gap."""
    rng = np.random.default_rng(10)
    x = np.column_stack([rng.integers(0, 6, 700), rng.integers(0, 4, 700), rng.normal(size=700)]).astype(float)
    x[::4, 2], x[1::9, 0], x[2::300] = np.nan, np.nan, np.nan
    df, names = frame(spark, x)
    got = {(r._id, f): r[f"_fill_{f}"] for r in masked.donor_means(df, "id", names, 4, 30).collect() for f in range(3) if r[f"_fill_{f}"] is not None}
    want = brute_donors(x, 4)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def mice(x, order, rounds, ridge=1e-3):
    mean, spread = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = (x - mean) / spread
    known, now = ~np.isnan(z), np.nan_to_num(z)
    for _ in range(rounds):
        for t in order:
            inputs = np.column_stack([np.delete(now, t, axis=1), np.ones(len(x))])
            rows = known[:, t]
            penalty = ridge * np.eye(inputs.shape[1])
            penalty[-1, -1] = 0
            w = np.linalg.solve(inputs[rows].T @ inputs[rows] + penalty, inputs[rows].T @ z[rows, t])
            now[~rows, t] = inputs[~rows] @ w
    return now * spread + mean


@pytest.mark.parametrize("most_masks", [4_096, 1])
def test_rounds_of_regressions_match_plain_ones(spark, monkeypatch, most_masks):
    monkeypatch.setattr(impute, "MAX_MASKS", most_masks)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[:, 1] += 2 * x[:, 0]
    x[:, 3] -= x[:, 1]
    for f, share in ((0, 0.1), (1, 0.2), (3, 0.35)):
        x[rng.random(300) < share, f] = np.nan
    df, names = frame(spark, x)
    got = np.array([r[1:] for r in impute.iterative_impute(df, 4, names, tol=0.0).orderBy("id").collect()], float)
    assert np.allclose(got, mice(x, [0, 1, 3], 4), atol=1e-8)


def test_rounds_end_when_settled_and_fill_unseen_patterns(spark):
    x = gaps(4, 200, 3, 0.1)
    df, names = frame(spark, x)
    found = impute.fit_iterative_impute(df, 50, names, tol=1e-4)
    assert 1 < found.state["rounds"] < 50
    blank = found.transform(spark.createDataFrame([(1, None, None, None)], df.schema)).first()
    assert all(v is not None for v in blank[1:])


def test_axes_match_the_decomposition(spark):
    texts = [" ".join(f"w{(3 * k + j * j) % 29}" for j in range(2 + k % 9)) for k in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(900, "unseen"), (901, None), (902, "")], "id long, t string").where("id < 900 or id > 900")
    ready = text.fit_tfidf_vectorize(df, "t", "id", 1000, (1, 1))
    axes, energies, parts = sketch.leading_axes(ready.transform(df), "t_tfidf", len(ready.state["vocabulary"]), 4)
    dense = np.zeros((152, len(ready.state["vocabulary"])))
    for at, r in enumerate(parts.collect()):
        dense[at, list(r["indices"])] = list(r["values"])
    _, s, v = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(energies, s[:4] ** 2, rtol=1e-4)
    assert abs(np.linalg.norm(dense @ axes) ** 2 - (s[:4] ** 2).sum()) < 1e-3
    out = text.lsa_text(df, "t", "id", 4)
    assert out.where("id > 900").select("lsa_1").distinct().collect()[0][0] == 0.0 and out.count() == 152


@pytest.mark.parametrize("features, most", [(1_000, 40), (50_000, 90)])
def test_a_pass_holds_a_slice_of_its_rows(features, most):
    """A batch of long rows needs a few MB beside the features' own matrix, dense or not, and gives the plain product."""
    rng = np.random.default_rng(0)
    axes = rng.normal(size=(features, 30))
    held = [np.sort(rng.choice(features, 150, replace=False)) for _ in range(6_000)] + [np.zeros(0, int)]
    indices, values = pa.array([h.astype("int32") for h in held]), pa.array([rng.random(len(h)) for h in held])
    batch = pa.RecordBatch.from_arrays([indices, values], ["indices", "values"])
    tracemalloc.start()
    out = next(sketch._there_and_back(axes)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most << 20
    back = np.zeros(axes.shape)
    for h, v in zip(held[:500], values.to_pylist()):
        back[h] += np.outer(v, np.asarray(v) @ axes[h])
    few = next(sketch._there_and_back(axes)(iter([batch.slice(0, 500)])))
    assert np.allclose(np.column_stack([few.column(1 + i).to_numpy() for i in range(30)]), back[few.column(0).to_numpy()])
    assert out.num_rows == len(np.unique(np.concatenate(held)))
    assert np.allclose(sketch.times(indices.slice(5_990), values.slice(5_990), axes)[9:], [np.asarray(values[5_999].as_py()) @ axes[held[5_999]], np.zeros(30)])


@pytest.mark.parametrize("max_rows", [5_000_000, 60])
def test_lagged_sums_give_every_normal_equation(spark, max_rows):
    rng = np.random.default_rng(6)
    xs = {"a": np.cumsum(rng.normal(size=250)) + 1000, "b": rng.normal(size=40), "c": rng.normal(size=5)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in xs.items() for i, v in enumerate(x)], "g string, t long, x double")
    for row in lagged.lag_sums(df, ["g"], ["t"], "x", 8, max_rows).collect():
        found, x = lagged.Lags.of(row), xs[row.g] - xs[row.g].mean()
        for width in range(1, min(9, len(x)) + 1):
            windows = np.column_stack([x[width - 1 - k:len(x) - k] for k in range(width)] + [np.ones(len(x) - width + 1)])
            assert np.allclose(found.gram(width), windows.T @ windows, atol=1e-6)


def plain_adf(x, order):
    dx = np.diff(x)
    y = dx[order:]
    z = np.column_stack([x[order:-1]] + [dx[order - k:len(dx) - k] for k in range(1, order + 1)] + [np.ones(len(y))])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    rss = ((y - z @ beta) ** 2).sum()
    return beta[0] / math.sqrt(rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])


def plain_kpss(x):
    n, e = len(x), x - x.mean()
    gamma = lambda k: e[k:] @ e[:n - k] / n
    power = int(n ** (2 / 9))
    s0 = gamma(0) + 2 * sum(gamma(k) for k in range(1, power + 1))
    s1 = 2 * sum(k * gamma(k) for k in range(1, power + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    longrun = gamma(0) + 2 * sum((1 - k / (lags + 1)) * gamma(k) for k in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n ** 2 / longrun


@pytest.mark.parametrize("max_rows", [5_000_000, 70])
def test_unit_root_tests_match_plain_ones(spark, max_rows):
    rng = np.random.default_rng(8)
    xs = {"walk": np.cumsum(rng.normal(size=400)), "noise": rng.normal(size=300), "short": rng.normal(size=9), "tiny": rng.normal(size=4), "flat": np.full(30, 2.0)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in xs.items() for i, v in enumerate(x)], "g string, t long, x double").repartition(5)
    for order in (0, 1, 4):
        got = {r.g: r.adf_stat for r in series.adf_test(df, "x", ["t"], ["g"], lags=order, max_rows=max_rows).collect()}
        assert all(abs(got[g] - plain_adf(xs[g], order)) < 1e-6 for g in ("walk", "noise")) and got["tiny"] is None and got["flat"] is None
    got = {r.g: r for r in series.stationarity_test(df, "x", ["t"], ["g"], max_rows).collect()}
    assert all(abs(got[g].kpss_stat - plain_kpss(xs[g])) < 1e-6 for g in ("walk", "noise", "short"))
    assert got["noise"].verdict == "Stationary" and got["walk"].verdict == "Non-stationary" and got["flat"].verdict == "Undefined"
    assert got["tiny"].verdict == "Need at least 8 observations." and got["tiny"].kpss_stat is None


def test_forecasts_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(9)
    x = [0.0, 0.0]
    for _ in range(300):
        x.append(0.6 * x[-1] - 0.3 * x[-2] + float(rng.normal()) + 1)
    df = spark.createDataFrame(list(enumerate(x)), "t long, v double")
    whole, cut = (series.forecast_ar(df, "v", ["t"], horizon=4, max_rows=m).orderBy("step").collect() for m in (5_000_000, 50))
    assert all(abs(a.forecast - b.forecast) < 1e-6 and a.p == b.p and a.d == b.d for a, b in zip(whole, cut)) and whole[0].p >= 2


def test_steps_are_joined_over_buckets(spark):
    rows = [(i, None if i % 5 == 0 else i * 2, (i * 37) % 101, "a" if i < 50 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "t long, up long, jumps long, word string").repartition(7)
    got = ordered.steps(df, ["t"], ["up", "jumps", "word"], rows_per_bucket=15)
    jumps = [r[2] for r in rows]
    assert got["up"] == (159, 159, 0) and got["word"] == (199, 1, 0)
    assert got["jumps"] == (199, sum(b > a for a, b in zip(jumps, jumps[1:])), sum(b < a for a, b in zip(jumps, jumps[1:])))
    assert ordered.steps(df.where("t < 0"), ["t"], ["up"]) == {"up": (0, 0, 0)}


def test_identifiers_that_give_the_row_away(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(p), f"{i:08x}-0000-4000-8000-{i:012x}", float(i + 30 * rng.normal())) for i, p in enumerate(rng.permutation(500))]
    df = spark.createDataFrame(rows, "row_no long, shuffled long, ref string, amount double")
    found = {(r["column"], r["rule"]): r["evidence"] for r in describe.leakage_scan(df, "amount", ["row_no"]).collect()}
    assert found["ref", "uuid_identifier"] == "500 of 500 like a UUID" and found["row_no", "monotone_identifier"] == "rises in 499 of 499 steps"
    assert ("row_no", "identifier_trend") in found and ("shuffled", "identifier_trend") not in found and ("shuffled", "monotone_identifier") not in found
    assert not any(rule == "monotone_identifier" for _, rule in {(r["column"], r["rule"]) for r in describe.leakage_scan(df, "amount").collect()})


def test_profile_of_awkward_columns(spark):
    df = spark.createDataFrame([(1, 0.0, None, None, [1], True), (1, -0.0, None, "", [1], None), (2, float("nan"), None, "x", None, True), (None, None, None, "x", [], False)],
                               "a int, b double, c string, d string, e array<int>, f boolean")
    got = {r.name: r for r in aggregate.profile_columns(df).collect()}
    assert {n: (r.unique_count, r.missing_count) for n, r in got.items()} == {"a": (2, 1), "b": (2, 1), "c": (0, 4), "d": (2, 1), "e": (2, 1), "f": (2, 1)}
    assert sorted(got["d"].sample_values) == ["", "x"] and got["c"].sample_values == [] and got["f"].role == "flag"
    none = aggregate.profile_columns(df.where("1 = 0")).collect()
    assert all(r.unique_count == 0 and r.missing_pct == 0.0 for r in none)
    many = aggregate.profile_columns(spark.range(2_000), exact=False).first()
    assert abs(many.unique_count - 2_000) < 200 and len(many.sample_values) == 5
