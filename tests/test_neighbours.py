"""Neighbour join against brute force, balancing and isolation forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import isolation, resample
from tabloom.operators.neighbours import knn_join, lsh_knn_join


def brute(points, k):
    out = set()
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(len(points)) if j != i)[:k]
        out |= {(i, j) for _, j in order}
    return out


def test_knn_is_exact_with_a_hot_point(spark):
    """A third of the rows share one point: ties go to the smaller id and blocks stay small."""
    rng = np.random.default_rng(0)
    points = np.concatenate([np.tile([1.0, 1.0], (100, 1)), rng.normal(size=(200, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    got = {(r.left_id, r.right_id) for r in knn_join(df, df, 4, ["x", "y"], "id", "id", exclude_same=True, block=20).collect()}
    assert got == brute(points, 4)


def test_knn_with_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, x double")
    assert knn_join(df, df, 5, ["x"], "id", "id", exclude_same=True).count() == 2
    assert knn_join(df, df.limit(0), 5, ["x"], "id", "id").count() == 0


def test_knn_within_groups_of_any_number_and_size(spark):
    """Thousands of small groups, a few large ones with cells of their own, NULL as a group, and ids that do not meet."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 97 == 0 else f"g{i % 1500}", float(rng.normal()), float(rng.normal())) for i in range(4000)]
    rows += [(10_000 + i, "large", float(rng.normal()), float(rng.normal())) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = {(r.left_id, r.right_id) for r in knn_join(df, df, 2, ["x", "y"], "id", "id", within="g", exclude_same=True, block=100).collect()}
    want, groups = set(), {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    for members in groups.values():
        points = np.array([m[2:] for m in members])
        want |= {(members[i][0], members[j][0]) for i, j in brute(points, 2)}
    assert got == want and len(groups) > 1000


def test_few_pairs_are_compared():
    from tabloom.operators.neighbours import _Cells
    import pandas as pd

    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 3))[rng.integers(0, 60, 6000)] * 10 + rng.normal(size=(6000, 3)) * 0.1
    pivots = points[rng.choice(6000, 300, replace=False)]
    gap = np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(axis=2))
    home, reach = gap.argmin(axis=1), gap.min(axis=1)
    table = pd.DataFrame([{"cell": k, "lo": reach[home == k].min(), "hi": reach[home == k].max(), "near": np.sort(reach[home == k])[:5]} for k in np.unique(home)])
    sizes = np.bincount(home, minlength=300)
    met = sum(int(sizes[cell].sum()) for _, cell in _Cells(pivots, table, 5).wanted(points[:500]))
    assert met < 0.1 * 500 * 6000


def test_lsh_recall(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "id long, x double, y double")
    exact = {(r.left_id, r.right_id) for r in knn_join(df, df, 4, ["x", "y"], "id", "id").collect()}
    near = {(r.left_id, r.right_id) for r in lsh_knn_join(df, df, 4, ["x", "y"], "id", "id", 3.0, 1.0).collect()}
    assert len(exact & near) / len(exact) > 0.8


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal() + (3 if i >= 100 else 0)), float(rng.normal()), int(i >= 100)) for i in range(115)]
    return spark.createDataFrame(rows, "id long, a double, b double, y long").cache()


def sizes(df):
    return {r.y: r["count"] for r in df.groupBy("y").count().collect()}


def test_balanced_classes(skewed):
    assert sizes(resample.random_oversample(skewed, "y", ["id"])) == {0: 100, 1: 100}
    assert sizes(resample.random_undersample(skewed, "y", ["id"])) == {0: 15, 1: 15}
    out = resample.smote(skewed, "y", ["id"])
    assert sizes(out) == {0: 100, 1: 100}
    made = out.where("id is null").agg(F.min("a"), F.max("a")).first()
    real = skewed.where("y = 1").agg(F.min("a"), F.max("a")).first()
    assert real[0] <= made[0] and made[1] <= real[1]
    assert sizes(resample.borderline_smote(skewed, "y", ["id"]))[1] in (15, 100)
    assert sizes(resample.smote_enn(skewed, "y", ["id"]))[0] <= 100
    assert sizes(resample.smote_tomek(skewed, "y", ["id"]))[0] <= 100


def test_smote_is_repeatable_and_handles_text(skewed):
    mixed = skewed.withColumn("s", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    a = resample.smote(mixed, "y", ["id"]).where("id is null").select("a", "s").collect()
    b = resample.smote(mixed.repartition(7), "y", ["id"]).where("id is null").select("a", "s").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 85


def test_resampling_refuses_bad_input(spark, skewed):
    with pytest.raises(ValueError):
        resample.smote(skewed.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), "y", ["id"])
    with pytest.raises(ValueError):
        resample.random_oversample(skewed, "id", ["id"])
    with pytest.raises(ValueError):
        resample.adasyn(skewed.withColumn("s", F.lit("t")), "y", ["id"])


def test_isolation_forest_drops_the_far_points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000, 30.0, 30.0), (1001, -25.0, 20.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    kept = {r.id for r in isolation.isolation_forest_outliers(df, 0.01, columns=["x", "y"]).collect()}
    assert not kept & {1000, 1001} and len(kept) >= 395
    scores = isolation.fit_isolation_forest(df, ["x", "y"]).transform(df)
    assert scores.where("id >= 1000").agg(F.min("anomaly_score")).first()[0] > scores.where("id < 1000").agg(F.avg("anomaly_score")).first()[0]


def test_rows_without_far_neighbours_meet_wide_blocks(spark):
    """Where no cell can be ruled out, a row is dealt to a few bundles of cells, not to every cell, and the answer stays exact."""
    from tabloom.operators.neighbours import WIDE, _candidates

    points = np.random.default_rng(3).normal(size=(1200, 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    found = _candidates(df, df, 2, "v", "id", "id", None, True, 10)
    assert found.groupBy("left_id").count().agg({"count": "max"}).first()[0] <= 2 * 2 * (1200 / (WIDE * 10) + 1)
    assert {(r.left_id, r.right_id) for r in knn_join(df, df, 2, "v", "id", "id", exclude_same=True, block=10).collect()} == brute(points, 2)


def test_lsh_join_compares_buckets_in_blocks(spark):
    """The k nearest of all rows that share a bucket in some table, rows that come twice included; no pair of a bucket becomes a row."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    points = np.random.default_rng(8).normal(size=(300, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    out = lsh_knn_join(df.union(df.where("id < 20")), df, 4, "v", "id", "id", 1.5, 0.5, tables=3)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan
    ready = df.withColumn("f", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.5, numHashTables=3, seed=42).fit(ready)
    hashes = {r.id: [h[0] for h in r.h] for r in model.transform(ready).select("id", "h").collect()}
    want = set()
    for i in range(300):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        near = sorted((d[j], j) for j in range(300) if d[j] < 1.5 and any(a == b for a, b in zip(hashes[i], hashes[j])))[:4]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    assert {(r.left_id, r.right_id, r["rank"]) for r in out.collect()} == want


def test_a_known_bound_and_the_planes_between_pivots_leave_few_cells():
    """A row whose k-th distance is bounded by its own cell asks for about that cell alone, and for every cell with one of its k nearest."""
    from tabloom.operators.neighbours import _Cells
    import pandas as pd

    rng = np.random.default_rng(7)
    points, asking = rng.normal(size=(20_000, 3)), rng.normal(size=(200, 3))
    pivots = points[:100]
    gap = np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(axis=2))
    home, reach = gap.argmin(axis=1), gap.min(axis=1)
    table = pd.DataFrame([{"cell": k, "lo": reach[home == k].min(), "hi": reach[home == k].max(), "near": np.sort(reach[home == k])[:5]} for k in np.unique(home)])
    cells = _Cells(pivots, table, 5)
    every = np.sqrt(((asking[:, None] - points[None]) ** 2).sum(axis=2))
    own = ((asking[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    limit = np.array([np.sort(every[i][home == own[i]])[4] for i in range(200)])
    met = {(int(i), int(b)) for rows, bundles in cells.wanted(asking, limit) for i, b in zip(rows, bundles)}
    assert all((i, int(home[j])) in met for i in range(200) for j in np.argsort(every[i])[:5])
    assert len(met) < 3 * 200 < sum(len(r) for r, _ in cells.wanted(asking))


def test_rows_meet_a_block_of_their_own_cell_before_they_are_routed(spark):
    """Points of few dimensions, ids that come twice, and a hot point: the same rows as by comparing all."""
    rng = np.random.default_rng(12)
    points = np.concatenate([np.tile([0.5, 0.5], (60, 1)), rng.uniform(size=(1500, 2)), [[40.0, 40.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    out = knn_join(df, df, 3, ["x", "y"], "id", "id", exclude_same=True, block=30)
    assert {(r.left_id, r.right_id) for r in out.collect()} == brute(points, 3)
    twice = knn_join(df.where("id < 80").union(df.where("id < 80")), df, 3, ["x", "y"], "id", "id", block=30)
    assert twice.count() == 240


def test_wide_blocks_grow_with_the_rows(spark, monkeypatch):
    """A row is copied to as many blocks as there are tasks to fill, however small ``block`` is, and floats stay floats until compared."""
    from tabloom.operators import neighbours

    monkeypatch.setattr(neighbours, "WIDE_TASKS", 1)
    points = np.random.default_rng(6).normal(size=(1200, 16)).astype("float32")
    df = spark.createDataFrame([(i, i % 2, p.tolist()) for i, p in enumerate(points)], "id long, g int, v array<float>")
    assert df.select(neighbours._vector(df, "v")).dtypes[0][1] == "array<float>"
    for within, share in ((None, 1), ("g", 2)):
        found = neighbours._candidates(df, df, 2, "v", "id", "id", within, True, 5)
        copies = found.groupBy("left_id").count().agg({"count": "max"}).first()[0] / 2
        assert copies <= spark.sparkContext.defaultParallelism ** 0.5 + 2 < 1200 / share / (neighbours.WIDE * 5)
    got = {(r.left_id, r.right_id) for r in knn_join(df, df, 2, "v", "id", "id", exclude_same=True, block=5).collect()}
    assert got == brute(points.astype(float), 2)
