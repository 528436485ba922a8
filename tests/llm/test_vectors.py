import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm.vector_dedup import near_duplicate_vectors
from tabloom.llm.vector_search import MultiIndex, nearest_vectors
from tabloom.llm.vectors import blocks, kmeans

SCHEMA = "vec_id long, embedding array<double>, label int, id string, key string, vector string, node long, home long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", "c", "c", 1, 1) for i, v in rows], SCHEMA)


def awkward():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(k, base[k]) for k in range(30)]
    rows += [(100 + k, base[0] + 0.02 * rng.normal(size=16)) for k in range(40)]  # a large group of near copies
    rows += [(200 + k, base[1]) for k in range(60)]  # and of equal ones
    rows += [(300, base[2] * 5), (301, -base[2]), (302, None), (303, np.zeros(16)), (304, [np.nan] * 16), (305, [np.inf] + [0] * 15), (306, [None] + [1] * 15),
             (307, [1, 2, 3]), (308, []), (None, base[3]), (309, base[4]), (309, base[4])]
    return rows


def usable(v):
    return v is not None and len(v) == 16 and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))


def brute_links(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, (i, v) in enumerate(good):
        for b, (j, w) in enumerate(good):
            if a != b and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    links[309] //= 2  # counted from both rows
    return links, {i: root(i) for i in parent}


@pytest.mark.parametrize("slack, block_rows", [(4.5, 8192), (4.5, 16), (100, 40)])
def test_links_match_brute_force(spark, slack, block_rows):
    rows = awkward()
    out = near_duplicate_vectors(frame(spark, rows), threshold=0.9, slack=slack, block_rows=block_rows).collect()
    links, roots = brute_links(rows, 0.9)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_links, r.component_id) == (links[r.vec_id] if r.vec_id is not None else 0, roots.get(r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)


def test_no_link_of_low_rank_vectors_is_missed(spark):
    rng = np.random.default_rng(5)
    spread = np.arange(1, 257) ** -0.5  # real embeddings vary in few directions
    base = rng.normal(size=(1500, 256)) * spread
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape) * spread
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.92, (1500, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine ** 2) * other])
    out = near_duplicate_vectors(frame(spark, list(enumerate(x))), threshold=0.9, block_rows=400).collect()
    true = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    assert true.sum() >= 2990
    assert {r.vec_id: r.n_links for r in out} == dict(enumerate(true.tolist()))


def test_no_vectors(spark):
    assert near_duplicate_vectors(frame(spark, []), threshold=0.9).collect() == []
    assert nearest_vectors(frame(spark, []), F.lit(True)).collect() == []
    assert [tuple(r) for r in near_duplicate_vectors(frame(spark, [(1, None), (2, [])])).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_search_is_exact_on_few_rows(spark):
    rows = awkward()
    out = nearest_vectors(frame(spark, rows), F.col("vec_id") % 2 == 0, k=5, share=1.0).collect()
    good = {i: np.array(v, float) for i, v in rows if i is not None and usable(v)}
    for query in {i for i in good if i % 2 == 0}:
        ranked = sorted(((-float((v * good[query]).sum()), i) for i, v in good.items() if i != query))[:5]
        found = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == query)
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([f[2] for f in found], [-s for s, _ in ranked], atol=1e-12)
        assert [f[1] for f in found] == [i for _, i in ranked] or len({round(s, 9) for s, _ in ranked}) < 5
    assert {r.query_id for r in out} == {i for i in good if i % 2 == 0}


def test_fewer_rows_than_asked_for(spark):
    out = nearest_vectors(frame(spark, [(1, [1.0, 0]), (2, [0.5, 1]), (3, [0.5, 1])]), F.lit(True), k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]


def test_recall(spark):
    sf = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(sf)
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = total = 0
    for r in nearest_vectors(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect():
        score = x @ x[ids == r.query_id][0]
        score[ids == r.query_id] = -np.inf
        hits += len(set(ids[np.argsort(-score)[:20]].tolist()) & set(r.found))
        total += 20
    assert total == 20 * 100 and hits / total >= 0.95


def test_cells_come_by_summed_product():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    index = MultiIndex(x, 7, 0)
    np.add.at(index.counts.ravel(), index.cells(x), 1)
    q = rng.normal(size=6)
    cells = index.traverse(q, 600, 1.0)
    sums = (index.books[0] @ q[:3])[:, None] + (index.books[1] @ q[3:])[None]
    order = [int(c) for c in np.argsort(-sums.ravel(), kind="stable") if index.counts.ravel()[c]]
    assert sorted(cells) == sorted(order) and np.all(np.diff(sums.ravel()[cells]) <= 1e-12)
    assert len(index.traverse(q, 5, 0.5)) < len(cells)


def test_blocks_are_bounded():
    first, number = blocks([3, 50, 4, 4, 0, 9], range(6), 10)
    assert number.tolist() == [1, 5, 1, 1, 1, 1] and len(set(range(first[1], first[1] + 5)) & {first[0], first[2]}) == 0
    assert kmeans(np.zeros((0, 4)), 3, 0).shape == (1, 4)
