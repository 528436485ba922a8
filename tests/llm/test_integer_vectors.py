import hashlib

import numpy as np
import pytest

from tabloom.llm.centroids import Histories, cluster_vectors
from tabloom.llm.integers import grouped, products, squared
from tabloom.llm.vector_codes import Codebook, Tree, compress_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, part int, entry int, seen string, known string, name string, rows int, error int"


def frame(spark, rows):
    extra = ("c", 1, 2, "c", "c", "c", 3, 4)
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, *extra) for i, v, label in rows], SCHEMA)


def awkward(size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(40, size)) * 0.3
    rows = [(k, base[k], k % 3) for k in range(40)]
    rows += [(100 + k, base[0], 7) for k in range(50)]  # equal vectors
    rows += [(200 + k, base[k % 5] + 0.01 * rng.normal(size=size), None) for k in range(200)]
    rows += [(300, np.zeros(size), None), (301, [np.nan] * size, 1), (302, [np.inf] + [0] * (size - 1), 1), (303, [None] + [1] * (size - 1), 1),
             (304, None, 1), (305, [], 1), (306, [1, 2, 3], 1), (None, base[3], 2), (309, base[4], 1), (309, base[4], 1), (-5, -base[6], 0)]
    return rows


def kept(rows, size, scale):
    good = [(i, np.array(v, float), label) for i, v, label in rows if v is not None and len(v) == size and all(x is not None for x in v)]
    return [(i, np.floor(scale * v).astype(int).tolist(), label) for i, v, label in good if np.isfinite(v).all()]


def lloyd(points, centres, rounds):
    """Plain Lloyd's rounds on lists of integers: the last assignment and the last centres."""
    def assign():
        return [min(range(len(centres)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, centres[k])), k)) for p in points]
    centres = [list(c) for c in centres]
    for _ in range(rounds):
        near = assign()
        for k in set(near):
            mine = [p for p, j in zip(points, near) if j == k]
            centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return assign(), centres


@pytest.mark.parametrize("clusters", [16, 400])
def test_clusters_match_plain_rounds(spark, clusters):
    rows = awkward(64)
    points = kept(rows, 64, 64)
    start = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1]))[:clusters]
    near, centres = lloyd([p[1] for p in points], [p[1] for p in start], 3)
    expected, inertia = [], {}
    for (i, v, _), k in zip(points, near):
        d = sum((a - b) ** 2 for a, b in zip(v, centres[k]))
        inertia[k] = inertia.get(k, 0) + d
        expected.append((i, k, d))
    digest = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centres)}
    out = cluster_vectors(frame(spark, rows), clusters=clusters).collect()
    found = sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=repr)
    assert found == sorted(expected, key=repr)
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) and r.centroid_sha256 == digest[r.cluster] for r in out)


def test_bounds_spare_most_distances_and_lose_none():
    rng = np.random.default_rng(2)
    middle = rng.integers(-400, 400, (12, 8))
    x = middle[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 8))
    rounds, seen = [middle + rng.integers(-50, 50, middle.shape)], None
    seen = squared(x, rounds[0])
    cluster, when = seen.argmin(axis=1), np.zeros(seen.shape, np.uint8)
    evaluated = 0
    for _ in range(5):
        found, n, s = grouped(cluster, x)
        after = rounds[-1].copy()
        after[found] = s // n[:, None]
        rounds.append(after)
        history = Histories(rounds)
        cluster = history.settle(x, cluster, seen, when)
        evaluated += int((when == history.now).sum())
        assert (cluster == squared(x, after).argmin(axis=1)).all()
    assert evaluated < 0.1 * 5 * 12 * len(x)


def test_loosening_uses_the_whole_displacement():
    there = np.array([[0, 0]]), np.array([[100, 0]]), np.array([[0, 0]])  # away and back: no net displacement
    assert Histories(there).moved[:, 0].tolist() == [0.0, 100.0, 0.0]


@pytest.mark.parametrize("entries", [256, 16, 1])
def test_codes_match_plain_rounds(spark, entries):
    rows = awkward(16)
    points = kept(rows, 16, 1024)
    start = sorted(points, key=lambda p: (p[0] is None, p[0] or 0, p[1]))[:entries]
    near, books = zip(*(lloyd([p[1][at:at + 4] for p in points], [p[1][at:at + 4] for p in start], 4) for at in range(0, 16, 4)))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    expected, errors = [], {}
    for row, (i, v, label) in enumerate(points):
        error = sum((a - b) ** 2 for p in range(4) for a, b in zip(v[4 * p:4 * p + 4], books[p][near[p][row]]))
        errors[label] = errors.get(label, 0) + error
        expected.append((i, "".join(f"{n[row]:02x}" for n in near), error))
    out = compress_vectors(frame(spark, rows), entries=entries).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in out), key=repr) == sorted(expected, key=repr)
    assert all(r.label_error == errors[r.label] and r.codebooks_sha256 == digest for r in out)


@pytest.mark.parametrize("spread", [1, 30, 5000])
def test_trees_assign_like_brute_force(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-1000, 1000, (200, 4))
    book[7] = book[150]  # equal entries: the lower index
    x = np.concatenate([book[rng.integers(0, 200, 3000)] + rng.integers(-spread, spread + 1, (3000, 4)), book])
    tree = Tree(x, 64)
    near, counts, sums, whole = Codebook(book).nearest(tree)
    brute = squared(tree.x, book).argmin(axis=1)
    assert (near == brute).all() and counts.tolist() == np.bincount(brute, minlength=200).tolist()
    assert all((sums[e] == tree.x[brute == e].sum(axis=0)).all() for e in range(200))
    assert (tree.x == x[tree.order]).all()


def test_dense_groups_are_assigned_whole():
    rng = np.random.default_rng(0)
    book = rng.integers(-1000, 1000, (64, 4)) * 50
    x = book[np.repeat(np.arange(64), 64)] + rng.integers(-3, 4, (4096, 4))
    assert Codebook(book).nearest(Tree(x, 64))[3] >= 0.9 * len(x)


def test_products_are_exact_beyond_floating_point():
    x = np.array([[(1 << 26) - 1, 1 << 26], [1 << 26, -(1 << 26)]] * 3)
    assert products(x, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in x] for p in x]


@pytest.mark.parametrize("run", [cluster_vectors, compress_vectors])
def test_no_vectors(spark, run):
    assert run(frame(spark, [])).collect() == []
    assert run(frame(spark, [(1, None, 1), (2, [np.nan] * 64, 1), (3, [], None)])).collect() == []


def test_components_beyond_the_range_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(frame(spark, [(1, [1e9] * 64, 1)])).collect()
