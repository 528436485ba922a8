import random

import numpy as np
import pytest

from tabloom.llm.minhash import FINE, _schedule, _survivors, least_matches, near_duplicates
from tests.llm.awkward import documents, empty, prose


def brute(rows, percent):
    """Smallest id reachable by links, by comparing every pair."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.setdefault(i, set()).update([frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))] if words else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def test_awkward_rows(spark):
    df = documents(spark)
    out = near_duplicates(df, percent=85).collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = brute([r for r in rows if r[0] is not None], 85)
    assert len(out) == len(rows)
    assert all(r.component_id == expected.get(r.doc_id) and r.kept == (r.component_id == r.doc_id) for r in out)
    assert {r.doc_id: r.n_shingles for r in out if r.doc_id in (4, 5, 6, 8)} == {4: 0, 5: 0, 6: 0, 8: 1}


def test_empty_table(spark):
    assert near_duplicates(empty(documents(spark))).collect() == []


def test_chains_and_large_groups_match_brute_force(spark):
    rng, rows = random.Random(5), []
    for group in range(6):
        words = prose(group + 10, 90).split()
        for _ in range(60):
            rows.append((len(rows) * 7 % 1000 + len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice((0, 1, 2))):
                words[rng.randrange(len(words))] = prose(rng.random(), 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        found = {r.doc_id: r.component_id for r in near_duplicates(df, percent=percent).collect()}
        assert found == brute(rows, percent)


def test_bounds_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    left = rng.integers(0, 256, (20_000, FINE), dtype=np.uint8)
    right = np.where(rng.random(left.shape) < 0.85, left, left + 1)
    assert len(_survivors(left, right, _schedule(0.85, 1e-5))) >= 19_990
    apart = np.where(rng.random(left.shape) < 0.6, left, left + 1)
    assert len(_survivors(left, apart, _schedule(0.85, 1e-5))) <= 5


@pytest.mark.parametrize("compared", [64, 512])
def test_least_matches_is_the_posterior_bound(compared):
    m = least_matches(compared, 0.85, 1e-4)
    draws = np.random.default_rng(1).beta(m - 6, compared - m + 8, 200_000)
    assert (draws >= 0.85).mean() < 1e-4 and m < 0.85 * compared
