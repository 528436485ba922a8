import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm.quality import FEATURES, fit_additive, fit_quality, text_features
from tabloom.llm.toxicity import GatedReader, STRIDE, WINDOW, character_grams, fit_toxicity, window_starts, words_of
from tests.llm.awkward import documents, empty, labels, prose


def corpus(spark, count=240):
    """Toxic documents hold a few marked words far apart; bad ones are shouted and full of signs."""
    rng, rows, marks = random.Random(0), [], []
    for k in range(count):
        words = prose(k, rng.randint(20, 200)).split()
        toxic, good = int(k % 4 == 0), int(k % 3 != 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(("vile", "scummy", "hateful"))
        if not good:
            words = [w.upper() + "!!$$" for w in words]
        rows.append((k, " ".join(words), None, None, None, "x", 0.0, 0, 0, [], "", ""))
        marks.append((k, good, toxic, "clash"))
    from tests.llm.awkward import DOCUMENTS
    return spark.createDataFrame(rows, DOCUMENTS), labels(spark, marks + [(None, 1, 1, ""), (3, None, None, "")])


def accuracy(docs, marks, score, label, least):
    rows = docs.select("doc_id", score.alias("s"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held")).join(
        marks.where(f"{label} is not null").select("doc_id", F.col(label).alias("y")), "doc_id").where("held").collect()
    return sum((r.s >= least) == bool(r.y) for r in rows) / len(rows), len(rows)


def test_quality_on_held_out_documents(spark):
    docs, marks = corpus(spark)
    right, n = accuracy(docs, marks, fit_quality(docs, marks).score(F.col("text")), "quality", 0.3)
    assert n > 30 and right >= 0.95


def test_toxicity_on_held_out_documents(spark):
    docs, marks = corpus(spark)
    right, n = accuracy(docs, marks, fit_toxicity(docs, marks).score(F.col("text")), "toxic", 0.5)
    assert n > 30 and right >= 0.85


@pytest.mark.parametrize("fit, nothing", [(fit_quality, 1.0), (fit_toxicity, 0.0)])
def test_awkward_rows_and_missing_labels(spark, fit, nothing):
    docs, marks = corpus(spark, 60)
    scores = documents(spark).select("doc_id", "text", fit(docs, marks).score(F.col("text")).alias("s")).collect()
    assert len(scores) == 18 and all(0 <= r.s <= 1 for r in scores)
    assert len({r.s for r in scores if not (r.text or "").strip() and r.text != "  \n "}) == 1  # NULL and empty alike
    assert {r.s for r in docs.select(fit(docs, empty(marks)).score(F.col("text")).alias("s")).collect()} == {nothing}
    assert empty(docs).select(fit(empty(docs), marks).score(F.col("text")).alias("s")).collect() == []


def test_gradients():
    reader = GatedReader(["a", "bc", "def"], width=3, hidden=4, buckets=16, seed=1)
    reader.p = {k: v.astype(np.float64) for k, v in reader.p.items()}
    windows, y = [["a", "bc", "zz"], ["def"], ["a", "a", "def", "bc", "q"], []], np.array([1.0, 0, 1, 0])
    _, found = reader.gradients(windows, y)
    for name, values in reader.p.items():
        at = np.unravel_index(np.argmax(np.abs(found[name])), values.shape)
        held, losses = values[at], []
        for move in (1e-4, -1e-4):
            values[at] = held + move
            losses.append(reader.gradients(windows, y)[0])
        values[at] = held
        assert found[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3, abs=1e-8)


def test_windows_cover_every_word():
    for n in range(0, 400):
        starts = window_starts(n)
        assert set(range(n)) <= {k for s in starts for k in range(s, s + WINDOW)} and np.all(np.diff(starts) == STRIDE)


def test_a_passage_stands_whole_in_a_window_at_every_offset():
    passage = WINDOW - STRIDE + 1  # longer ones may be cut by every window
    for n in (33, 64, 65, 97, 200, 331):
        starts = window_starts(n)
        assert all(any(s <= at and at + passage <= s + WINDOW for s in starts) for at in range(n - passage + 1))


def test_scores_are_the_highest_of_a_plain_loop_over_windows(spark):
    docs, marks = corpus(spark, 80)
    model = fit_toxicity(docs, marks)
    texts = [prose(k, n) + (" vile scummy" if k % 2 else "") for k, n in enumerate((1, 5, 40, 64, 65, 130, 500))] + ["", " ?? ", "x" * 900]
    plain = []
    for text in texts:
        words, tops = words_of(text), []
        for at in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
            part = words[at:at + WINDOW]
            gates = model.reader.projected(part or ["x"])
            logit = model.reader.forward(gates, np.arange(max(1, len(part)))[None, :], np.array([len(part)]))
            tops.append(float(1 / (1 + np.exp(-float(logit[0])))))
        plain.append(max(tops))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.s for r in df.select("doc_id", model.score(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert np.allclose(found, plain, atol=1e-4)


def test_words_far_into_a_text_count(spark):
    docs, marks = corpus(spark)
    model = fit_toxicity(docs, marks)
    clean = prose(999, 3000)
    df = spark.createDataFrame([(1, clean), (2, clean + " vile scummy hateful vile")], "doc_id long, text string")
    one, two = (r.s for r in df.select("doc_id", model.score(F.col("text")).alias("s")).orderBy("doc_id").collect())
    assert two > 0.5 > one


def test_character_grams_stay_inside_words():
    grams, starts, own = character_grams(["ab", "c", "ab"], 3, 97)
    assert own.tolist() == [2, 1, 2] and grams[starts[0]:starts[0] + 2].tolist() == grams[starts[2]:starts[2] + 2].tolist()
    assert words_of("Don't STOP\n2day") == ["don", "t", "stop", "day"]


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (0, 1) in [(a, b) for a, b, *_ in model.pairs]


def test_additive_scores_are_a_plain_walk_of_the_tables():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 4)), np.zeros((50, 4)), np.repeat(rng.normal(size=(1, 4)), 50, axis=0)])
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.3).astype(float)
    model = fit_additive(x, y, rounds=20, pair_rounds=10)
    for row, found in zip(x, model.score(x)):
        total = model.base
        for value, edges, table in zip(row, model.edges, model.tables):
            total += table[sum(value >= e for e in edges)]
        for a, b, cuts_a, cuts_b, table in model.pairs:
            total += table[sum(row[a] >= e for e in cuts_a)][sum(row[b] >= e for e in cuts_b)]
        assert abs(found - 1 / (1 + np.exp(-total))) < 1e-9


def test_features_are_finite():
    for text in (None, "", "\n\n", "a", "\x00", "漢字" * 9, "!" * 1000):
        assert text_features(text).shape == (len(FEATURES),) and np.isfinite(text_features(text)).all()
