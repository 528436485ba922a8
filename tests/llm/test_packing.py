import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tabloom.llm import packing
from tabloom.llm.packing import RANKED, Index, Lists, TextIds, Weights, _term_counts, pack
from tests.llm.awkward import documents, empty, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["a\x1cb c\x1dd\x1e e\x1f", "x\x85y\xa0z", " a b　c", "ÀÉÎ I'M DON'T it's 'tis we've", "<|endoftext|> a<|startoftext|>b", "ΑΣ Σ ΣΑ\nΣ",
        "é ́a ﬁ İI ǅ", "\x0ba\x0cb\x00c", "", "  \n ", None, "漢字かな 123 4a5b6 !!??..", "a᠎b﻿c", "\U0001F600 x", "z" * 300, "Straße. ÑANDÚ,*** ÷ a× İx ſt K Å ẞ <|ENDOFTEXT|> x<|y can't. o'' (a) a) 's. Ÿ!"]


def test_index_is_made_in_little_more_than_it_holds():
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 40_000, 300).astype("<u2") for _ in range(8_192)]
    weights = Weights([(t, 60) for t in range(40_000)] + [(-1, 300 * 8_192), (-2, 8_192)], "<u2", 49_152)
    tracemalloc.start()
    index = Index(rests, weights)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert index.count == 8_192 and peak < 90 << 20 and held < 50 << 20
    assert index.starts[-1] == len(index.rows) == sum(len(np.unique(r)) for r in rests)


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(spark):
    tokens = TextIds(PATH)
    assert tokens.parted
    for texts in (HARD, [t for t in HARD if t], [None, ""], HARD[3:5] * 3):
        ids, bounds = tokens.ids(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library(t) for t in texts]


def checked(df, window=2048, **options):
    rows = pack(df, PATH, window=window, **options).collect()
    sequences, documents_ = {}, {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents_.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return rows, sequences, documents_, padding


def test_words_are_kept_in_arrays_and_asked_once(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3_000)
    tokens = TextIds(PATH)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aàeßnîrst"), rng.integers(1, 9))) for _ in range(4_000)]
    for start in range(0, 4_000, 1_000):  # words come again, kept ones and others
        texts = [" ".join(words[max(0, start - 500):start + 1_000]), None, "", words[start].upper() + "!"]
        ids, bounds = tokens.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in tokens.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert len(tokens.known) == len(tokens.known_sizes) == len(set(tokens.known.to_pylist())) <= 3_000
    assert tokens.known.nbytes + tokens.known_sizes.nbytes + tokens.known_ids.nbytes < 60 * len(tokens.known)


def test_anchor_is_the_term_of_the_smallest_draw():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 50, n).astype("<u2") for n in (0, 5, 40, 0, 1, 300, 0)]
    weights = Weights([(t, 1 + t % 5) for t in range(50)] + [(-1, 346), (-2, 4)], "<u2", 50)
    lists = Lists(weights)
    lists.luck = np.round(lists.luck, 1)  # some draws are equal
    rows, terms, weight = weights.of(rests)
    draw = lists.luck[terms] / np.maximum(weight, 1e-12)
    expected = [min(((draw[k], terms[k]) for k in np.flatnonzero(rows == row)), default=(0, 0))[1] for row in range(len(rests))]
    assert lists.sketched(rests)[1].tolist() == expected
    assert lists.sketched([rests[0]])[1].tolist() == [0]


def test_every_id_once(spark):
    df = documents(spark)
    rows, sequences, found, padding = checked(df)
    assert padding == 0
    for r in df.where("doc_id is not null and doc_id <> 11").collect():
        ids = np.array(library(r.text) + [1], "<u4").tobytes()
        parts = sorted(found[r.doc_id, len(ids) // 4])
        assert b"".join(p for _, p in parts) == ids and [s for s, _ in parts] == [sum(len(p) // 4 for _, p in parts[:k]) for k in range(len(parts))]
    assert sum(r.length for r in rows if r.doc_id == 11) == 2 * (len(library(prose(3, 80))) + 1)
    assert sum(r.length for r in rows if r.doc_id is None) == len(library(prose(4, 60))) + 2


def test_small_windows_and_empty_table(spark):
    assert checked(documents(spark), window=16)[3] == 0
    assert pack(empty(documents(spark)), PATH).collect() == []


def test_near_documents_share_sequences(spark):
    topics = [tuple(f"{t}{k}word" for k in range(40)) for t in "abcdefgh"]
    df = spark.createDataFrame([(k, prose(k, 60, topics[k % 8])) for k in range(160)], "doc_id long, text string")
    sequences = {}
    for r in pack(df, PATH).collect():
        sequences.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert np.mean([len(s) for s in sequences.values()]) <= 3.5


def test_nearest_documents_of_other_index_parts_meet(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("bcdfgklmnprstvz"), 2)) + "aeiou"[k % 5] + "".join(rng.choice(list("bcdfgklmnprstvz"), 3)) for k in range(4000)]
    rows = []
    for k in range(1500):  # pairs share 60 words, and each has a rarer one of its own, repeated, that leads its weights
        shared = " ".join(rng.choice(words, 60))
        for side in (0, 1):
            own = "".join(rng.choice(list("qwxyjh"), 5))
            rows.append((2 * k + side, f"{shared} " + f"{own} " * 12))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sequences = {}
    for r in pack(df, PATH, window=512, rows_per_task=1000).collect():
        sequences.setdefault(r.doc_id, set()).add(r.sequence_id)
    met = np.mean([bool(sequences[2 * k] & sequences[2 * k + 1]) for k in range(1500)])
    assert met >= 0.8, met  # a partner that only fits cut may stand in the next window


def weighed(ids, vocabulary):
    counts = [tuple(row) for b in _term_counts(64, "<u2", vocabulary)(iter([pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary())], ["ids"])]))
              for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    return Weights(counts, "<u2", vocabulary)


def brute_scores(ids):
    """BM25 of every row for every row, from its published formula, over all terms."""
    n, mean = len(ids), np.mean([len(x) for x in ids])
    found = [dict(zip(*np.unique(x, return_counts=True))) for x in ids]
    df = {}
    for f in found:
        for t in f:
            df[t] = df.get(t, 0) + 1
    weight = [{t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, k in f.items()} for x, f in zip(ids, found)]
    return np.array([[sum(w[t] for t in f if t in w) for w in weight] for f in found])


def test_scores_are_bm25_over_all_terms():
    rng = np.random.default_rng(1)
    ids = [rng.zipf(1.3, rng.integers(5, 60)).clip(max=500).astype("<u2") for _ in range(300)]
    index, brute = Index(ids, weighed(ids, 512)), brute_scores(ids)
    for row in range(300):
        assert np.allclose(index.scores(row), brute[row], rtol=1e-4)
        unused = rng.random(300) < 0.8
        ranked, best = index.neighbours(row, unused), np.sort(np.where(unused, brute[row], 0))[::-1]
        assert unused[ranked].all() and np.allclose(brute[row][ranked], best[:len(ranked)], rtol=1e-4) and len(ranked) == min(RANKED, (best > 0).sum())


def test_shards_hold_most_of_the_nearest_documents():
    rng = np.random.default_rng(2)
    ids = []
    for topic in range(12):  # topics share most words and have some of their own
        own = rng.choice(400, 60, replace=False) + 100
        ids += [np.concatenate([rng.zipf(1.2, 23).clip(max=99), rng.choice(own, 40)]).astype("<u2") for _ in range(100)]
    order = rng.permutation(len(ids))
    ids = [rng.permutation(ids[k]) for k in order]
    lists = Lists(weighed(ids, 512))
    lists.learn(*lists.sketched(ids[::2]), 300)
    shard, _ = lists.placed(ids, np.arange(len(ids)) * 7919)
    assert np.bincount(shard).max() <= 400 and len(np.unique(shard)) >= 4
    brute = brute_scores(ids)
    np.fill_diagonal(brute, -1)
    near = np.argsort(-brute, axis=1)[:, :8]
    assert (shard[near] == shard[:, None]).mean() >= 0.6


def test_a_list_of_equal_documents_is_dealt_over_shards():
    ids = [np.arange(40).astype("<u2")] * 3000 + [np.arange(50, 90).astype("<u2")] * 100
    lists = Lists(weighed(ids, 128))
    lists.learn(*lists.sketched(ids[::4]), 500)
    shard, _ = lists.placed(ids, np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, len(ids)))
    assert np.bincount(shard[:3000], minlength=1).max() <= 700


def test_full_shards_are_closed(spark):
    df = documents(spark).where("doc_id is not null")
    rows, sequences, found, padding = checked(df, window=64, rows_per_task=3)
    assert padding == 0 and sum(r.length for r in rows) == sum(len(library(r.text)) + 1 for r in df.collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_do_not_depend_on_partitions(spark, parts):
    df = documents(spark).where("doc_id is not null")
    first = sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in pack(df.coalesce(1), PATH).collect())
    assert first == sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in pack(df.repartition(parts), PATH).collect())
