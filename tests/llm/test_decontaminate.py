import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import decontaminate as module
from tabloom.llm.decontaminate import Words, _fingerprints, decontaminate, shared_spans
from tests.llm.awkward import documents, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, id string, hash string, length string, item string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                there = windows.get(tuple(w[k:k + n]))
                if there:
                    hit.update(range(k, k + n))
                    found |= there
        found.discard(None)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in rows], ITEMS)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def planted():
    rng = random.Random(4)
    rows = [(k, prose(100 + k, rng.choice((12, 25, 40)))) for k in range(30)]
    rows += [(50, "short one"), (51, "Three-word item!"), (52, "word"), (53, "one two three four five six seven eight nine"), (54, ""), (55, None),
             (56, " ?! "), (57, "word word word word word word word word word word word word"), (None, prose(300, 20)), (58, prose(100, 12)), (58, prose(101, 30)),
             (59, "straße été " * 6), (60, "a1 b2 c3 d4 e5")]
    docs = []
    for k in range(120):
        w = prose(1000 + k, rng.randint(0, 80)).split()
        for _ in range(rng.randint(0, 3)):  # shared spans of 8 to 14 words at any place, in other case and punctuation
            item = words(rng.choice(rows)[1]) or ["x"]
            a = rng.randrange(len(item))
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(("", ",", "\n", "--")) for x in item[a:a + rng.randint(8, 14)]]
        docs.append((k, " ".join(w)))
    docs += [(500 + k, prose(100, 12) + " tail") for k in range(40)] + [(600, "word " * 500), (601, "ONE two, three four\tfive six seven eight nine"), (602, "word"),
             (603, "a short one here"), (604, "STRASSE straße été straße été straße été straße été straße été straße"), (605, "a1,b2;c3 d4 e5 a1 b2 c3 d4 e5")]
    return docs, rows


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_hits_match_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast_rows)
    docs, rows = planted()
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), items(spark, rows))
    expected = brute(docs, rows)
    assert sum(e[5] for e in expected) > 80
    assert result(out) == expected


@pytest.mark.parametrize("window, gram", [(10, 10), (6, 2), (1, 5), (20, 3)])
def test_other_windows_match_brute_force(spark, window, gram):
    docs, rows = planted()
    out = decontaminate(spark.createDataFrame(docs[:60], "doc_id long, text string"), items(spark, rows), window=window, gram=gram)
    assert result(out) == brute(docs[:60], rows, window)


def test_awkward_rows(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    bench = [(1, prose(1, 30_000)[40_000:40_400]), (2, "Ab cD"), (3, "1234 5678"), (4, None), (5, "漢字 かな ́é"), (6, "x" * 5000)]
    assert result(decontaminate(df, items(spark, bench))) == brute(rows, bench)


def test_empty_tables(spark):
    df, bench = documents(spark), items(spark, [(1, prose(2, 20))])
    assert decontaminate(empty(df), bench).collect() == []
    clean = decontaminate(df, empty(bench)).collect()
    assert len(clean) == df.count() and not any(r.contaminated or r.n_items or r.n_hit for r in clean)


def test_spans_of_a_shared_passage(spark):
    passage = prose(9, 60).split()
    text = " ".join(["before"] * 3 + passage[5:40] + ["after"] * 20)
    rows, spans = shared_spans(spark.createDataFrame([(7, text)], "doc_id long, text string"), items(spark, [(3, " ".join(passage))]))
    union = {p for r in spans.collect() for p in range(r.start, r.stop)}
    assert union == set(range(3, 38)) and rows.first()["n_words"] == 58


def test_every_long_enough_span_shares_a_fingerprint():
    rng = random.Random(1)
    shared = prose(5, 10)
    prints = []
    for _ in range(50):
        text = " ".join([prose(rng.random(), rng.randint(0, 15)), shared, prose(rng.random(), rng.randint(0, 15))]).encode()
        found = Words(np.frombuffer(text, np.uint8))
        prints.append(set(_fingerprints(found, np.zeros(len(found.starts), np.int64), 5, 10)[1].tolist()))
    assert all(a & b for a in prints for b in prints)


def test_words_of_bounded_spans_hash_alike(monkeypatch):
    raw = np.frombuffer(" ".join([prose(3, 400), "y" * 300, prose(3, 400)]).encode(), np.uint8)
    whole = Words(raw).hashes
    monkeypatch.setattr(module, "SPAN_BYTES", 64)
    assert (Words(raw).hashes == whole).all() and (whole[:400] == whole[401:]).all() and len(set(whole.tolist())) > 100


def test_few_fingerprints_of_a_text_are_kept():
    text = prose(8, 20_000, tuple("abcdefghijklmnop")).encode()
    found = Words(np.frombuffer(text, np.uint8))
    places, _ = _fingerprints(found, np.zeros(len(found.starts), np.int64), 5, 10)
    assert 0.25 < len(places) / len(found.starts) < 0.35  # 2 / (6 + 1) of distinct words
