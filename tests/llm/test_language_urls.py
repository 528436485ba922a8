import re

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm.language import LanguageFilters, fit_languages, grams, identify, letters_of
from tabloom.llm.queries import URL_RULES
from tabloom.llm.urls import FEATURES, fit_urls, judge, lexical_features, parse_rule
from tests.llm.awkward import documents, empty, prose

STEMS = {"xx": ("ka", "ro", "mi", "tu"), "yy": ("sch", "ung", "ber", "ein"), "zz": ("ção", "que", "los", "nha")}


def texts(spark, count=120):
    rows = [(k, prose(k, 5 + k % 60, STEMS[lang]), lang) for k in range(count) for lang in [sorted(STEMS)[k % 3]]]
    return spark.createDataFrame(rows + [(900, prose(1, 20), None), (None, prose(1, 20), "xx"), (901, "12 34", "qq"), (902, None, "xx")], "doc_id long, text string, lang string")


def test_languages_of_held_out_texts(spark):
    df = texts(spark)
    filters = fit_languages(df)
    assert filters.languages == sorted(STEMS)
    rows = identify(df, filters).join(df.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id < 900)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (901, 902))
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    filters, df = fit_languages(texts(spark)), documents(spark)
    out = df.select("doc_id", "text", filters.score(F.col("text")).alias("found")).collect()
    assert len(out) == df.count()
    assert all((r.found.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    nothing = fit_languages(empty(texts(spark)))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert identify(empty(df), filters).collect() == []


def test_bits_answer_for_every_language():
    rng = np.random.default_rng(0)
    held = [rng.integers(1, 1 << 62, 3000).astype(np.uint64) for _ in range(11)]
    filters = LanguageFilters([f"l{k}" for k in range(11)], held)
    for k, own in enumerate(held):
        counts = filters.counts(own)
        assert abs(counts[k] - 3000) < 1 and max(np.delete(counts, k)) < 150  # corrected for false positives
    assert letters_of("A1b") == " a b " and len(grams(" a ")) == 3


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12", "http://example.org/en/2", "http://org/", "http://org", "http://xorg/", "http://a.com/fr/x?u=http://b.org/",
        "http://a.com/de/", "http://a.com/de", "HTTP://Ä.COM/fr/", None, "", "no host", "://", "http://?q", "http://h#f/x", "ftp://a.com:80/fr/", "http://a.com/\n/fr/", "x://y://z/",
        "http://" + "a" * 50_000 + ".org/", "http://casino1.net/?a=1&b=2"]


def pages(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(7, URLS[7]), (None, URLS[0])]
    rows += [(100 + k, f"http://s{k}.example.{('com/de/', 'org/x/', 'com/fr/', 'net/y/')[k % 4]}{k}{'?a=1&b=2' * (k % 4 == 0)}") for k in range(80)]
    return spark.createDataFrame([(*r, "h", "c", "c", 0.1, "v") for r in rows], "page_id long, url string, html string, host string, rule string, url_score double, verdict string")


def test_rules_match_brute_force(spark):
    df = pages(spark)
    out = judge(df, URL_RULES).collect()
    by_id = {r.page_id: r.url for r in df.select("page_id", "url").collect()}
    assert len(out) == df.count()
    for r in out:
        host, path, rule = brute(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_trees_learn_the_labels_without_python(spark):
    df = pages(spark).where("page_id >= 100").select("page_id", "url")
    label = F.when(F.col("url").contains("?"), 1).otherwise(0)
    scored = fit_urls(df, "url", label).transform(df, "url")
    assert scored.where((F.col("url_verdict") == "block") == (label == 1)).count() == 80
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()


def test_one_class_no_labels_no_rows(spark):
    df = pages(spark)
    for label, verdict in ((F.lit(1), "block"), (F.lit(0), "allow"), (F.lit(None).cast("int"), "allow")):
        assert {r.url_verdict for r in fit_urls(df, "url", label).transform(df, "url").collect()} == {verdict}
    assert judge(empty(df), URL_RULES).collect() == []
    assert {r.verdict for r in judge(df.where("page_id = 20"), [parse_rule("net/", "block")]).collect()} == {"block"}


def test_features_are_finite(spark):
    rows = lexical_features(pages(spark), "url", [(1.0, 0.5)] * 1024).select(*[f"f_{n}" for n in FEATURES]).collect()
    assert all(x is not None and np.isfinite(x) for r in rows for x in r)


def test_filter_counts_match_sets_of_each_language():
    rng = np.random.default_rng(0)
    held = [rng.integers(1, 2 ** 63, n, dtype=np.uint64) for n in (3000, 500, 0, 1, 2000, 10, 700, 800, 900, 50)]  # more than eight languages, shared n-grams
    held[4][:400] = held[0][:400]
    filters = LanguageFilters([f"l{k}" for k in range(len(held))], held)
    sets = [set(h.tolist()) for h in held]
    for _ in range(20):
        text = np.concatenate([rng.choice(held[0], 300), rng.choice(held[4], 200), rng.choice(held[8], 40), rng.integers(1, 2 ** 63, 400, dtype=np.uint64)])
        exact = np.array([sum(g in s for g in text.tolist()) for s in sets])
        claimed = filters.counts(text)
        assert (np.abs(claimed - exact) <= 5 + 0.01 * len(text)).all() and claimed.argmax() == exact.argmax()
        for k, s in enumerate(sets):  # a filter never misses what it holds
            mine = np.array([g for g in text.tolist() if g in s], np.uint64)
            if len(mine):
                assert filters.counts(mine)[k] >= len(mine) - 1e-6
