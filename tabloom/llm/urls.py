"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule covers. Columns and SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import hash_share, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX_BUCKETS = 1024
FEATURES = ("url_length", "host_length", "path_length", "query_length", "host_labels", "depth", "parameters", "digit_ratio", "host_digit_ratio",
            "hyphens", "special_ratio", "host_entropy", "path_entropy", "secure", "fragment", "longest_label", "suffix_frequency", "suffix_blocked")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """Holds for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rule(text: str, verdict: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, NULL without one; of equally long rules the first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        found = F.when(rule.fits(host, path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _share(text: Column, pattern: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")

    def part(total: Column, character: Column) -> Column:
        share = (size - F.length(F.replace(text, character, F.lit("")))) / size
        return total - share * F.log2(share)
    return F.when(size > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), part)).otherwise(0.0)


def _suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical_features(df: DataFrame, url_col: str, suffixes: Sequence[tuple[float, float]]) -> DataFrame:
    """Adds the FEATURES as double columns ``f_...``; ``suffixes`` holds log frequency and blocked share of each bucket of host suffixes."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels, bucket = F.split(host, r"\."), _suffix_bucket(host) + 1
    frequency, blocked = (F.lit([float(s[k]) for s in suffixes]) for k in (0, 1))
    values = (F.length(url), F.length(host), F.length(path), F.length(query), F.size(labels), F.size(F.split(path, "/")) - 1,
              F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), _share(url, "0-9"), _share(host, "0-9"),
              F.length(F.regexp_replace(url, "[^-]", "")), _share(url, "%&=_~+$@!"), _entropy(host), _entropy(F.lower(path)),
              url.startswith("https").cast("int"), url.contains("#").cast("int"),
              F.array_max(F.transform(labels, F.length)), F.element_at(frequency, bucket), F.element_at(blocked, bucket))
    return df.select("*", *[v.cast("double").alias(f"f_{name}") for name, v in zip(FEATURES, values)])


class UrlModel:
    """Boosted trees with the suffix statistics they were trained with, or a constant verdict where the labels held one class."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: Sequence[tuple[float, float]], constant: str = "allow"):
        self.trees, self.suffixes, self.constant = trees, list(suffixes), constant

    def transform(self, df: DataFrame, url_col: str) -> DataFrame:
        """Adds ``url_score``, the chance of ``block``, and ``url_verdict``."""
        if self.trees is None:
            return df.withColumns({"url_score": F.lit(float(self.constant == "block")), "url_verdict": F.lit(self.constant)})
        made = lexical_features(df, url_col, self.suffixes)
        packed = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="f_vector").transform(made)
        scored = self.trees.transform(packed).withColumn("url_score", vector_to_array("f_probability")[1])
        return scored.select(*df.columns, "url_score", F.when(F.col("url_score") >= 0.5, "block").otherwise("allow").alias("url_verdict"))


def fit_urls(df: DataFrame, url_col: str, label: Column, *, training_rows: int = 50_000, trees: int = 20, depth: int = 4, seed: int = 0) -> UrlModel:
    """Trains on URLs labelled 1 (block) or 0 (allow); NULL labels only count for the suffix statistics.

    Suffix statistics come from all rows: one row for each of 1,024 buckets of suffixes. The trees see about ``training_rows`` distinct
    labelled URLs, picked by hash. With labels of one class the verdict is that class, without labels allow.
    """
    rows = df.select(F.col(url_col).alias("url"), label.cast("int").alias("label"))
    buckets = {r["bucket"]: r for r in rows.groupBy(_suffix_bucket(host_of(F.col("url"))).alias("bucket")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"), F.count("label").alias("known")).collect()}
    blocked, known = (sum(r[name] for r in buckets.values()) for name in ("blocked", "known"))
    if blocked == 0 or blocked == known:
        return UrlModel(None, [], "block" if blocked else "allow")
    overall = blocked / known
    suffixes = [(math.log1p(buckets[k]["n"]) if k in buckets else 0.0,
                 (buckets[k]["blocked"] + 10 * overall) / (buckets[k]["known"] + 10) if k in buckets else overall) for k in range(SUFFIX_BUCKETS)]
    picked = rows.where(F.col("label").isNotNull() & F.col("url").isNotNull() & hash_share(F.col("url"), min(1.0, training_rows / known), seed))
    made = lexical_features(picked.groupBy("url").agg(F.max("label").alias("label")), "url", suffixes)
    made = written(made.select(F.col("label").cast("double").alias("label"), *[f"f_{n}" for n in FEATURES]), "urls")
    if made.select("label").distinct().count() < 2:
        return UrlModel(None, [], "block" if made.where("label = 1").take(1) else "allow")
    packed = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="f_vector").transform(made)
    boosted = GBTClassifier(featuresCol="f_vector", labelCol="label", predictionCol="f_prediction", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed)
    boosted = boosted.setRawPredictionCol("f_raw").setProbabilityCol("f_probability").fit(packed)
    return UrlModel(boosted, suffixes)


def judge(df: DataFrame, rules: Sequence[Rule], model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict, score)`` of every URL: the longest rule's verdict, else the model's.

    Without ``model`` one is trained on the URLs that rules cover (``fit_urls``). A NULL url, or one without ``://``, has an empty host and
    path, fits no rule unless one is empty, and is judged by the model. Every row is judged by itself: repeated rows repeat, NULL ids stay,
    an empty table gives no row, very long URLs are read whole. Other columns of the table are not used, so their names cannot clash.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("found", longest_rule(rules, F.col("host"), F.col("path")))
    if model is None:
        model = fit_urls(rows, "url", F.when(F.col("found").isNotNull(), (F.col("found.verdict") == "block").cast("int")))
    judged = model.transform(rows, "url")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", "url_verdict").alias("verdict"), F.col("url_score").alias("score"))
