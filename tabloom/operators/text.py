"""Text expressions and bag-of-words features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c, existing, replace_columns, require_column


def slugify(col: Column) -> Column:
    """Lower case, runs of other characters become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


# fixed values: what is removed from a page, in this order
SCRIPT_BLOCK = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
TAG = r"<[^>]+>"
ENTITY = r"(?U)&#?\w+;"
BLANKS = r"(?U)\s+"


def page_text(col: Column) -> Column:
    for pattern in (SCRIPT_BLOCK, TAG, ENTITY, BLANKS):
        col = F.regexp_replace(col, pattern, " ")
    return F.trim(col)


def html_to_text(df: DataFrame, column: str, max_chars: int | None = None) -> DataFrame:
    """Visible text of a page; with ``max_chars`` cut to so many characters, with a flag when it was longer."""
    require_column(df, column)
    whole = df.withColumn("_text", page_text(c(column)))
    content = F.col("_text") if max_chars is None else F.substring("_text", 1, int(max_chars))
    return (whole.withColumn("content", content).withColumn("truncated", F.length("_text") > F.length("content"))
            .withColumn("chars_returned", F.length("content")).drop("_text"))


def text_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lower case without punctuation and digits, blanks squeezed."""
    new = {}
    for n in existing(df, columns):
        bare = F.regexp_replace(F.lower(c(n)), r"[\p{P}\p{N}]+", " ")
        new[n] = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return replace_columns(df, new)


def text_length_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Characters, words and mean word length."""
    new = {}
    for n in existing(df, columns):
        squeezed = F.trim(F.regexp_replace(c(n), r"\s+", " "))
        words = F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))
        words = F.when(c(n).isNotNull(), words)
        letters = F.length(squeezed) - F.greatest(words - 1, F.lit(0))
        new[f"{n}_char_count"] = F.length(c(n))
        new[f"{n}_word_count"] = words
        new[f"{n}_mean_word_length"] = F.when(words > 0, letters / words).otherwise(F.when(words == 0, 0.0))
    return replace_columns(df, new)


def words(col: Column) -> Column:
    """Lower-case words of letters and digits (any script)."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, joined by blanks."""
    # shifted copies are zipped: a lambda that closed over the token array would split the text once per word
    parts = []
    for n in range(low, high + 1):
        length = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        run = tokens if n == 1 else F.slice(tokens, F.lit(1), length)
        for shift in range(1, n):
            run = F.zip_with(run, F.slice(tokens, F.lit(shift + 1), length), lambda x, y: F.concat_ws(" ", x, y))
        parts.append(run)
    return F.concat(*parts)


def _terms(df: DataFrame, column: str, key: str, ngram_range: tuple[int, int]) -> DataFrame:
    """(key, term, tf): counts per document and term."""
    exploded = df.select(c(key).alias("key"), F.explode(ngrams(words(c(column)), *ngram_range)).alias("term"))
    return exploded.groupBy("key", "term").agg(F.count("*").alias("tf"))


def top_terms(df: DataFrame, column: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """The most frequent terms: (term, total, documents), ties in term order.

    Where every key is there once, totals and documents are added up per task before terms are shuffled.
    """
    require_column(df, column)
    last = lambda counted: counted.orderBy(F.desc("total"), "term").limit(int(max_features))
    if not df.groupBy(c(key)).count().where("count > 1").isEmpty():
        return last(_terms(df, column, key, ngram_range).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("documents")))
    tokens = df.select(ngrams(words(c(column)), *ngram_range).alias("tokens"))
    counts = lambda terms, total, met: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(total).alias("total"), F.lit(met).alias("met")))
    both = tokens.select(F.inline(F.concat(counts(F.col("tokens"), 1, 0), counts(F.array_distinct("tokens"), 0, 1))))
    return last(both.groupBy("term").agg(F.sum("total").alias("total"), F.sum("met").alias("documents")))


def _vocabulary(df: DataFrame, column: str, key: str, max_features: int, ngram_range: tuple[int, int]) -> list:
    """At most ``max_features`` terms, read to the driver in term order."""
    return sorted(top_terms(df, column, key, max_features, ngram_range).collect(), key=lambda r: r["term"])


def _counted(df: DataFrame, column: str, terms: list[str], ngram_range: tuple[int, int], output: str) -> DataFrame:
    """Sparse count vectors over a fixed vocabulary by the hash lookup of the ML transformer."""
    from pyspark.ml.feature import CountVectorizerModel

    model = CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol=output)
    tokens = F.coalesce(ngrams(words(c(column)), *ngram_range), F.array().cast("array<string>"))
    return model.transform(df.withColumn("_tokens", tokens)).drop("_tokens")


def fit_count_vectorize(df: DataFrame, column: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 1)):
    """Adds ``<column>_counts``, a sparse vector over the top terms in term order; rows are not shuffled."""
    from tabloom.operators.fitted import Fitted

    terms = [r["term"] for r in _vocabulary(df, column, key, max_features, ngram_range)]
    if not terms:
        raise ValueError("No terms found.")
    return Fitted(lambda other: _counted(other, column, terms, ngram_range, f"{column}_counts"), {"vocabulary": terms})


def count_vectorize(df: DataFrame, column: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    return fit_count_vectorize(df, column, key, max_features, ngram_range).transform(df)


def tfidf_terms(df: DataFrame, column: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """Long form (key, term, tf, tfidf): tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1."""
    from pyspark.sql import Window

    counted = _terms(df, column, key, ngram_range)
    vocabulary = top_terms(df, column, key, max_features, ngram_range)
    rows = df.count()
    # the vocabulary has at most max_features rows
    joined = counted.join(F.broadcast(vocabulary), "term")
    weight = F.col("tf") * (F.log((1.0 + rows) / (1.0 + F.col("documents"))) + 1)
    norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy("key")))
    return joined.select("key", "term", "tf", (weight / norm).alias("tfidf"))


def fit_tfidf_vectorize(df: DataFrame, column: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 2)):
    """Adds ``<column>_tfidf``, a sparse vector over the top terms, each document scaled to length 1."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    from tabloom.operators.fitted import Fitted

    vocabulary = _vocabulary(df, column, key, max_features, tuple(ngram_range))
    if not vocabulary:
        raise ValueError("No terms found.")
    rows = df.count()
    terms = [r["term"] for r in vocabulary]
    weights = Vectors.dense([math.log((1 + rows) / (1 + r["documents"])) + 1 for r in vocabulary])
    weigh = ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol="_weighted")
    scale = Normalizer(p=2.0, inputCol="_weighted", outputCol=f"{column}_tfidf")

    def apply(other: DataFrame) -> DataFrame:
        return scale.transform(weigh.transform(_counted(other, column, terms, tuple(ngram_range), "_tf"))).drop("_tf", "_weighted")

    return Fitted(apply, {"vocabulary": terms})


def tfidf_vectorize(df: DataFrame, column: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    return fit_tfidf_vectorize(df, column, key, max_features, ngram_range).transform(df)


def lsa_text(df: DataFrame, column: str, key: str, n_components: int = 20, max_features: int = 1_000,
             ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """Latent components lsa_1.. of the TF-IDF rows by a truncated singular value decomposition.

    The axes come from a randomised range finder over the sparse rows (``operators/sketch.py``); no features x features matrix is made.
    Signs make the largest loading positive; documents without a known term get zeros.
    """
    from tabloom.operators.sketch import leading_axes, sparse_parts, times

    ready = fit_tfidf_vectorize(df, column, key, max_features, ngram_range)
    weighted = ready.transform(df)
    axes = leading_axes(weighted, f"{column}_tfidf", len(ready.state["vocabulary"]), n_components)[0]
    count = axes.shape[1]

    @F.arrow_udf("array<double>")
    def project(indices: pa.Array, values: pa.Array) -> pa.Array:
        found = times(indices, values, axes)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, count, dtype=np.int32), found.ravel())

    out = weighted.withColumn("_lsa", project(*sparse_parts(f"{column}_tfidf")))
    return out.select(*[c(n) for n in df.columns], *[F.col("_lsa")[i].alias(f"lsa_{i + 1}") for i in range(count)])
