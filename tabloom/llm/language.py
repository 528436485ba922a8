"""Language identification: bit-sliced Bloom filters of character n-grams that answer for all languages at once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import hash_share, held_out

SIZES = (2, 3, 4)
NOT_LETTERS = re.compile(r"[\W\d_]+")
PROBES = 2
UNDECIDED = "und"


def letters_of(text: str | None) -> str:
    """Lower-case letters of a text, other characters as single blanks; empty without letters."""
    found = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {found} " if found else ""


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def grams(letters: str) -> np.ndarray:
    """64-bit hashes of all n-grams of the SIZES, repeats included."""
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled, out = codes, []
    for size in range(2, max(SIZES) + 1):
        if len(codes) < size:
            break
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1:]
        out.append(_mixed(rolled + np.uint64(size)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class LanguageFilters:
    """One table of bit masks: bit l of a slot is the slot's bit in the Bloom filter of language l. Masks are bytes, eight languages each."""

    def __init__(self, languages: Sequence[str], held: Sequence[np.ndarray]):
        self.languages = list(languages)
        most = max((len(g) for g in held), default=1)
        self.bits = max(12, int(np.ceil(np.log2(16 * max(1, most)))))
        self.planes = [np.zeros(1 << self.bits, np.uint8) for _ in range(-(-len(self.languages) // 8))]
        for k, found in enumerate(held):
            for slots in self._slots(found.astype(np.uint64)):
                self.planes[k // 8][slots] |= np.uint8(1 << (k % 8))
        filled = [(self.planes[k // 8] >> (k % 8) & 1).mean() for k in range(len(self.languages))]
        self.false = np.array(filled) ** PROBES  # chance that a filter claims an n-gram it does not hold

    def _slots(self, found: np.ndarray):
        for probe in range(PROBES):
            yield ((found * np.uint64(2 * probe + 1)) >> np.uint64(64 - self.bits) if probe else found & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language holds: popcounts of its bit in the masks, corrected for false positives."""
        slots, out = list(self._slots(found)), []
        for plane in self.planes:
            mask = plane[slots[0]]
            for more in slots[1:]:
                mask = mask & plane[more]
            often = np.bincount(mask, minlength=256)
            out.extend(int(often[np.arange(256) >> bit & 1 == 1].sum()) for bit in range(8))
        claimed = np.array(out[:len(self.languages)], float)
        return np.maximum(0, claimed - self.false * len(found)) / np.maximum(1e-9, 1 - self.false)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language with the highest count, ties to the first by name, and its share of all counts."""
        letters = letters_of(text)
        if not letters:
            return UNDECIDED, 0.0
        if not self.languages:
            return UNDECIDED, 0.0
        counts = self.counts(grams(letters))
        best = int(counts.argmax())
        return self.languages[best], float(counts[best] / counts.sum()) if counts.sum() else 0.0

    def score(self, text: Column) -> Column:
        """Struct ``(lang_pred, score)`` of a whole text."""
        filters = self

        @F.pandas_udf("lang_pred string, score double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([filters.predict(t) for t in texts], columns=["lang_pred", "score"])
        return predicted(text)


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: in how many documents each n-gram occurs; n-gram 0 carries the number of documents."""
    for batch in batches:
        languages = batch.column(1).to_pylist()
        held: dict[str, list] = {}
        for text, language in zip(batch.column(0).to_pylist(), languages):
            if letters := letters_of(text):
                held.setdefault(language, []).append(np.unique(grams(letters)))
        for language, sets in held.items():
            found, often = np.unique(np.concatenate(sets), return_counts=True)
            found, often = np.append(found, np.uint64(0)), np.append(often, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array(found.view(np.int64)), pa.array(often, pa.int64())], ["lang", "gram", "n"])


def fit_languages(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", *, rows_per_language: int = 4000,
                  min_share: float = 0.01, distinct: float = 0.5, max_grams: int = 100_000, seed: int = 0) -> LanguageFilters:
    """Filters of every language from about ``rows_per_language`` of its texts outside the held-out fifth.

    A filter holds the n-grams that occur in ``min_share`` of the language's sampled texts, and at least ``distinct`` as often as in the
    language where they are most frequent; of these the ``max_grams`` most frequent, which bounds the model. Rows with a NULL id or language
    teach nothing, nor do texts without letters. With one language everything is that language, with none everything is undecided.
    """
    known = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a model holds a filter for each anyway
    if not totals:
        return LanguageFilters([], [])
    shares = F.create_map(*[F.lit(x) for name in sorted(totals) for x in (name, min(1.0, rows_per_language / totals[name]))])
    picked = known.where(hash_share(F.col("id"), shares[F.col("lang")], seed))
    counted = picked.select("text", "lang").mapInArrow(_document_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.where("gram = 0").collect()}
    names = sorted(sizes)
    if not names:
        return LanguageFilters([], [])
    least = F.coalesce(*[F.when(F.col("lang") == name, F.lit(max(2 if sizes[name] > 20 else 1, min_share * sizes[name]))) for name in names])
    frequent = counted.where((F.col("gram") != 0) & (F.col("n") >= least)).collect()  # at most a text's n-grams / min_share of a language
    frequent.sort(key=lambda row: (-row["n"], row["gram"]))
    share: dict[int, dict[str, float]] = {}
    for row in frequent:
        share.setdefault(row["gram"], {})[row["lang"]] = row["n"] / sizes[row["lang"]]
    held: dict[str, list[int]] = {name: [] for name in names}
    for gram, by in share.items():
        top = max(by.values())
        for name, part in by.items():
            if part >= distinct * top:
                held[name].append(gram)
    return LanguageFilters(names, [np.array(held[name][:max_grams], np.int64).view(np.uint64) for name in names])


def identify(df: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` of whole texts: ``und`` and 0 where the text is NULL, empty or has no letter.

    Every row is judged by itself, so repeated rows get equal results; ties go to the first language by name. Very long texts are read
    whole. Extra columns are ignored.
    """
    return df.select(F.col(id_col), filters.score(F.col(text_col)).alias("found")).select(id_col, "found.lang_pred", "found.score")
