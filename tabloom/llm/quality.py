"""Quality: a generalised additive model with pairwise interactions over text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import labelled_sample

FEATURES = ("log_bytes", "log_words", "word_mean", "word_spread", "word_longest", "short_words", "letters", "capitals", "digits", "spaces",
            "stops", "commas", "loud", "bars", "symbols", "brackets", "entropy", "distinct_words", "top_word", "repeated_next", "log_lines",
            "line_mean", "repeated_lines", "ended_lines", "words_a_stop")


def text_features(text: str | None) -> np.ndarray:
    """Statistics of a whole text, all finite; zeros for an empty or NULL one."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = seen / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counted = Counter(words)
    stops = seen[46] + seen[33] + seen[63]
    some = share[share > 0]
    out[:] = (np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(),
              share[65:91].sum() + share[97:123].sum() + share[128:].sum(), share[65:91].sum(), share[48:58].sum(), share[9:14].sum() + share[32],
              share[46], share[44], share[33] + share[63], share[124], share[[35, 36, 37, 38, 42, 43, 61, 64, 92, 94, 95, 96, 126]].sum(),
              share[[40, 41, 60, 62, 91, 93, 123, 125]].sum(), -(some * np.log2(some)).sum(), len(counted) / count,
              max(counted.values(), default=0) / count, sum(map(eq, words, islice(words, 1, None))) / count, np.log1p(len(lines)),
              np.log1p(len(raw) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
              sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), np.log1p(count / (1 + stops)))
    return out


class AdditiveModel:
    """Log-odds as a sum of lookup tables: one per feature, and one per chosen pair of features."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, across, down, table in self.pairs:
            total += table[np.searchsorted(across, x[:, f], side="right"), np.searchsorted(down, x[:, g], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, low: int, high: int) -> tuple[float, int]:
    """Best cut of bins low..high: its gain and the first bin of its right side."""
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    if not len(left_g):
        return 0.0, low
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gain = left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g ** 2 / (all_h + ridge)
    best = int(gain.argmax())
    return float(gain[best]), low + best + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Steps of a tree of depth two over ordered bins, as a table."""
    table, bounds = np.zeros(len(g)), [0, len(g)]
    gain, cut = _split(g, h, ridge, 0, len(g))
    if gain > 0:
        bounds = [0, cut, len(g)]
        for low, high in ((0, cut), (cut, len(g))):
            deeper, at = _split(g, h, ridge, low, high)
            if deeper > 0:
                bounds.append(at)
    bounds = sorted(set(bounds))
    for low, high in zip(bounds, bounds[1:]):
        table[low:high] = -g[low:high].sum() / (h[low:high].sum() + ridge)
    return table


def _shallow_pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """One cut on each axis that gains most together: four quadrants, as a table."""
    sum_g, sum_h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))

    def corners(s):
        a, right, down, whole = s, s[:, -1:], s[-1:, :], s[-1, -1]
        return a, right - a, down - a, whole - right - down + a
    parts = list(zip(corners(sum_g), corners(sum_h)))
    gain = sum(pg ** 2 / (ph + ridge) for pg, ph in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    table = np.zeros_like(g)
    for (rows, cols), (pg, ph) in zip(((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))), parts):
        table[rows, cols] = -pg[i, j] / (ph[i, j] + ridge)
    return table


def fit_additive(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pair_bins: int = 8, pairs: int = 8, pair_rounds: int = 60,
                 rate: float = 0.1, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: round after round, every feature in turn gets a shallow tree on the current residuals, added to its table.

    Then the ``pairs`` pairs of features whose coarse grid explains most of what is left get tables in the same way.
    """
    edges = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    total = np.full(len(x), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)
    for _ in range(rounds):
        for f, rows in enumerate(binned):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(rows, g, len(tables[f])), np.bincount(rows, h, len(tables[f])), ridge)
            tables[f] += step
            total += step[rows]
    coarse = [_cuts(x[:, f], pair_bins) for f in range(x.shape[1])]
    spots = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]

    def grid(f, g, values):
        return np.bincount(spots[f] * sizes[g] + spots[g], values, sizes[f] * sizes[g]).reshape(sizes[f], sizes[g])
    g, h = slopes()
    strength = {(a, b): float((grid(a, b, g) ** 2 / (grid(a, b, h) + ridge)).sum()) for a, b in combinations(range(len(edges)), 2) if min(sizes[a], sizes[b]) > 1}
    chosen = sorted(strength, key=lambda k: (-strength[k], k))[:pairs]
    grids = {k: np.zeros((sizes[k[0]], sizes[k[1]])) for k in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            g, h = slopes()
            step = rate * _shallow_pair_tree(grid(a, b, g), grid(a, b, h), ridge)
            grids[a, b] += step
            total += step[spots[a], spots[b]]
    return AdditiveModel(base, edges, tables, [(a, b, coarse[a], coarse[b], grids[a, b]) for a, b in chosen])


class QualityModel:
    """A fitted additive model, or a constant where the labels did not hold both classes."""

    def __init__(self, model: AdditiveModel | None, constant: float = 1.0):
        self.model, self.constant = model, constant

    def score(self, text: Column) -> Column:
        """Score of each whole text between 0 and 1."""
        model, constant = self.model, self.constant

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                if model is None or not len(texts):
                    yield pd.Series(np.full(len(texts), constant))
                else:
                    yield pd.Series(model.score(np.stack([text_features(t) for t in texts])))
        return scored(text)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t.as_py()).tolist() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])


def fit_quality(documents: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                rows_per_class: int = 8000, max_chars: int = 1_000_000, seed: int = 0) -> QualityModel:
    """Fits on a bounded sample: about ``rows_per_class`` labelled documents of each class outside the held-out fifth.

    Features are made in the tasks; the driver gets their numbers only. NULL and empty texts have all features 0 and are scored like any
    other. Without labels of both classes the score is the only label seen, 1 without any. Repeated rows count as often as they occur;
    labels of one id that differ count as 1. Extra columns are ignored.
    """
    sample = labelled_sample(documents, labels, label, rows_per_class, max_chars, id_col=id_col, text_col=text_col, seed=seed)
    rows = sorted((tuple(r["x"]), r["label"]) for r in sample.mapInArrow(_feature_rows, "x array<double>, label int").collect())
    y = np.array([k for _, k in rows], float)
    if len(set(y.tolist())) < 2:
        return QualityModel(None, float(y[0]) if len(y) else 1.0)
    return QualityModel(fit_additive(np.array([x for x, _ in rows]), y))
