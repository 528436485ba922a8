"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, written in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.chunks import Numbered
from tabloom.llm.common import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
WINDOW, STRIDE = 64, 48  # neighbouring windows share a quarter of their words
TYPES_KEPT = 50_000  # projected words a task keeps
CHUNK_WORDS = 100_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_starts(count: int) -> np.ndarray:
    """Starts of overlapping windows that cover all of ``count`` words; one (empty) window without words."""
    return np.arange(0, max(1, count - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * x.dtype.type(0.5))
    x *= 0.5
    x += 0.5
    return x


GRAMS = (3, 5)  # sizes of the character n-grams
TABLE = 4
DROPPED_WORDS, DECAY, SHRINK, POSITIVE = 0.3, 0.02, 3.0, 0.3  # of training; POSITIVE is the share of windows of label 1


def character_grams(words: Sequence[str], size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of words with their ends marked: ``(buckets, first position of each word, n-grams of each word)``.

    A word of n letters has n + 1 positions; those where no n-gram of its own starts hold -1.
    """
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02" * size).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    total = int(lengths.sum() + len(words))
    hashed = np.full(total, size, np.uint64)
    for k in range(size):
        hashed = (hashed ^ codes[k:k + total]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    grams = (hashed % np.uint64(buckets)).astype(np.int64)
    own = np.maximum(0, lengths + 3 - size)
    offset = np.arange(total) - np.repeat(starts, lengths + 1)
    grams[offset >= np.repeat(own, lengths + 1)] = -1
    return grams, starts, own


def _add_rows(target: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """``target[index] += values`` with repeated indexes, by sorting."""
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        target[index[first]] += np.add.reduceat(values[order], first)


class GatedReader:
    """Parameters and passes of the network. Arrays carry the direction first: 0 reads forward, 1 backward."""

    def __init__(self, vocabulary: Sequence[str], *, width: int = 12, hidden: int = 16, buckets: int = 8192, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.ids = {word: k + 1 for k, word in enumerate(vocabulary)}
        self.width, self.hidden, self.buckets = width, hidden, buckets
        self.p = {"word": normal(len(vocabulary) + 1, width, scale=0.1), "char": normal(buckets, width, scale=0.1),
                  "W": normal(2, 2 * width, 3 * hidden, scale=width ** -0.5 / 2), "b": np.zeros((2, 1, 3 * hidden), np.float32),
                  "U": normal(2, hidden, 3 * hidden, scale=hidden ** -0.5), "A": normal(2 * hidden, hidden, scale=hidden ** -0.5),
                  "a": np.zeros(hidden, np.float32), "v": normal(hidden, scale=0.5), "o": normal(2 * hidden, scale=0.3), "c": np.zeros(1, np.float32)}

    # --- inputs -------------------------------------------------------------------------------------------------------------------
    def inputs(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """Word and character vectors of word types side by side, and what they are made of."""
        known = np.fromiter((self.ids.get(w, 0) for w in words), np.int64, len(words))
        mean, parts = np.zeros((len(words), self.width), np.float32), []
        for size in GRAMS:
            grams, starts, own = character_grams(words, size, self.buckets)
            vectors = self.p["char"][grams]
            vectors[grams < 0] = 0
            mean = mean + np.add.reduceat(vectors, starts) / np.maximum(own, 1)[:, None]
            parts.append((grams, np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(grams)))), np.maximum(own, 1)))
        return np.concatenate([self.p["word"][known], mean], axis=1), known, parts

    def projected(self, words: Sequence[str]) -> np.ndarray:
        """Gate inputs of word types for both directions: (2, types, 3 * hidden)."""
        parts = []
        for start in range(0, len(words), 20_000):
            x = self.inputs(words[start:start + 20_000])[0].astype(np.float32)
            parts.append(x @ self.p["W"] + self.p["b"])
        return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0, 3 * self.hidden), np.float32)

    # --- passes -------------------------------------------------------------------------------------------------------------------
    def forward(self, gates: np.ndarray, types: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows. ``types``: (windows, steps) rows of ``gates``, anything beyond ``lengths``."""
        p, n, (rows, steps) = self.p, self.hidden, types.shape
        at = np.arange(steps)
        mask = at[None, :] < lengths[:, None]
        whole = bool(mask.all())
        turned = np.where(mask, lengths[:, None] - 1 - at[None, :], at[None, :])
        order = np.stack([types, types[:, ::-1] if whole else np.take_along_axis(types, turned, 1)])
        h, states, saved = np.zeros((2, rows, n), gates.dtype), np.zeros((2, rows, steps, n), gates.dtype), []
        full, ahead = mask.all(axis=0), np.ascontiguousarray(order.transpose(0, 2, 1))
        x = np.empty((2, rows, 3 * n), gates.dtype)
        for t in range(steps):
            for d in (0, 1):
                np.take(gates[d], ahead[d, t], axis=0, out=x[d])
            u = h @ p["U"]
            zr = _sigmoid(x[..., :2 * n] + u[..., :2 * n])
            z, r = zr[..., :n], zr[..., n:]
            new = r * u[..., 2 * n:]
            new += x[..., 2 * n:]
            np.tanh(new, out=new)
            step = h - new
            step *= z
            step += new
            if keep:
                saved.append((h, z, r, new, u[..., 2 * n:]))
            h = step if full[t] else np.where(mask[None, :, t, None], step, h)
            states[:, :, t] = h
        back = states[1][:, ::-1] if whole else np.take_along_axis(states[1], turned[..., None], 1)
        both = np.concatenate([states[0], back], axis=2)
        hidden = np.tanh(both @ p["A"] + p["a"])
        weight = np.where(mask, hidden @ p["v"], -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * mask
        weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", weight, both)
        logits = pooled @ p["o"] + p["c"][0]
        return (logits, (order, mask, turned, saved, both, hidden, weight, pooled)) if keep else logits

    def backward(self, dlogits: np.ndarray, kept, gate_count: int) -> dict[str, np.ndarray]:
        """Gradients of all parameters but the inputs', and of ``gates``."""
        p, n = self.p, self.hidden
        order, mask, turned, saved, both, hidden, weight, pooled = kept
        g = {"o": pooled.T @ dlogits, "c": np.array([dlogits.sum()])}
        dpooled = dlogits[:, None] * p["o"][None, :]
        dboth = weight[..., None] * dpooled[:, None, :]
        dweight = np.einsum("bth,bh->bt", both, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bth,bt->h", hidden, dscore)
        dhidden = dscore[..., None] * p["v"] * (1 - hidden ** 2)
        g["A"] = np.einsum("bti,bth->ih", both, dhidden)
        g["a"] = dhidden.sum(axis=(0, 1))
        dboth = dboth + dhidden @ p["A"].T
        dback = np.zeros_like(dboth[..., n:])
        np.put_along_axis(dback, np.broadcast_to(turned[..., None], dback.shape), dboth[..., n:], 1)
        dstates = np.stack([dboth[..., :n], dback])
        dgates, dU, dh = np.zeros((2, gate_count, 3 * n), np.float32), np.zeros_like(p["U"]), np.zeros_like(dstates[:, :, 0])
        dx = np.zeros((2, *mask.shape, 3 * n), np.float32)
        for t in range(mask.shape[1] - 1, -1, -1):
            h, z, r, new, un = saved[t]
            dh = dh + dstates[:, :, t]
            on = mask[None, :, t, None]
            dstep, dh = np.where(on, dh, 0), np.where(on, 0, dh)
            dan = dstep * (1 - z) * (1 - new ** 2)
            daz, dar = dstep * (h - new) * z * (1 - z), dan * un * r * (1 - r)
            du = np.concatenate([daz, dar, dan * r], axis=2)
            dx[:, :, t] = np.concatenate([daz, dar, dan], axis=2)
            dU += np.swapaxes(h, 1, 2) @ du
            dh = dh + dstep * z + du @ np.swapaxes(p["U"], 1, 2)
        for d in (0, 1):
            _add_rows(dgates[d], order[d].ravel(), dx[d].reshape(-1, 3 * n))
        return g | {"U": dU, "gates": dgates}

    def gradients(self, windows: Sequence[Sequence[str]], labels: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of labelled windows and its gradients; with ``rng`` some words are read by their characters alone."""
        names = sorted({w for window in windows for w in window}) or [""]
        rows = {w: k for k, w in enumerate(names)}
        lengths = np.array([len(w) for w in windows])
        types = np.zeros((len(windows), max(1, lengths.max())), np.int64)
        for k, window in enumerate(windows):
            types[k, :len(window)] = [rows[w] for w in window]
        x, known, parts = self.inputs(names)
        if rng is not None:
            known = np.where(rng.random(len(known)) < DROPPED_WORDS, 0, known)
            x[:, :self.width] = self.p["word"][known]
        gates = x @ self.p["W"] + self.p["b"]
        logits, kept = self.forward(gates, types, lengths, keep=True)
        score = _sigmoid(logits)
        loss = float(-np.mean(labels * np.log(score + 1e-9) + (1 - labels) * np.log(1 - score + 1e-9)))
        g = self.backward(((score - labels) / len(labels)).astype(np.float32), kept, len(names))
        dgates = g.pop("gates")
        g["W"] = np.stack([x.T @ dgates[d] for d in (0, 1)])
        g["b"] = dgates.sum(axis=1)[:, None, :]
        dx = dgates[0] @ self.p["W"][0].T + dgates[1] @ self.p["W"][1].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        _add_rows(g["word"], known, dx[:, :self.width])
        for grams, owner, own in parts:
            real = grams >= 0
            _add_rows(g["char"], grams[real], (dx[:, self.width:] / own[:, None])[owner[real]])
        return loss, g

    # --- training -----------------------------------------------------------------------------------------------------------------
    def window_logits(self, documents: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows of documents, with each window's document and start."""
        reader = _Scorer(self)
        return reader.windows([list(d) for d in documents])

    def prime(self, documents: Sequence[Sequence[str]], y: np.ndarray) -> dict[str, float]:
        """Starts the first dimension of every word and n-gram at its log-odds over the documents, shrunk where few hold it; returns the words'."""
        ratio = max(1, (y == 1).sum()) / max(1, (y == 0).sum())
        shrunk = lambda one, zero: np.log((one + SHRINK) / (zero * ratio + SHRINK))
        words, grams = [Counter(), Counter()], np.zeros((2, self.buckets))
        for document, side in zip(documents, y.astype(int)):
            names = sorted(set(document))
            words[side].update(names)
            if names:
                held = np.unique(np.concatenate([character_grams(names, size, self.buckets)[0] for size in GRAMS]))
                grams[side, held[held >= 0]] += 1
        odds = {w: float(shrunk(words[1][w], words[0][w])) for w in words[0].keys() | words[1].keys()}
        for word, k in self.ids.items():
            self.p["word"][k, 0] = odds.get(word, 0.0)
        self.p["char"][:, 0] = shrunk(grams[1], grams[0])
        return odds

    def fit(self, documents: Sequence[Sequence[str]], labels: Sequence[int], *, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        """Learns from documents' labels although one window decides: each epoch reads the highest window of every document, and a random one of the others.

        Before anything is learnt, windows are ranked by their most telling word, by its log-odds over documents.
        """
        y, rng = np.asarray(labels, np.float32), np.random.default_rng(seed)
        odds = self.prime(documents, y)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            if epoch == 0:
                best = [max(window_starts(len(d)), key=lambda at, d=d: max((odds.get(w, -9.0) for w in d[at:at + WINDOW]), default=-9.0)) for d in documents]
            else:
                logits, owner, starts = self.window_logits(documents)
                order = np.lexsort((logits, owner))
                last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))
                best = starts[order][last]
            work = [(list(d[at:at + WINDOW]), k) for d, at, k in zip(documents, best, y)]
            work += [(list(d[(at := int(rng.choice(window_starts(len(d))))):at + WINDOW]), k) for d, k in zip(documents, y) if k == 0]
            sides = np.array([k for _, k in work])
            weight = np.where(sides == 1, POSITIVE / max(1, (sides == 1).sum()), (1 - POSITIVE) / max(1, (sides == 0).sum()))
            picks = rng.choice(len(work), size=max(len(work), 20 * batch), p=weight / weight.sum())
            for start in range(0, len(picks), batch):
                part = [work[k] for k in picks[start:start + batch]]
                step += 1
                _, g = self.gradients([w for w, _ in part], np.array([k for _, k in part], np.float32), rng)
                fall = min(1.0, (epochs - epoch) / (epochs / 2))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    table = k in ("word", "char")  # one scale for a whole table: what many documents share outweighs what a few do
                    s[k] = 0.99 * s[k] + 0.01 * ((v ** 2).sum(axis=1).max() / v.shape[1] if table else v ** 2)
                    now = rate * fall * (TABLE if table else 1)
                    self.p[k] = (self.p[k] * (1 - now * DECAY * table) - now * m[k] / (1 - 0.9 ** step) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)


class _Scorer:
    """Scores documents in a task; keeps the gate inputs of a bounded number of word types."""

    def __init__(self, reader: GatedReader):
        self.reader, self.types, self.gates = reader, Numbered(), reader.projected([])

    def windows(self, documents: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(d) for d in documents], np.int64)
        types = np.fromiter(map(self.types.__getitem__, chain.from_iterable(documents)), np.int64, int(counts.sum()))
        gates = np.concatenate([self.gates, self.reader.projected(self.types.new)], axis=1)
        self.types.settle(TYPES_KEPT)
        self.gates = gates[:, :TYPES_KEPT]
        starts = [window_starts(int(c)) for c in counts]
        owner = np.repeat(np.arange(len(documents)), [len(s) for s in starts])
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        lengths = np.minimum(WINDOW, counts[owner] - starts)
        first = (np.cumsum(counts) - counts)[owner] + starts
        logits, order = np.zeros(len(starts), np.float32), np.argsort(lengths, kind="stable")
        if not len(types):
            gates, types = np.zeros((2, 1, 3 * self.reader.hidden), np.float32), np.zeros(1, np.int64)
        for at in range(0, len(order), 1024):
            pick = order[at:at + 1024]
            steps = max(1, int(lengths[pick].max()))
            grid = types[np.minimum(first[pick][:, None] + np.arange(steps), max(0, len(types) - 1))]
            logits[pick] = self.reader.forward(gates, grid, lengths[pick])
        return logits, owner, starts

    def scores(self, texts) -> np.ndarray:
        """Highest window of each text."""
        out, held, size = [], [], 0

        def flush():
            logits, owner, _ = self.windows(held)
            top = np.full(len(held), -np.inf)
            np.maximum.at(top, owner, logits)
            out.append(_sigmoid(top))
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                flush()
                held, size = [], 0
        if held:
            flush()
        return np.concatenate(out) if out else np.zeros(0)


class ToxicityModel:
    """A trained network, or a constant where the labels did not hold both classes."""

    def __init__(self, reader: GatedReader | None, constant: float = 0.0):
        self.reader, self.constant = reader, constant

    def score(self, text: Column) -> Column:
        """Score of each whole text between 0 and 1: the highest over all overlapping windows."""
        reader, constant = self.reader, self.constant

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = _Scorer(reader) if reader is not None else None
            for texts in batches:
                yield pd.Series(np.full(len(texts), constant) if scorer is None else scorer.scores(texts).astype(np.float64))
        return scored(text)


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                 rows_per_class: int = 2000, max_chars: int = 20_000, vocabulary: int = 20_000, seed: int = 0) -> ToxicityModel:
    """Trains on a bounded sample: about ``rows_per_class`` labelled documents of each class outside the held-out fifth, none longer than ``max_chars``.

    The vocabulary is the ``vocabulary`` most frequent words (by documents) of the sample; other words are read by their characters alone.
    NULL and empty texts are windows without words and score like any other. Without labels of both classes the score is the only label
    seen, 0 without any. Repeated rows count as often as they occur; labels of one id that differ count as 1. Extra columns are ignored.
    """
    rows = sorted(tuple(r) for r in labelled_sample(documents, labels, label, rows_per_class, max_chars, id_col=id_col, text_col=text_col, seed=seed).collect())
    y = [k for _, k in rows]
    if len(set(y)) < 2:
        return ToxicityModel(None, float(y[0]) if y else 0.0)
    texts = [words_of(t) for t, _ in rows]
    frequent = Counter(w for d in texts for w in set(d))
    known = [w for w, c in sorted(frequent.items(), key=lambda x: (-x[1], x[0])) if c > 4][:vocabulary]
    reader = GatedReader(known, seed=seed)
    reader.fit(texts, y, seed=seed)
    return ToxicityModel(reader)
