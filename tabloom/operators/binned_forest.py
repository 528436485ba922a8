"""Feature importances of a random forest from one pass over the rows.

A forest of the ML library looks at binned features alone, so all it learns about a tree's bootstrap sample is, for every combination of bins,
the sums of its rows' weights (and of their labels and squared labels, or of each class). With few features there are few combinations: the
tasks draw every row's Poisson weight for every tree and add these sums up, and the trees are then grown from them, a task a tree, by the
library's own rules: the same candidate thresholds, features drawn per node, gains, limits and merged equal leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabloom.session import cut_lineage

BINS = 32                    # the tree learner's own number of bins of a feature
SPLIT_ROWS = 10_000          # rows from which the tree learner takes its thresholds
MOST_SUMS = 1 << 17          # sums of a tree that a task holds for every tree
CHUNK = 1 << 16              # rows whose weights are drawn at once


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between all values, or about ``bins`` parts with equally many rows."""
    found, counts = np.unique(values + 0.0, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle
    reached, target, out = np.cumsum(counts), len(values) / bins, []
    stride = target
    for i in range(len(middle)):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            out.append(middle[i])
            target += stride
    return np.array(out)


class _Poisson:
    """Weights of mean 1 by the inverse of their distribution; a table of the upper 16 bits decides nearly all of them."""

    def __init__(self) -> None:
        self.ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(14)]) * 2.0 ** 32
        first, last = (np.searchsorted(self.ends, np.arange(1 << 16) * 65536.0 + part, side="right") for part in (0, 65535))
        self.table = np.where(first == last, first, 255).astype(np.uint8)

    def draw(self, rng: np.random.Generator, rows: int) -> np.ndarray:
        bits = rng.integers(0, 1 << 32, rows, dtype=np.uint32)
        weight = self.table[bits >> 16]
        open_ = np.flatnonzero(weight == 255)
        weight[open_] = np.searchsorted(self.ends, bits[open_], side="right")
        return weight.astype(float)


@dataclass
class BinnedSums:
    """(tree, sums) of every tree: for each statistic the cells of all combinations of bins."""

    table: DataFrame
    shape: tuple[int, ...]
    classes: int | None
    seed: int

    def importances(self, features: list[int], depth: int) -> list[float]:
        """Importances of a forest of these features alone; the other features' bins are added together."""
        shape, classes, seed = self.shape, self.classes, self.seed
        stats = classes or 3

        def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for tree, sums in zip(batch["tree"], batch["sums"]):
                    cells = np.frombuffer(sums).reshape(stats, *shape)
                    cells = cells.sum(axis=tuple(i + 1 for i in range(len(shape)) if i not in features))
                    rng = np.random.default_rng([seed & 0xFFFFFFFF, int(tree)])
                    yield pd.DataFrame({"tree": [tree], "gains": [_Tree(cells, classes, depth, rng).gains.tolist()]})

        found = self.table.repartition("tree").mapInPandas(grown, "tree int, gains array<double>").collect()
        total = np.zeros(len(features))
        for row in sorted(found, key=lambda r: r["tree"]):
            gains = np.array(row["gains"])
            total += gains / gains.sum() if gains.sum() > 0 else gains
        return (total / total.sum() if total.sum() > 0 else total).tolist()


class _Tree:
    """``gains``: gain times weight of the splits by each feature, without splits between leaves that predict the same."""

    def __init__(self, cells: np.ndarray, classes: int | None, depth: int, rng: np.random.Generator):
        self.classes, self.depth, self.rng, self.sizes = classes, depth, rng, cells.shape[1:]
        flat = cells.reshape(len(cells), -1)
        some = np.flatnonzero(flat.any(axis=0))
        self.bins, self.sums = np.unravel_index(some, self.sizes), flat[:, some]
        count = len(self.sizes)
        self.drawn = math.ceil(math.sqrt(count)) if classes else math.ceil(count / 3)
        self.gains = np.zeros(count)
        if len(some):
            self.gains = self._grow(np.arange(len(some)), 0)[1]

    def _weight(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(axis=0) if self.classes else sums[0]

    def _impurity(self, sums: np.ndarray) -> np.ndarray:
        """Gini impurity or variance, of one node or of one a column."""
        weight = self._weight(sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.classes:
                return 1.0 - ((sums / weight) ** 2).sum(axis=0)
            return (sums[2] - sums[1] * sums[1] / weight) / weight

    def _grow(self, rows: np.ndarray, level: int) -> tuple[float | None, np.ndarray]:
        """(prediction of a leaf or None, gains)."""
        total = self.sums[:, rows].sum(axis=1)
        weight, impurity = float(self._weight(total)), float(self._impurity(total))
        prediction = float(total.argmax()) if self.classes else float(total[1] / weight)
        none = np.zeros(len(self.sizes))
        if level >= self.depth or (level and abs(impurity) < np.finfo(float).eps):
            return prediction, none
        best = (0.0, -1, -1)
        for f in self.rng.choice(len(self.sizes), self.drawn, replace=False):
            if self.sizes[f] < 2:
                continue
            place = self.bins[f][rows]
            left = np.cumsum([np.bincount(place, s[rows], self.sizes[f]) for s in self.sums], axis=1)[:, :-1]
            right = total[:, None] - left
            lw, rw = self._weight(left), self._weight(right)
            with np.errstate(invalid="ignore"):
                gain = impurity - lw / weight * self._impurity(left) - rw / weight * self._impurity(right)
            gain = np.where((lw >= 1) & (rw >= 1), gain, -np.inf)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = float(gain[at]), int(f), at
        if best[1] < 0:
            return prediction, none
        gain, f, at = best
        side = self.bins[f][rows] <= at
        one, two = self._grow(rows[side], level + 1), self._grow(rows[~side], level + 1)
        if one[0] is not None and one[0] == two[0]:
            return one[0], none
        none[f] = gain * weight
        return None, none + one[1] + two[1]


def binned_sums(table: DataFrame, features: int, rows: int, classes: int | None, trees: int, seed: int) -> BinnedSums | None:
    """The sums of all trees' bootstrap samples of ``(features, label)``, or None where the combinations of bins are too many."""
    bins = min(BINS, rows)
    wanted = max(bins * bins, SPLIT_ROWS)
    chosen = table if wanted >= rows else table.sample(False, wanted / rows, seed)
    sample = np.array([r[0].toArray() for r in chosen.select("features").collect()], dtype=float).reshape(-1, features)
    cuts = [thresholds(sample[:, i], bins) for i in range(features)]
    shape = tuple(len(t) + 1 for t in cuts)
    stats, cells = classes or 3, math.prod(shape)
    if cells * stats > MOST_SUMS:
        return None

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, poisson = TaskContext.get().partitionId(), _Poisson()
        rng = np.random.default_rng([seed & 0xFFFFFFFF, part])
        sums, held, filled = np.zeros((trees, stats * cells)), [], 0

        def add() -> None:
            x = np.concatenate([h[0] for h in held])
            y = np.concatenate([h[1] for h in held])
            place = np.zeros(len(x), dtype=np.int64)
            for f, cut in enumerate(cuts):
                place = place * shape[f] + np.searchsorted(cut, x[:, f], side="left")
            if classes:
                place += y.astype(np.int64) * cells
            for t in range(trees):
                weight = poisson.draw(rng, len(x))
                if classes:
                    sums[t] += np.bincount(place, weight, stats * cells)
                    continue
                for s in range(3):
                    sums[t, s * cells:(s + 1) * cells] += np.bincount(place, weight, cells)
                    weight *= y

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isfinite(y).all():
                raise ValueError("Labels MUST NOT be NULL, NaN or Infinity.")
            held.append((x, y))
            filled += len(y)
            if filled >= CHUNK:
                add()
                held, filled = [], 0
        if filled:
            add()
        if sums.any():
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([part], pa.int32()), pa.array([sums[t].tobytes()], pa.binary())],
                                                 ["tree", "part", "sums"])

    def together(parts: pd.DataFrame) -> pd.DataFrame:
        parts, total = parts.sort_values("part"), np.zeros(stats * cells)
        for one in parts["sums"]:
            total += np.frombuffer(one)
        return pd.DataFrame({"tree": parts["tree"].iloc[:1].to_numpy(), "sums": [total.tobytes()]})

    slim = table.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    # a task returns all cells of all trees, so there are no more tasks than work at once
    slim = slim.coalesce(2 * table.sparkSession.sparkContext.defaultParallelism)
    added_up = slim.mapInArrow(added, "tree int, part int, sums binary").groupBy("tree").applyInPandas(together, "tree int, sums binary")
    return BinnedSums(cut_lineage(added_up), shape, classes, seed)
