"""What the operators on integer vectors share: quantised components, exact distances, sums by group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LARGEST = 1 << 26  # components beyond would not leave room for a squared distance in 64 bits


def finite(vector: str) -> Column:
    """True for vectors without NULL or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as BIGINT."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def rows_of(lists: pa.ListArray, size: int) -> np.ndarray:
    """An integer matrix from a column of equally long lists."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and max(-int(flat.min()), int(flat.max())) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling leave no room for distances in 64 bits")
    return flat.reshape(-1, size)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of integer matrices, exact: in floating point only where every partial sum is below 2^53."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if int(np.abs(x).max()) * int(np.abs(y).max()) * x.shape[1] < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of ``x`` and of ``y``."""
    return (x * x).sum(axis=1)[:, None] - 2 * products(x, y) + (y * y).sum(axis=1)[None]


def grouped(groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups that occur, their numbers of rows and the sums of their rows."""
    order = np.argsort(groups, kind="stable")
    found, first = np.unique(groups[order], return_index=True)
    if not len(found):
        return found, first, np.zeros((0, x.shape[1]), np.int64)
    return found, np.diff(np.append(first, len(groups))), np.add.reduceat(x[order], first, axis=0)


def totals(partial: DataFrame, keys: Sequence[str]) -> dict[tuple, tuple[int, list[int]]]:
    """Sums of partial rows ``(keys…, n, sums)``, added up by Spark; as many results as there are groups, whatever the rows."""
    counts = partial.groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    cells = partial.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    sums: dict[tuple, dict[int, int]] = {}
    for row in cells.collect():
        sums.setdefault(tuple(row[k] for k in keys), {})[row["at"]] = int(row["x"])
    return {key: (row["n"], [sums[key][at] for at in sorted(sums[key])]) for row in counts for key in [tuple(row[k] for k in keys)] if key in sums}
