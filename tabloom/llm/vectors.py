"""What the vector operators share: usable vectors, k-means on a bounded sample, blocks of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import hash_share, written


def usable(vector: str, size: int) -> Column:
    """True for vectors of ``size`` finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, vector_col: str) -> int:
    """The commonest length of the vectors (the smaller one of ties), 0 without vectors."""
    top = df.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return top["size"] if top else 0


def _raw(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype) + np.zeros(1, dtype)  # no negative zeros
            size = len(flat) // max(1, len(lists))
            rows = [flat[k * size:(k + 1) * size].tobytes() for k in range(len(lists))]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["id", "key", "vector"])
    return run


def prepared(df: DataFrame, id_col: str, vector_col: str, size: int) -> tuple[DataFrame, str]:
    """``(id, key, vector)`` of usable vectors with an id, written: a digest and the raw bytes. Also the numpy type of the bytes."""
    types = dict(df.dtypes)
    dtype = "<f4" if types[vector_col] == "array<float>" else "<f8"
    good = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v", size))
    return written(good.mapInArrow(_raw(dtype), f"id {types[id_col]}, key binary, vector binary"), "vectors"), dtype


def matrix(column, dtype: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, size).astype(np.float64)


def sample(vectors: DataFrame, total: int, rows: int, dtype: str, size: int, seed: int) -> np.ndarray:
    """About ``rows`` vectors, the same on every run."""
    picked = vectors.where(hash_share(F.col("key"), min(1.0, rows / max(1, total)), seed)).select("key", "vector").collect()
    return np.array([np.frombuffer(v, dtype) for _, v in sorted((bytes(r["key"]), bytes(r["vector"])) for r in picked)], np.float64).reshape(-1, size)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres ** 2).sum(axis=1)
    return np.concatenate([(x[k:k + 8192] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, count: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of at most ``count`` clusters; one zero vector for an empty sample."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        home = nearest(x, centres)
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.append(True, home[order][1:] != home[order][:-1]))
        sums = np.add.reduceat(x[order], first)
        centres = centres.copy()
        centres[home[order][first]] = sums / np.diff(np.append(first, len(x)))[:, None]
    return centres


def chained(centres: np.ndarray) -> np.ndarray:
    """An order in which each centre follows its nearest one not yet taken, so that neighbours get into the same block."""
    left, order = list(range(1, len(centres))), [0]
    while left:
        gaps = ((centres[left] - centres[order[-1]]) ** 2).sum(axis=1)
        order.append(left.pop(int(gaps.argmin())))
    return np.array(order)


def blocks(counts: Sequence[int], order: Sequence[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of every cell and its number of blocks: cells in order fill blocks of about ``rows`` rows, a larger cell gets several."""
    first, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block, filled = 0, 0
    for cell in order:
        if filled and filled + counts[cell] > rows:
            block, filled = block + 1, 0
        first[cell] = block
        if counts[cell] > rows:
            number[cell] = -(-int(counts[cell]) // rows)
            block, filled = block + int(number[cell]), 0
        else:
            filled += int(counts[cell])
    return first, number
