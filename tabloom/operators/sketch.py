"""Leading axes of very wide sparse rows by a randomised range finder: passes over the rows, small matrices on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c
from tabloom.session import cut_lineage

OVERSAMPLE = 10
MOST_PASSES = 12
SETTLED = 1e-7               # relative change of the captured energy at which passes end
CELLS = 1 << 20              # numbers of a slice of rows
MOST_ROWS = 128              # rows of a slice, or more where they are short
DENSE = 32                   # rows with a number in every so many places are made dense


def sparse_parts(vector: str) -> list[Column]:
    """Indices and values of a sparse vector column as plain arrays."""
    raw = F.unwrap_udt(c(vector))
    every = F.sequence(F.lit(0), F.size(raw["values"]) - 1)
    return [F.when(raw["type"] == 0, raw["indices"]).otherwise(every).alias("indices"), raw["values"].alias("values")]


def _flat(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of sparse rows, and their indices and values one after another."""
    sizes = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)


def _slices(sizes: np.ndarray, features: int) -> Iterator[tuple[slice, slice, bool]]:
    """Rows, their numbers, and whether they are better made dense, so many at a time that a slice holds about ``CELLS`` numbers."""
    stops = np.append(0, np.cumsum(sizes))
    step = max(MOST_ROWS, CELLS // max(1, features)) if features <= CELLS // MOST_ROWS else MOST_ROWS
    for start in range(0, len(sizes), step):
        end = min(start + step, len(sizes))
        held, cells = int(stops[end] - stops[start]), (end - start) * features
        if held and cells <= CELLS and held * DENSE >= cells:
            yield slice(start, end), slice(int(stops[start]), int(stops[end])), True
            continue
        while held and start < end:
            part = min(end, max(start + 1, int(np.searchsorted(stops, stops[start] + CELLS // 64, side="right")) - 1))
            yield slice(start, part), slice(int(stops[start]), int(stops[part])), False
            start = part


def _dense(sizes: np.ndarray, indices: np.ndarray, values: np.ndarray, features: int) -> np.ndarray:
    out = np.zeros((len(sizes), features))
    out[np.repeat(np.arange(len(sizes)), sizes), indices] = values
    return out


def _sparse_times(sizes: np.ndarray, indices: np.ndarray, values: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out, some = np.zeros((len(sizes), axes.shape[1])), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values[:, None] * axes[indices], (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def times(indices: pa.Array, values: pa.Array, axes: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix; a slice of the rows at a time is worked on."""
    sizes, indices, values = _flat(indices, values)
    out = np.zeros((len(sizes), axes.shape[1]))
    for rows, held, dense in _slices(sizes, len(axes)):
        part = sizes[rows], indices[held], values[held]
        out[rows] = _dense(*part, len(axes)) @ axes if dense else _sparse_times(*part, axes)
    return out


def _there_and_back(axes: np.ndarray):
    """Per task the rows' transpose times (rows times ``axes``), one result row per feature that occurs."""
    width = axes.shape[1]

    def run(batches):
        total, seen = np.zeros(axes.shape), np.zeros(len(axes), bool)
        for batch in batches:
            sizes, indices, values = _flat(batch.column(0), batch.column(1))
            seen[indices] = True
            for rows, held, dense in _slices(sizes, len(axes)):
                some, i, v = sizes[rows], indices[held], values[held]
                if dense:
                    x = _dense(some, i, v, len(axes))
                    total += x.T @ (x @ axes)
                    continue
                back = np.repeat(_sparse_times(some, i, v, axes), some, axis=0) * v[:, None]
                order = np.argsort(i, kind="stable")
                found, first = np.unique(i[order], return_index=True)
                total[found] += np.add.reduceat(back[order], first, axis=0)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"j": some.astype("int32"), **{f"v{i}": total[some, i] for i in range(width)}})
    return run


def leading_axes(df: DataFrame, vector: str, features: int, count: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """``(axes, energies, parts)``: the ``count`` leading right singular vectors of sparse rows, squared singular values, the rows' arrays
    ``indices`` and ``values`` (alone: every pass reads them).

    A pass multiplies every row, a slice of rows at a time, with a ``features x (count + 10)`` sketch and adds up the way back, so a task holds that one matrix and
    ``features`` short rows per task are shuffled. The driver orthogonalises the sum and solves a small eigenproblem; passes repeat until the
    energy of the leading axes settles, 12 at most. Signs make the largest loading positive.
    """
    parts = cut_lineage(df.select(*sparse_parts(vector)))
    width = min(features, count + OVERSAMPLE)
    count = min(count, width)
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
    before = None
    for _ in range(MOST_PASSES):
        schema = ", ".join(["j int", *[f"v{i} double" for i in range(width)]])
        summed = parts.mapInArrow(_there_and_back(axes), schema)
        image = np.zeros(axes.shape)
        for row in summed.groupBy("j").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect():  # features x width numbers
            image[row["j"]] = [row[f"v{i}"] for i in range(width)]
        small = axes.T @ image
        energies, turn = np.linalg.eigh((small + small.T) / 2)
        energies, turn = energies[::-1][:count], turn[:, ::-1][:, :count]
        leading = axes @ turn
        energy = float(energies.sum())
        if width == features or before is not None and abs(energy - before) <= SETTLED * max(energy, 1e-300):
            break
        before, axes = energy, np.linalg.qr(image)[0]
    signs = np.where(leading[np.abs(leading).argmax(axis=0), np.arange(count)] >= 0, 1.0, -1.0)
    return leading * signs, energies, parts
