"""Approximate nearest neighbours by inner product: an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.llm.common import written
from tabloom.llm.vectors import blocks, dimension, kmeans, matrix, nearest, prepared, sample


CELL_ROWS = 32  # vectors in a cell, on average, as long as there are at most 128 x 128 cells


class MultiIndex:
    """Two codebooks; a cell is a pair of centroids. ``spread`` is the mean squared residual per component of each centroid."""

    def __init__(self, x: np.ndarray, centroids: int, seed: int):
        self.cut = (x.shape[1] + 1) // 2
        self.books, self.spread = [], []
        for k, half in enumerate((x[:, :self.cut], x[:, self.cut:])):
            if not half.shape[1]:
                self.books.append(np.zeros((1, 0)))
                self.spread.append(np.zeros(1))
                continue
            book = kmeans(half, centroids, seed + k)
            home = nearest(half, book)
            squares = ((half - book[home]) ** 2).mean(axis=1)
            sums, often = np.bincount(home, squares, len(book)), np.bincount(home, minlength=len(book))
            overall = squares.mean() if len(squares) else 0.0
            self.books.append(book)
            self.spread.append((sums + overall) / (often + 1))  # a centroid with few vectors leans on all of them
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = nearest(x[:, :self.cut], self.books[0]), nearest(x[:, self.cut:], self.books[1])
        return one * len(self.books[1]) + two

    def traverse(self, query: np.ndarray, k: int, share: float) -> list[int]:
        """Cells in order of summed inner products of their centroids, from a heap, until they should hold ``share`` of the k best.

        How many entries of a cell beat the k-th best follows from its number of entries, its centroids' inner product and the spread of
        its residuals, taken as normal; the k-th best itself is where those expectations add up to k over all cells.
        """
        halves = query[:self.cut], query[self.cut:]
        near = [book @ half for book, half in zip(self.books, halves)]
        varied = [(half ** 2).sum() * spread for half, spread in zip(halves, self.spread)]
        centre = near[0][:, None] + near[1][None, :]
        width = np.sqrt(varied[0][:, None] + varied[1][None, :]) + 1e-12
        filled = self.counts > 0
        at, scale, n = centre[filled], width[filled], self.counts[filled].astype(float)

        def beyond(level):  # close to the normal tail
            return n / (1 + np.exp(np.clip(1.702 * (level - at) / scale, -50, 50)))
        low, high = at.min() - 8 * scale.max(), at.max() + 8 * scale.max()
        for _ in range(24):
            level = (low + high) / 2
            low, high = (level, high) if beyond(level).sum() > k else (low, level)
        expected = np.zeros(self.counts.shape)
        expected[filled] = beyond(low)
        wanted, found, entries, out = share * expected.sum(), 0.0, 0, []
        rows, cols = np.argsort(-near[0], kind="stable"), np.argsort(-near[1], kind="stable")
        top, side = near[0][rows].tolist(), near[1][cols].tolist()
        heap, reached = [(-(top[0] + side[0]), 0, 0)], [0] * len(rows)
        total = int(self.counts.sum())
        while heap and entries < total and (found < wanted or entries <= k):
            _, i, j = heapq.heappop(heap)
            row, col = rows[i], cols[j]
            if self.counts[row, col]:
                out.append(int(row) * len(cols) + int(col))
                found += expected[row, col]
                entries += int(self.counts[row, col])
            reached[i] = j + 1
            # a pair enters the heap when both its predecessors have left it
            if i + 1 < len(rows) and (j == 0 or reached[i + 1] >= j) and reached[i + 1] <= j:
                heapq.heappush(heap, (-(top[i + 1] + side[j]), i + 1, j))
            if j + 1 < len(cols) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-(top[i] + side[j + 1]), i, j + 1))
        return out


def _celled(index: MultiIndex, dtype: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(matrix(batch.column(1), dtype, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int64())], ["id", "vector", "cell"])
    return run


def _probed(index: MultiIndex, first: np.ndarray, number: np.ndarray, k: int, share: float, dtype: str, size: int):
    """One row per query and block that holds a cell of its traversal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, targets, lists = [], [], []
                for row, query in enumerate(matrix(part.column("vector"), dtype, size)):
                    cells = np.array(index.traverse(query, k, share), np.int64)
                    spread = np.repeat(cells, number[cells])
                    block = first[spread] + np.concatenate([np.arange(number[c]) for c in cells])
                    order = np.argsort(block, kind="stable")
                    begins = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
                    for got in np.split(order, begins[1:]):
                        rows.append(row)
                        targets.append(int(block[got[0]]))
                        lists.append(np.sort(spread[got]))
                take = pa.array(rows, pa.int64())
                cells = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("vector").take(take), part.column("asking").take(take),
                                                  pa.array(targets, pa.int64()), cells], ["id", "vector", "asking", "asked", "cells"])
    return run


def _reranked(k: int, dtype: str, size: int):
    """Best k of a block for each of its queries, by exact inner products of the entries in probed cells."""
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        kind = entries.schema.field("id").type
        ids = np.array(entries.column("id").to_pylist(), dtype=object)
        asked = np.array(queries.column("id").to_pylist(), dtype=object)
        q, x = matrix(queries.column("vector"), dtype, size), matrix(entries.column("vector"), dtype, size)
        cells, place = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
        wanted = queries.column("cells").to_pylist()
        out = [], [], []
        for start in range(0, len(q), 256):
            part = q[start:start + 256]
            probed = np.stack([np.isin(cells, w) for w in wanted[start:start + 256]])
            near = np.where(probed[:, place], part @ x.T, -np.inf)
            near[asked[start:start + 256, None] == ids[None, :]] = -np.inf
            cut = -np.partition(-near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(part), -np.inf)
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
            for row in range(len(part)):
                some = np.flatnonzero((near[row] >= cut[row] - slack[row]) & np.isfinite(near[row]))
                score = (x[some] * part[row]).sum(axis=1)  # one way of adding up, so that equal vectors tie
                best = sorted(zip(-score, ids[some]))[:k]
                out[0].extend([asked[start + row]] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(-s for s, _ in best)
        return pa.table({"query_id": pa.array(out[0], kind), "id": pa.array(out[1], kind), "score": pa.array(out[2], pa.float64())})
    return run


def nearest_vectors(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, share: float = 0.98,
                    training_rows: int = 20_000, block_rows: int = 8192, seed: int = 0) -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``queries`` holds, by largest inner product: ``(query_id, rank, id_col, score)``.

    1. k-means on about ``training_rows`` vectors gives a codebook for each half; every row lies in the cell of its two centroids, and a
       table of at most 128 x 128 counts goes to the driver. Cells are laid in blocks of about ``block_rows`` rows, a hot cell in several.
    2. Each query walks over pairs of centroids by summed inner product with a heap until the cells seen should hold ``share`` of its k
       best (see ``MultiIndex.traverse``): more cells where the vectors are spread evenly, few where they are clustered.
    3. Queries of neighbouring blocks meet a block together; it returns the k best by exact inner product, and these are ranked.

    Of equal vectors only the k + 1 rows with the smallest ids can be among the results, so only they are indexed: a third of all rows
    being one vector costs k + 1 rows. Recall is approximate (see the tests), scores and their order are exact; ties go to the smaller id.
    With fewer than k other rows all are returned. Vectors that are NULL, zero, of another length than most, or hold NULL or non-finite
    components take no part, nor do rows with a NULL id. Rows that repeat an id are one candidate. Extra columns are ignored.
    """
    kind, size = dict(df.dtypes)[id_col], dimension(df, vector_col)
    schema = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    if not size:
        return df.sparkSession.createDataFrame([], schema)
    vectors, dtype = prepared(df, id_col, vector_col, size)
    chosen = df.where(queries & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    asking = vectors.join(chosen, "id", "left_semi").dropDuplicates(["id", "key"])
    order = Window.partitionBy("key").orderBy("id")
    entries = vectors.distinct().withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    entries = written(entries.select("id", "key", "vector"), "entries")
    total = entries.count()
    index = MultiIndex(sample(entries, total, training_rows, dtype, size, seed), int(np.clip(np.sqrt(total / CELL_ROWS), 1, 128)), seed)
    celled = written(entries.select("id", "vector").mapInArrow(_celled(index, dtype, size), f"id {kind}, vector binary, cell bigint"), "cells")
    for row in celled.groupBy("cell").agg(F.count("*").alias("n")).collect():  # no more than pairs of centroids
        index.counts.flat[row["cell"]] = row["n"]
    first, number = blocks(index.counts.ravel(), range(index.counts.size), block_rows)
    starts, widths = (F.lit(a.tolist()) for a in (first, number))
    cell = F.col("cell").cast("int") + 1
    entries = celled.withColumn("block", (F.element_at(starts, cell) + F.pmod(F.xxhash64("id"), F.element_at(widths, cell))).cast("long"))
    asking = asking.select("id", "vector").mapInArrow(_celled(index, dtype, size), f"id {kind}, vector binary, cell bigint")
    asking = asking.withColumn("asking", F.floor(F.element_at(starts, cell) / 16).cast("long")).select("id", "vector", "asking")
    asking = asking.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "id")
    probes = written(asking.mapInArrow(_probed(index, first, number, k, share, dtype, size),
                                       f"id {kind}, vector binary, asking bigint, asked bigint, cells array<bigint>"), "probes")
    met = probes.select(F.col("asking").alias("asker"), F.col("asked").alias("block")).distinct()
    found = probes.groupBy("asking", "asked").cogroup(entries.join(met, "block").groupBy("asker", "block")).applyInArrow(
        _reranked(k, dtype, size), f"query_id {kind}, id {kind}, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
