"""Vector codes: codebooks for parts of integer vectors, trained by Lloyd's rounds that descend a tree of parts and one of entries together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import written
from tabloom.llm.integers import finite, floored, grouped, products, rows_of, totals
from tabloom.llm.vectors import dimension
from tabloom.operators.joins import lookup_join

BLOCK_ROWS, LEAF_ROWS = 4096, 64


class Tree:
    """Balanced boxes over the rows of an integer matrix; ``bounds[l]`` cuts ``order`` into the nodes of level ``l``, halves of those above."""

    def __init__(self, x: np.ndarray, leaf: int, order: np.ndarray | None = None):
        self.bounds = [np.array([0, len(x)])]
        for _ in range(int(np.log2(max(1, len(x) // leaf)))):
            above = self.bounds[-1]
            cuts = np.empty(2 * len(above) - 1, np.int64)
            cuts[::2], cuts[1::2] = above, (above[:-1] + above[1:]) // 2
            self.bounds.append(cuts)
        self.order = self._sorted(x) if order is None else order
        self.x = x[self.order] if order is None else x  # given an order, the rows come in it
        starts = [b[:-1] for b in self.bounds]
        self.low = [np.minimum.reduceat(self.x, s, axis=0) for s in starts]
        self.high = [np.maximum.reduceat(self.x, s, axis=0) for s in starts]
        self.sums = [np.add.reduceat(self.x, s, axis=0) for s in starts]
        self.depth = len(self.bounds) - 1

    def _sorted(self, x: np.ndarray) -> np.ndarray:
        """Rows in the order of the leaves: each node is halved at the median of its widest component."""
        order = np.arange(len(x))
        for above, below in zip(self.bounds, self.bounds[1:]):
            for start, cut, stop in zip(above[:-1], below[1::2], above[1:]):
                some = order[start:stop]
                values = x[some, np.argmax(np.ptp(x[some], axis=0))]
                order[start:stop] = some[np.argpartition(values, cut - start)]
        return order

    def middles(self) -> list[np.ndarray]:
        """Per level, the row of each node that lies nearest to the middle of its box."""
        out = []
        for bounds, low, high in zip(self.bounds, self.low, self.high):
            sizes = np.diff(bounds)
            gaps = np.abs(2 * self.x - np.repeat(low + high, sizes, axis=0)).sum(axis=1)
            order = np.lexsort((gaps, np.repeat(np.arange(len(sizes)), sizes)))
            out.append(order[bounds[:-1]])
        return out


class Codebook:
    """The entries of one part position with their tree."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree = entries, Tree(entries, 1)
        self.middle = [self.tree.x[m] for m in self.tree.middles()]
        self.norms = (entries * entries).sum(axis=1)

    def nearest(self, parts: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """``(nearest entry of every row in tree order, rows and sums of every entry, rows assigned with a whole node)``.

        Pairs of a node of parts and one of entries descend together. A pair is dropped if its boxes are farther apart than the farthest that
        any part of the node can be from the middle entry of another pair: none of its entries is nearest, ties included. A node of parts left
        with a single entry is assigned whole, with its cached sum. At the leaves, the rows are compared with what is left by integers.
        """
        tree = self.tree
        near, whole = np.full(len(parts.x), -1), 0
        counts, sums = np.zeros(len(self.entries), np.int64), np.zeros(self.entries.shape, np.int64)
        q, r, level, deep = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
        while len(q):
            low, high = parts.low[level][q], parts.high[level][q]
            gap = np.maximum(0, np.maximum(low - tree.high[deep][r], tree.low[deep][r] - high))
            middle = self.middle[deep][r]
            reach = np.maximum(np.abs(high - middle), np.abs(middle - low))
            first = np.flatnonzero(np.diff(q, prepend=-1))
            best = np.minimum.reduceat((reach * reach).sum(axis=1), first)
            keep = (gap * gap).sum(axis=1) <= np.repeat(best, np.diff(np.append(first, len(q))))
            q, r = q[keep], r[keep]
            if deep == tree.depth:
                first = np.flatnonzero(np.diff(q, prepend=-1))
                alone = (np.diff(np.append(first, len(q))) == 1) & (np.diff(tree.bounds[deep])[r[first]] == 1)
                for node, entry in zip(q[first[alone]], tree.order[tree.bounds[deep][r[first[alone]]]]):
                    start, stop = parts.bounds[level][node:node + 2]
                    near[start:stop] = entry
                    counts[entry] += stop - start
                    sums[entry] += parts.sums[level][node]
                    whole += int(stop - start)
                left = np.repeat(~alone, np.diff(np.append(first, len(q))))
                q, r = q[left], r[left]
                if level == parts.depth:
                    break
            if deep < tree.depth:
                q, r, deep = np.repeat(q, 2), np.stack([2 * r, 2 * r + 1], axis=1).ravel(), deep + 1
            if level < parts.depth:
                q, r, level = np.concatenate([2 * q, 2 * q + 1]), np.concatenate([r, r]), level + 1
            order = np.argsort(q, kind="stable")
            q, r = q[order], r[order]
        open_rows = []
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        for begin, end in zip(begins, np.append(begins[1:], len(q))):
            start, stop = parts.bounds[parts.depth][q[begin]:q[begin] + 2]
            asked = np.sort(np.concatenate([tree.order[a:b] for a, b in zip(tree.bounds[deep][r[begin:end]], tree.bounds[deep][r[begin:end] + 1])]))
            gaps = self.norms[asked][None] - 2 * products(parts.x[start:stop], self.entries[asked])
            near[start:stop] = asked[gaps.argmin(axis=1)]  # ties: the lower index
            open_rows.append(np.arange(start, stop))
        if open_rows:
            rows = np.concatenate(open_rows)
            found, n, s = grouped(near[rows], parts.x[rows])
            counts[found] += n
            sums[found] += s
        return near, counts, sums, whole


def _blocks(parts: int, size: int):
    """Rows in blocks; of each part position, the rows' order in a tree of the block and the parts in that order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                trees = [Tree(x, LEAF_ROWS) for x in np.split(rows_of(some.column(2), size), parts, axis=1)]
                order = np.stack([t.order for t in trees]).astype("<i4").tobytes()
                data = np.stack([t.x for t in trees]).astype("<i4").tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([order], pa.binary()), pa.array([data], pa.binary())], ["ids", "labels", "orders", "parts"])
    return run


def _trees(orders, data, count: int) -> list[Tree]:
    order = np.frombuffer(orders.as_buffer(), "<i4").reshape(count, -1).astype(np.int64)
    x = np.frombuffer(data.as_buffer(), "<i4").reshape(count, order.shape[1], -1).astype(np.int64)
    return [Tree(part, LEAF_ROWS, rows) for part, rows in zip(x, order)]


def _sums(books: list[Codebook]):
    """Rows and sums of every entry over all blocks of a task; entry -1 carries how many parts were assigned with a whole node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [np.zeros(len(b.entries), np.int64) for b in books], [np.zeros(b.entries.shape, np.int64) for b in books]
        whole = [0] * len(books)
        for batch in batches:
            for orders, data in zip(batch.column(0), batch.column(1)):
                for p, (book, tree) in enumerate(zip(books, _trees(orders, data, len(books)))):
                    _, n, s, w = book.nearest(tree)
                    counts[p] += n
                    sums[p] += s
                    whole[p] += w
        rows = [(p, int(e), int(n[e]), s[e].tolist()) for p, (n, s) in enumerate(zip(counts, sums)) for e in np.flatnonzero(n)]
        rows += [(p, -1, w, [0]) for p, w in enumerate(whole)]
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                         ["part", "entry", "n", "sums"])
    return run


def _coded(books: list[Codebook]):
    digits = np.array([f"{e:02x}" for e in range(max(len(b.entries) for b in books))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, orders, data in zip(*batch.columns):
                codes, error = np.full(len(ids), ""), np.zeros(len(ids), np.int64)
                for book, tree in zip(books, _trees(orders, data, len(books))):
                    near = book.nearest(tree)[0]
                    own, gaps = np.empty(len(near), np.int64), tree.x - book.entries[near]
                    own[tree.order] = near
                    error[tree.order] += (gaps * gaps).sum(axis=1)
                    codes = np.char.add(codes, digits[own])
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes.tolist()), pa.array(error)], ["id", "label", "code", "error"])
    return run


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 4, entries: int = 256,
                     rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Codes vectors by the nearest entry of a codebook for each of ``parts`` equal pieces of the integers ``floor(scale * x)``, exactly.

    Returns, per kept vector, ``(id_col, label_col, code, error, label_error, codebooks_sha256)``: two hexadecimal digits (or more, with more
    entries) per part, the squared distances summed over the parts, that sum over all rows of the label (NULLs together), and the hash of all
    codebooks. Codebooks start as the parts of the ``entries`` smallest ids. A round assigns every part to its nearest entry (ties: lower
    index) and replaces each used entry by the floor of its parts' mean; one more assignment ends it.

    - Vectors are written once in blocks of at most 4,096, with a tree of each part position's rows. Every task descends these trees and that
      of the entries together: bounds between boxes drop whole combinations, a node left with one entry is assigned whole with its cached
      sum, and leaves that stay uncertain are compared by integers. Results do not depend on blocks or trees.
    - Tasks add up their rows and sums per entry before Spark does; the driver holds the codebooks only.

    Vectors that are NULL, empty or hold NULL or non-finite components are left out, as are those of another length than most; zero vectors
    are kept. The commonest length must be a multiple of ``parts``. Repeated rows count as often as they occur; equal ids start by vector,
    rows with a NULL id start last. Components beyond 2^26 after scaling raise an error, for distances must fit 64 bits. With fewer vectors
    than ``entries`` the codebooks are shorter; an empty table gives no rows. Extra columns are ignored.
    """
    types, spark = dict(df.dtypes), df.sparkSession
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite("v"))
    size = dimension(kept, "v")
    if not size:
        schema = f"{id_col} {types[id_col]}, {label_col} {types[label_col]}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return spark.createDataFrame([], schema)
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == size).select("id", "label", floored("v", scale).alias("v"))
    first = np.array([r["v"] for r in kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    books = [Codebook(x) for x in np.split(first, parts, axis=1)]
    kinds = f"ids array<{types[id_col]}>, labels array<{types[label_col]}>, orders binary, parts binary"
    blocks = written(kept.mapInArrow(_blocks(parts, size), kinds), "parts")
    for _ in range(rounds):
        partial = written(blocks.select("orders", "parts").mapInArrow(_sums(books), "part int, entry int, n bigint, sums array<bigint>"), "entries")
        found = totals(partial.where("entry >= 0"), ["part", "entry"])
        after = [b.entries.copy() for b in books]
        for (p, e), (n, s) in found.items():
            after[p][e] = [x // n for x in s]
        books = [Codebook(x) for x in after]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()
    coded = written(blocks.mapInArrow(_coded(books), f"id {types[id_col]}, label {types[label_col]}, code string, error bigint"), "codes")
    coded = coded.withColumn("known", F.col("label").isNotNull()).withColumn("name", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = coded.groupBy("known", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    out = lookup_join(coded, sums, ["known", "name"], "rows")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
