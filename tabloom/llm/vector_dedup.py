"""Embedding near-duplicates: inverted lists, product quantisation of residuals, exact cosine of what the codes leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import components, written
from tabloom.llm.vectors import blocks, chained, dimension, kmeans, matrix, nearest, prepared, sample

SUBSPACES, CODES = 8, 256
ROUNDING = 1e-9  # what bounds allow for sums in another order


class Quantiser:
    """Coarse centres, and codebooks of the subspaces of residuals, of unit vectors."""

    def __init__(self, units: np.ndarray, lists: int, seed: int):
        self.centres = kmeans(units, lists, seed)
        residuals = (units - self.centres[nearest(units, self.centres)])[:10_000]
        self.parts = [p for p in np.array_split(np.arange(units.shape[1]), SUBSPACES) if len(p)]
        self.books = [kmeans(residuals[:, p], CODES, seed + 1, rounds=6) for p in self.parts]
        norms = (self.centres ** 2).sum(axis=1)
        self.gaps = np.sqrt(np.maximum(0, norms[:, None] + norms[None] - 2 * self.centres @ self.centres.T))
        # how much of the vectors' spread around their centres lies along the line between two centres, as a standard deviation
        around = units - self.centres[nearest(units, self.centres)]
        along = np.maximum(0, self.centres @ (around.T @ around) @ self.centres.T)
        between = np.maximum(0, np.diag(along)[:, None] + np.diag(along)[None] - along - along.T)
        self.spread = np.sqrt(between / max(float((around ** 2).sum()), 1e-300)) / np.where(self.gaps > 0, self.gaps, np.inf)

    def encode(self, units: np.ndarray):
        """List, codes, length of what the codes lose, and the part of the table distance that needs no query."""
        home = nearest(units, self.centres)
        residuals = units - self.centres[home]
        codes = np.stack([nearest(residuals[:, p], book) for p, book in zip(self.parts, self.books)], axis=1)
        decoded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        lost = np.sqrt(((residuals - decoded) ** 2).sum(axis=1))
        return home, codes.astype(np.uint8), lost, 2 * (self.centres[home] * decoded).sum(axis=1) + (decoded ** 2).sum(axis=1)

    def probes(self, units: np.ndarray, home: np.ndarray, reach: float, slack: float | None) -> np.ndarray:
        """Lists behind whose bisecting plane a vector within ``reach`` can lie: (rows, lists).

        With ``slack``, the part of the way along the plane's normal is at most so many standard deviations of what it is in the sample.
        """
        far = np.maximum(0, (units ** 2).sum(axis=1)[:, None] - 2 * units @ self.centres.T + (self.centres ** 2).sum(axis=1)[None])
        gaps = self.gaps[home]
        beyond = far - far[np.arange(len(units)), home][:, None]
        share = 1.0 if slack is None else np.minimum(1.0, slack * self.spread[home])
        return (beyond <= 2 * reach * share * gaps + ROUNDING) | (gaps == 0)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def _homed(quantiser: Quantiser, dtype: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = nearest(_units(matrix(batch.column(2), dtype, size)), quantiser.centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home, pa.int64()), batch.column(2)], ["node", "copies", "home", "vector"])
    return run


def _routed(quantiser: Quantiser, first: np.ndarray, number: np.ndarray, reach: float, slack: float | None, dtype: str, size: int):
    """Adds the blocks, from the vector's own on, that hold the lists it probes: of two blocks the first asks the second, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                units = _units(matrix(part.column("vector"), dtype, size))
                wanted = quantiser.probes(units, part.column("home").to_numpy(), reach, slack)
                lists = [np.unique(np.concatenate([np.arange(first[c], first[c] + number[c]) for c in np.flatnonzero(row)])) for row in wanted]
                lists = [t[t >= own] for t, own in zip(lists, part.column("block").to_numpy())]
                targets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "copies", "home", "block", "vector")), targets],
                                                 ["node", "copies", "home", "block", "vector", "targets"])
    return run


def _block_links(quantiser: Quantiser, threshold: float, slack: float | None, dtype: str, size: int):
    """Links between the queries and the entries of one pair of blocks: weighted counts per query, and edges that span them."""
    radius = float(np.sqrt(2 - 2 * threshold))

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        kind = entries.schema.field("node").type
        entries = entries.sort_by("home")
        asked, held = (np.array(t.column("node").to_pylist(), dtype=object) for t in (queries, entries))
        names, code = np.unique(np.concatenate([asked, held]), return_inverse=True)
        asked, held = code[:len(asked)], code[len(asked):]
        q, x = matrix(queries.column("vector"), dtype, size), matrix(entries.column("vector"), dtype, size)
        q_unit, x_unit = _units(q), _units(x)
        copies, q_copies = entries.column("copies").to_numpy(), queries.column("copies").to_numpy()
        other = queries.num_rows > 0 and queries.column("asking")[0].as_py() != queries.column("asked")[0].as_py()
        home, codes, lost, fixed = quantiser.encode(x_unit)
        order = np.argsort(home, kind="stable")
        home, codes, lost, fixed, held, x_unit, copies = (a[order] for a in (home, codes, lost, fixed, held, x_unit, copies))
        lists, begins = np.unique(home, return_index=True)
        ends = np.append(begins[1:], len(home))
        limit = (radius + lost) ** 2 + ROUNDING
        counts, held_counts, edges = np.zeros(len(asked), np.int64), np.zeros(len(held), np.int64), []
        label = np.arange(len(names))
        for start in range(0, len(q), 256):
            part = q_unit[start:start + 256]
            wanted = quantiser.probes(part, nearest(part, quantiser.centres), radius, slack)[:, lists]
            tables = [part[:, p] @ book.T for p, book in zip(quantiser.parts, quantiser.books)]
            far = (part ** 2).sum(axis=1)[:, None] - 2 * part @ quantiser.centres[lists].T + (quantiser.centres[lists] ** 2).sum(axis=1)[None]
            rows, cols = [], []
            for k, (begin, end) in enumerate(zip(begins, ends)):
                some = np.flatnonzero(wanted[:, k])
                if not len(some):
                    continue
                looked = sum(table[some][:, codes[begin:end, m]] for m, table in enumerate(tables))
                left = far[some, k][:, None] - 2 * looked + fixed[None, begin:end] <= limit[None, begin:end]
                if left.any():  # one product sorts out most of what the codes leave
                    left &= part[some] @ x_unit[begin:end].T >= threshold - ROUNDING
                i, j = np.nonzero(left)
                rows.append(some[i])
                cols.append(j + begin)
            i, j = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (rows, cols))
            exact = np.concatenate([(part[i[k:k + 65536]] * x_unit[j[k:k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            good = (exact >= threshold) & (asked[start + i] != held[j])
            i, j = i[good], j[good]
            np.add.at(counts, start + i, copies[j])
            if other:  # the second block does not ask the first
                np.add.at(held_counts, j, q_copies[start + i])
            left, right = asked[start + i], held[j]
            before = label.copy()
            while len(left):
                was = label.copy()
                np.minimum.at(label, left, label[right])
                np.minimum.at(label, right, label[left])
                label = label[label]
                if (was == label).all():
                    break
            moved = np.flatnonzero(before != label)
            edges.append(np.unique(np.stack([before[moved], label[moved]], axis=1), axis=0))
        edges = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        some, back = np.flatnonzero(counts), np.flatnonzero(held_counts)
        a = pa.array(names[np.concatenate([asked[some], held[back], edges[:, 0]])].tolist(), kind)
        b = pa.array([None] * (len(some) + len(back)) + names[edges[:, 1]].tolist(), kind)
        return pa.table({"a": a, "b": b, "n": pa.array(np.concatenate([counts[some], held_counts[back], np.zeros(len(edges), np.int64)]), pa.int64())})
    return run


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.9, slack: float | None = 4.5,
                           training_rows: int = 20_000, block_rows: int = 8192, seed: int = 0) -> DataFrame:
    """Links vectors whose cosine is ``threshold`` or more: ``(id_col, n_links, component_id, kept)``, one row per input row.

    1. Equal vectors are one class (a grouped minimum and count); the class is compared once.
    2. k-means on about ``training_rows`` vectors gives the coarse lists and the codebooks of their residuals; every vector is coded. Lists
       are laid in blocks of about ``block_rows`` rows, a hot list in several.
    3. A vector goes to the blocks that hold a list it probes, and is compared by table look-ups with the codes of the probed lists;
       what the codes do not rule out is verified by the exact cosine in double precision.
    4. A pair of blocks returns counts and edges that span its links, never all pairs; components join the edges.

    Code distances are bounded by the triangle inequality and miss no pair. Probes allow for ``slack`` standard deviations along the line
    between two centres, of which the sample's covariance says how much of a difference lies along it: vectors that vary in few directions
    probe wider along these. Tests find every link of isotropic and of low-rank vectors; with ``slack=None`` probes are bounded by the triangle
    inequality too, whatever the vectors, and most lists are probed.

    Vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components link with nothing and are kept; so do
    rows with a NULL id (their component is NULL). Repeated rows are links of each other. Extra columns are ignored.
    """
    kind, size = dict(df.dtypes)[id_col], dimension(df, vector_col)
    everyone = df.select(F.col(id_col).alias("id"))
    if not size:
        return everyone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    vectors, dtype = prepared(df, id_col, vector_col, size)
    classes = written(vectors.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "classes")
    nodes = vectors.select("key", F.col("id").alias("node"), "vector").join(classes, ["key", "node"], "left_semi").dropDuplicates(["key"])
    nodes = nodes.join(classes.select("key", "copies"), "key").select("node", "copies", "vector", "key")
    total = classes.count()
    raw = sample(nodes, total, training_rows, dtype, size, seed)
    quantiser = Quantiser(_units(raw) if len(raw) else raw, int(np.clip(np.sqrt(total), 1, 1024)), seed)
    homed = written(nodes.select("node", "copies", "vector").mapInArrow(_homed(quantiser, dtype, size), f"node {kind}, copies bigint, home bigint, vector binary"), "homed")
    counted = {r["home"]: r["n"] for r in homed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # no longer than the lists
    first, number = blocks([counted.get(k, 0) for k in range(len(quantiser.centres))], chained(quantiser.centres), block_rows)
    reach = float(np.sqrt(2 - 2 * threshold))

    starts, widths = (F.array(*[F.lit(int(x)) for x in a]) for a in (first, number))
    block = F.element_at(starts, F.col("home").cast("int") + 1) + F.pmod(F.xxhash64("node"), F.element_at(widths, F.col("home").cast("int") + 1))
    placed = homed.withColumn("block", block.cast("long"))
    routed = placed.mapInArrow(_routed(quantiser, first, number, reach, slack, dtype, size),
                               f"node {kind}, copies bigint, home bigint, block bigint, vector binary, targets array<bigint>")
    queries = routed.select("node", "copies", "vector", F.col("block").alias("asking"), F.explode("targets").alias("asked"))
    met = routed.select(F.col("block").alias("asking"), F.explode("targets").alias("asked")).distinct()
    entries = placed.select("node", "copies", "home", "vector", F.col("block").alias("asked")).join(met, "asked")
    found = queries.groupBy("asking", "asked").cogroup(entries.groupBy("asking", "asked")).applyInArrow(
        _block_links(quantiser, threshold, slack, dtype, size), f"a {kind}, b {kind}, n bigint")
    found = written(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    classes = classes.join(counts, "node", "left").join(joined, "node", "left")
    known = vectors.select("id", "key").distinct().join(classes, "key").groupBy("id").agg(
        F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.min(F.coalesce("component", "node")).alias("component"))
    out = everyone.join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
