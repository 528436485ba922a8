"""Nearest rows of a table with gaps: distances over the features that two rows share, in one block join over all patterns of gaps.

Donors are placed in cells around pivots; a cell's ranges and known counts bound the distance between a row and any donor in it from below
and from above, whatever donors leave out. A row with gaps meets only the cells that can hold one of its k nearest donors of a feature.
Rows and donors meet in blocks of bounded size, where all distances come from matrix products of values, squares and masks.

Where a table has few patterns of gaps, rows of one pattern share the same features with all donors of another. Then donors of a pattern are
points over these shared features alone, of which only the k smallest ids per point count, and every such table is cut by halving it along
its widest feature: a row meets the few cells that its k nearest points may lie in, whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c
from tabloom.operators.neighbours import squares_in_block
from tabloom.session import cut_lineage

BLOCK = 2_000                # rows per side of one distance block
MAX_PIVOTS = 256
ROUTED = 256                 # rows whose bounds are worked out at once
MAX_PATTERNS = 64            # patterns of gaps up to which each pair of them is one table of points
MAX_TABLES = 256             # such tables
MAX_COPIES = 8               # tables a row stands in, on average
LEAF = 64                    # points of a leaf, by whose box the nearest ones are bounded
MAX_LEAVES = 16_384          # leaves of all tables, held by the driver
DRAWN = 131_072              # points by which tables are halved
ROUTE_CELLS = 1_000_000      # numbers held at once while boxes are compared


class Cells:
    """Ranges and known counts of the donors of every cell."""

    def __init__(self, size: np.ndarray, known: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.known, self.low, self.high = known, np.nan_to_num(low), np.nan_to_num(high)
        self.always, self.ever = known == size[:, None], known > 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row and cell the least and the largest squared distance to a donor that shares a feature, and whether every donor does.

        The features a donor shares with the row hold all that the cell always knows and any of those it sometimes knows, so the extreme
        means over such sets bound the mean over the true one.
        """
        mine = ~np.isnan(x)
        value = np.where(mine, x, 0.0)[:, None, :]
        gap = np.maximum(np.maximum(self.low - value, value - self.high), 0.0) ** 2
        far = np.maximum(np.abs(value - self.low), np.abs(value - self.high)) ** 2
        fixed, free = mine[:, None, :] & self.always, mine[:, None, :] & (self.ever & ~self.always)
        count = fixed.sum(axis=2)

        def extreme(square: np.ndarray, sign: float) -> np.ndarray:
            rest = np.sort(np.where(free, sign * square, np.inf), axis=2)
            total = np.concatenate([(sign * np.where(fixed, square, 0.0)).sum(axis=2)[:, :, None], rest], axis=2).cumsum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = total / (count[:, :, None] + np.arange(square.shape[2] + 1))
            return sign * np.where(np.isnan(mean), np.inf, mean).min(axis=2)

        none = (count == 0) & ~free.any(axis=2)
        least, most = extreme(gap, 1.0), extreme(far, -1.0)
        return np.where(none, np.inf, least * x.shape[1]), np.where(none, np.inf, most * x.shape[1]), count > 0

    def wanted(self, x: np.ndarray, k: int) -> np.ndarray:
        """True where a cell may hold one of a row's k nearest donors of a feature that the row lacks."""
        least, most, sure = self.bounds(x)
        out = np.zeros(least.shape, bool)
        order = np.argsort(most, axis=1)
        for f in range(x.shape[1]):
            lacks = np.flatnonzero(np.isnan(x[:, f]))
            if not len(lacks):
                continue
            there = np.take_along_axis(np.where(sure[lacks], self.known[None, :, f], 0), order[lacks], axis=1).cumsum(axis=1) >= k
            reached = np.take_along_axis(np.take_along_axis(most[lacks], order[lacks], axis=1), there.argmax(axis=1)[:, None], axis=1)
            reach = np.where(there.any(axis=1)[:, None], reached, np.inf)
            out[lacks] |= (least[lacks] <= reach * (1 + 1e-9) + 1e-12) & np.isfinite(least[lacks]) & self.ever[None, :, f]
        return out


def nearest_donors(x: np.ndarray, y: np.ndarray, donor_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature, donor, distance)``: the k nearest donors of every feature a row lacks, ties to the smaller id.

    Squared distances are products of values, squares and masks; those near the k-th are taken anew by differences.
    """
    middle = np.nan_to_num(np.nanmean(np.concatenate([x, y]), axis=0)) if len(x) + len(y) else 0.0
    raw_x, raw_y = np.nan_to_num(x), np.nan_to_num(y)  # differences of these are exact for equal gaps, so ties stay ties
    x, y = x - middle, y - middle
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x0, y0 = np.nan_to_num(x), np.nan_to_num(y)
    place = np.empty(len(y), np.int64)
    place[np.argsort(donor_ids, kind="stable")] = np.arange(len(y))
    size, found = x.shape[1], []
    allowance = 1e-11 * size * ((x0 ** 2).sum(axis=1) + (y0 ** 2).sum(axis=1).max(initial=0.0))
    step = max(1, 4_000_000 // max(1, len(y)))
    for start in range(0, len(x), step):
        some = slice(start, start + step)
        shared = mx[some] @ my.T
        with np.errstate(divide="ignore", invalid="ignore"):
            square = (x0[some] ** 2 @ my.T - 2 * x0[some] @ y0.T + mx[some] @ (y0 ** 2).T) * size / shared
        square[shared == 0] = np.inf
        for f in range(size):
            rows, donors = np.flatnonzero(mx[some][:, f] == 0), np.flatnonzero(my[:, f])
            if not len(rows) or not len(donors):
                continue
            d = square[np.ix_(rows, donors)]
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(donors) > k else np.full(len(rows), np.inf)
            i, j = np.nonzero((d <= (limit + allowance[some][rows])[:, None]) & np.isfinite(d))
            i, j = rows[i] + start, donors[j]
            both = mx[i] * my[j]
            exact = np.zeros(len(i))
            for g in range(size):
                exact += both[:, g] * (raw_x[i, g] - raw_y[j, g]) ** 2
            exact = exact * size / both.sum(axis=1)
            order = np.lexsort((place[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[top], np.full(top.sum(), f), j[top], np.sqrt(exact[top])))
    if not found:
        return tuple(np.array([], t) for t in (int, int, int, float))
    return tuple(np.concatenate(part) for part in zip(*found))


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in column], dtype=float).reshape(-1, size)


def _donors_by_cells(base: DataFrame, size: int, k: int, block: int, max_pivots: int) -> DataFrame:
    """Neighbours of any number of patterns: cells hold donors of all of them."""
    kind = base.schema["_id"].dataType
    stats = base.agg(F.count("*").alias("rows"), *[g(F.col("x")[i]).alias(f"{p}{i}") for i in range(size) for p, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    count = max(1, min(max_pivots, int(math.sqrt(stats["rows"]) / 2)))
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(size)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(size)])
    apart = 2 * math.sqrt(size)  # rows with other gaps lie far apart, so cells mostly hold one pattern

    def marked(x: np.ndarray) -> np.ndarray:
        gaps = np.isnan(x)
        return np.concatenate([np.where(gaps, 0.0, (x - mean) / spread), apart * gaps], axis=1)

    drawn = base.orderBy(F.xxhash64("_id"), "_id").limit(count).select("x").collect()
    pivots = np.unique(marked(np.array([r["x"] for r in drawn], dtype=float).reshape(-1, size)), axis=0)
    half = 0.5 * (pivots ** 2).sum(axis=1)

    def place(batches):
        for batch in batches:
            x = marked(_matrix(batch["x"], size))
            yield batch.assign(cell=(x @ pivots.T - half).argmax(axis=1).astype("int32") if len(x) else pd.Series([], dtype="int32"))

    placed = base.mapInPandas(place, T.StructType(base.schema.fields + [T.StructField("cell", T.IntegerType())]))
    known = [a for i in range(size) for a in (F.count(F.col("x")[i]).alias(f"k{i}"), F.min(F.col("x")[i]).alias(f"l{i}"), F.max(F.col("x")[i]).alias(f"h{i}"))]
    table = placed.groupBy("cell").agg(F.count("*").alias("n"), *known).orderBy("cell").collect()  # no longer than the pivots
    numbers = np.array([r["cell"] for r in table], dtype="int32")
    part = lambda p: np.array([[r[f"{p}{i}"] for i in range(size)] for r in table], dtype=float).reshape(-1, size)
    cells = Cells(np.array([r["n"] for r in table]), part("k"), part("l"), part("h"))

    def route(batches):
        for batch in batches:
            for start in range(0, len(batch), ROUTED):
                rows = batch.iloc[start:start + ROUTED]
                i, j = np.nonzero(cells.wanted(_matrix(rows["x"], size), k))
                yield rows.iloc[i].assign(cell=numbers[j])

    needy = base.where(F.exists("x", lambda v: v.isNull()))
    routed = needy.mapInPandas(route, placed.schema)
    loads = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = base.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // block), -(-loads[r["cell"]] // block)) for r in table if r["cell"] in loads]
                                           or [(-1, 1, 1)], "cell int, d_blocks long, r_blocks long")
    slot = lambda blocks: F.pmod(F.xxhash64("_id", F.lit(23)), F.col(blocks))
    everywhere = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    keys = ["cell", "d_block", "r_block"]
    donors = placed.join(F.broadcast(plan), "cell").withColumn("d_block", slot("d_blocks")).withColumn("r_block", everywhere("r_blocks")).select(*keys, "_id", "x")
    rows = routed.join(F.broadcast(plan), "cell").withColumn("r_block", slot("r_blocks")).withColumn("d_block", everywhere("d_blocks")).select(*keys, "_id", "x")
    out = _found_schema(kind)

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in out.names})
        x, y = _matrix(a["x"], size), _matrix(b["x"], size)
        i, f, j, d = nearest_donors(x, y, b["_id"].to_numpy(), k)
        return pd.DataFrame({"_id": a["_id"].to_numpy()[i], "f": f.astype("int32"), "donor": b["_id"].to_numpy()[j], "distance": d, "value": y[j, f]})

    return rows.groupBy(*keys).cogroup(donors.groupBy(*keys)).applyInPandas(match, out)


def _found_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("_id", kind), T.StructField("f", T.IntegerType()), T.StructField("donor", kind),
                         T.StructField("distance", T.DoubleType()), T.StructField("value", T.DoubleType())])


class Halves:
    """A table of points halved ``depth`` times by a sample, each part along its widest feature; ``up`` halvings less make its cells."""

    def __init__(self, sample: np.ndarray, used: np.ndarray, depth: int, up: int):
        self.used, self.depth, self.up = used, depth, up
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        parts = {1: sample[:, used]}
        for node in range(1, 1 << depth):
            some = parts.pop(node)
            if len(some) > 1:
                axis = int(np.ptp(some, axis=0).argmax())
                values = np.sort(some[:, axis])
                middle = values[(len(values) - 1) // 2]
                if middle == values[-1] and values[0] < middle:
                    middle = values[np.searchsorted(values, middle) - 1]
                self.axis[node], self.cut[node] = axis, middle
            left = some[:, self.axis[node]] <= self.cut[node]
            parts[2 * node], parts[2 * node + 1] = some[left], some[~left]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        x, node = x[:, self.used], np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def bounded(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of the leaves, of the cells and of the whole table, by what its points fill of them."""
        size = 1 << self.depth
        self.count, self.low, self.high = np.zeros(size, np.int64), np.full((size, len(self.used)), np.inf), np.full((size, len(self.used)), -np.inf)
        self.count[leaf], self.low[leaf], self.high[leaf] = count, low[:, self.used], high[:, self.used]
        self.levels = [(self.count, self.low, self.high)]
        for shift in (self.up, self.depth):
            part = lambda v: v.reshape(size >> shift, 1 << shift, *v.shape[1:])
            self.levels.append((part(self.count).sum(axis=1), part(self.low).min(axis=1), part(self.high).max(axis=1)))

    def wanted(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs of the cells that may hold one of a row's k nearest points."""
        leaf, x = self.leaf(x), x[:, self.used]
        reach = np.full(len(x), np.inf)
        for shift, (count, low, high) in zip((0, self.up, self.depth), self.levels):
            box = leaf >> shift
            some = np.flatnonzero(np.isinf(reach) & (count[box] >= k))
            at = box[some]
            reach[some] = (np.maximum(np.abs(x[some] - low[at]), np.abs(x[some] - high[at])) ** 2).sum(axis=1)
        count, low, high = self.levels[1]
        cells = np.flatnonzero(count)
        low, high, found = low[cells], high[cells], []
        step = max(1, ROUTE_CELLS // max(1, len(cells)))
        for start in range(0, len(x), step):
            some = x[start:start + step]
            least = np.zeros((len(some), len(cells)))
            for i in range(len(self.used)):
                least += np.maximum(np.maximum(low[None, :, i] - some[:, i, None], some[:, i, None] - high[None, :, i]), 0.0) ** 2
            row, cell = np.nonzero(least <= (reach[start:start + step] * (1 + 1e-9) + 1e-12)[:, None])
            found.append((row + start, cells[cell]))
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tables(base: DataFrame) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]] | None:
    """Tables of points ``(pattern, shared features)``, ``(pattern, table)`` of donors and of rows with gaps; None where there are too many."""
    counted = base.groupBy("mask", "needy").agg(F.count("*").alias("n")).limit(2 * MAX_PATTERNS + 1).collect()
    rows = sum(r["n"] for r in counted)
    if len({r["mask"] for r in counted}) > MAX_PATTERNS:
        return None
    tables: dict[tuple[int, int], int] = {}
    gives, asks = set(), set()
    for mine in sorted({r["mask"] for r in counted if r["needy"]}):
        for other in sorted({r["mask"] for r in counted}):
            if mine & other and other & ~mine:
                table = tables.setdefault((other, mine & other), len(tables))
                gives.add((other, table))
                asks.add((mine, table))
    stand = lambda pairs, needy: sum(r["n"] for r in counted if r["needy"] or not needy for mask, _ in pairs if mask == r["mask"])
    if len(tables) > MAX_TABLES or max(stand(gives, False), stand(asks, True)) > MAX_COPIES * rows:
        return None
    return list(tables), sorted(gives), sorted(asks)


def _donors_by_patterns(base: DataFrame, size: int, k: int, block: int, tables: list[tuple[int, int]], gives: list[tuple[int, int]],
                        asks: list[tuple[int, int]]) -> DataFrame:
    """Neighbours of few patterns: a table of points for each pattern of donors and each set of features that rows share with it."""
    spark, kind = base.sparkSession, base.schema["_id"].dataType
    out = _found_schema(kind)
    bits = lambda mask: np.array([i for i in range(size) if mask >> i & 1], np.int64)
    given = spark.createDataFrame([(mask, t, tables[t][1]) for mask, t in gives] or [(-1, -1, 0)], "mask long, tab int, shared long")
    point = F.array(*[F.when(F.col("shared").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("x")[i]).otherwise(F.lit(0.0)) for i in range(size)])
    smallest = Window.partitionBy("tab", "point").orderBy("_id")
    donors = (base.join(F.broadcast(given), "mask").select("tab", point.alias("point"), "_id", "x")
              .withColumn("rn", F.row_number().over(smallest)).where(F.col("rn") <= k).drop("rn"))
    donors = cut_lineage(donors)
    sizes = {r["tab"]: r["n"] for r in donors.groupBy("tab").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    drawn: dict[int, list] = {t: [] for t in sizes}
    taken = F.pmod(F.xxhash64("_id", "tab", F.lit(31)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, DRAWN / max(1, total)))
    for r in donors.where(taken).select("tab", "point").collect():  # about DRAWN points
        drawn[r["tab"]].append(r["point"])
    least = max(LEAF, 2 * k, total / MAX_LEAVES)
    halves: dict[int, Halves] = {}
    for t, n in sizes.items():
        depth = max(0, math.ceil(math.log2(n / least)))
        up = min(depth, max(0, math.floor(math.log2(max(1.0, block / (n / (1 << depth)))))))
        sample = np.unique(np.array(drawn[t], dtype=float).reshape(-1, size), axis=0)
        halves[t] = Halves(sample, bits(tables[t][1]), depth, up)
    first, cells = {}, 0
    for t in sorted(halves):
        first[t], cells = cells, cells + (1 << halves[t].depth >> halves[t].up)

    def place(batches):
        for batch in batches:
            x, tab = _matrix(batch["point"], size), batch["tab"].to_numpy()
            leaf, cell = np.zeros(len(x), "int32"), np.zeros(len(x), "int32")
            for t in np.unique(tab):
                mine = tab == t
                leaf[mine] = halves[t].leaf(x[mine])
                cell[mine] = first[t] + (leaf[mine] >> halves[t].up)
            yield batch[["tab", "point", "_id", "x"]].assign(leaf=leaf, cell=cell)

    placed = donors.mapInPandas(place, T.StructType(donors.schema.fields + [T.StructField("leaf", T.IntegerType()), T.StructField("cell", T.IntegerType())]))
    ends = [a for i in range(size) for a in (F.min(F.col("point")[i]).alias(f"l{i}"), F.max(F.col("point")[i]).alias(f"h{i}"))]
    boxes: dict[int, list] = {t: [] for t in halves}
    filled: dict[int, int] = {}
    for r in placed.groupBy("tab", "leaf").agg(F.count("*").alias("n"), *ends).collect():  # about MAX_LEAVES rows
        boxes[r["tab"]].append(r)
        cell = first[r["tab"]] + (r["leaf"] >> halves[r["tab"]].up)
        filled[cell] = filled.get(cell, 0) + r["n"]
    for t, found in boxes.items():
        corner = lambda p: np.array([[r[f"{p}{i}"] for i in range(size)] for r in found], dtype=float).reshape(-1, size)
        halves[t].bounded(np.array([r["leaf"] for r in found]), np.array([r["n"] for r in found]), corner("l"), corner("h"))

    routed_schema = T.StructType([T.StructField("_id", kind), base.schema["x"], T.StructField("cell", T.IntegerType())])

    def route(batches):
        for batch in batches:
            x, tab = np.nan_to_num(_matrix(batch["x"], size)), batch["tab"].to_numpy()
            for t in np.unique(tab):
                mine = np.flatnonzero(tab == t)
                row, cell = halves[t].wanted(x[mine], k)
                for start in range(0, len(row), 10_000):
                    some = slice(start, start + 10_000)
                    yield batch.iloc[mine[row[some]]][["_id", "x"]].assign(cell=(first[t] + cell[some]).astype("int32"))

    asked = spark.createDataFrame([(mask, t) for mask, t in asks if t in halves] or [(-1, -1)], "mask long, tab int")
    routed = base.where("needy").join(F.broadcast(asked), "mask").select("_id", "x", "tab").mapInPandas(route, routed_schema)
    loads = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame([(cell, -(-filled[cell] // block), -(-n // block)) for cell, n in sorted(loads.items())] or [(-1, 1, 1)],
                                 "cell int, d_blocks long, r_blocks long")
    slot = lambda blocks: F.pmod(F.xxhash64("_id", F.lit(23)), F.col(blocks))
    everywhere = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    keys = ["cell", "d_block", "r_block"]
    offered = placed.join(F.broadcast(plan), "cell").withColumn("d_block", slot("d_blocks")).withColumn("r_block", everywhere("r_blocks")).select(*keys, "_id", "x")
    rows = routed.join(F.broadcast(plan), "cell").withColumn("r_block", slot("r_blocks")).withColumn("d_block", everywhere("d_blocks")).select(*keys, "_id", "x")
    starts = np.array([first[t] for t in sorted(first)])
    shared = {t: (bits(pattern), bits(common)) for t, (pattern, common) in enumerate(tables)}

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in out.names})
        known, used = shared[sorted(first)[np.searchsorted(starts, a["cell"].iloc[0], side="right") - 1]]
        x, y = _matrix(a["x"], size), _matrix(b["x"], size)
        mine, donor = a["_id"].to_numpy(), b["_id"].to_numpy()
        i, j, square = squares_in_block(x[:, used], mine, y[:, used], donor, k, False)
        apart, found = np.sqrt(square * size / len(used)), []
        for f in known:
            lacks = np.isnan(x[i, f])
            found.append((i[lacks], np.full(lacks.sum(), f, "int32"), j[lacks], apart[lacks]))
        i, f, j, d = (np.concatenate(part) for part in zip(*found))
        return pd.DataFrame({"_id": mine[i], "f": f, "donor": donor[j], "distance": d, "value": y[j, f]})

    return rows.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(match, out)


def masked_neighbours(df: DataFrame, key: str, names: list[str], k: int, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``(_id, f, donor, distance, value)``: per row and lacking feature (its place in ``names``) the k nearest donors of every block it meets.

    The distance is the root of the mean squared difference over shared features times their number in all; donors share at least one.
    Rows with gaps are dealt to the cells that may hold a nearest donor, so each (row, feature) has its k nearest among the results.
    Tables of points serve up to ``MAX_PATTERNS`` patterns of gaps, cells of all patterns any number of them.
    """
    size = len(names)
    x = F.array(*[c(n).cast("double") for n in names])
    if size > 62:  # more than the bits of a mask
        return _donors_by_cells(cut_lineage(df.select(c(key).alias("_id"), x.alias("x"))), size, k, block, max_pivots)
    mask = F.lit(0).cast("long")
    for i, n in enumerate(names):
        value = c(n).cast("double")
        mask = mask + F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.lit(1 << i)).cast("long")
    needy = F.lit(False)
    for n in names:
        needy = needy | c(n).cast("double").isNull()
    base = cut_lineage(df.select(c(key).alias("_id"), x.alias("x"), mask.alias("mask"), needy.alias("needy")))
    tables = _tables(base)
    if tables is None:
        return _donors_by_cells(base.select("_id", "x"), size, k, block, max_pivots)
    return _donors_by_patterns(base, size, k, block, *tables)


def donor_means(df: DataFrame, key: str, names: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """``(_id, _fill_0, …)``: per row with gaps the mean of each lacking feature over its k nearest donors, ties to the smaller id."""
    order = Window.partitionBy("_id", "f").orderBy("distance", "donor")
    best = masked_neighbours(df, key, names, k, block).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return best.groupBy("_id").agg(*[F.avg(F.when(F.col("f") == i, F.col("value"))).alias(f"_fill_{i}") for i in range(len(names))])
