"""Exact k-nearest-neighbour join by pivots, without a cross join.

Right rows are assigned to their nearest pivot. For a left row, the distances to the pivots and the
few smallest member distances of each cell bound the distance of its k-th neighbour from above; the
triangle inequality then rules out every cell that lies farther away. The surviving (left row,
cell) pairs meet in bounded blocks, each block keeps k candidates per left row, and a ranked window
merges them. Cells of any size are split by a hash of the key, so a third of all rows at one point
is spread over many tasks. Cells that a sample of left rows asks for nearly every time are bundled
into wide blocks, for there a left row would meet each of them anyway; a left row is dealt once to a bundle. Wide blocks grow with the
rows, up to a bounded size, so the copies of a row grow with the rows over that size.

Where cells can be ruled out, every left row first meets a block of its own cell; its k-th distance there is a far closer bound.
A cell is ruled out by the triangle inequality, or by the plane midway between its pivot and the left row's own.

With a restricting column, groups that fit a block are pooled, many to a block, and larger ones have
cells of their own; the tables of both are DataFrames, so there may be any number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c
from tabloom.operators.joins import BROADCAST_ROWS
from tabloom.session import cut_lineage

BLOCK = 2_000                # rows per side of one distance block
MAX_PIVOTS = 4_096
WIDE = 8                     # blocks' worth of rows, at least, in a bundle of cells, and of left rows that meet it
WIDE_ROWS = 65_536           # and at most, where these are more,
WIDE_BYTES = 32 << 20        # or as many as have so many bytes of vectors
WIDE_TASKS = 4               # pairs of wide blocks for every task that runs at once, before blocks grow
COMMON = 0.5                 # share of left rows from which a cell counts as asked by all
SAMPLED = 256                # left rows of a group by which its cells are bundled
PART = 32                    # numbers of which the smallest stands for all in a first look
ROUTED = 20_000              # left rows of a large group that are routed together
ROUTE_CELLS = 4_000_000      # numbers held at once while bounds are worked out


def _vector(df: DataFrame, features: list[str] | str) -> Column:
    if isinstance(features, str):
        # floats are widened in the tasks, so that half the bytes are dealt out
        return c(features) if df.schema[features].dataType == T.ArrayType(T.FloatType()) else c(features).cast("array<double>")
    return F.array(*[c(n).cast("double") for n in features])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By a matrix product, to about 1e-12 of the squared lengths."""
    out = a @ b.T
    out *= -2  # in place: a fresh matrix a step costs more than the sums
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)[None]
    return np.maximum(out, 0.0, out=out)


def _kth_at_most(d: np.ndarray, k: int) -> np.ndarray:
    """A bound of every row's k-th smallest number from above: the k-th of the smallest ones of its parts, where there are enough parts."""
    parts = d.shape[1] // PART
    if parts >= 4 * k:
        d = d[:, :parts * PART].reshape(len(d), PART, parts).min(axis=1)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def squares_in_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int,
                     exclude_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, point index, squared distance) of the k nearest points, ties to the smaller id.

    A matrix product leaves the points near the k-th distance; their distances are added up feature by
    feature, so equal points tie whatever block they are in.
    """
    order = np.argsort(point_ids, kind="stable")
    points, point_ids, rows, cols, dist = points[order], point_ids[order], [], [], []
    middle = points.mean(axis=0)
    near, far = points - middle, queries - middle
    longest = float((near * near).sum(axis=1).max(initial=0.0))
    step = max(1, min(4_000_000 // max(len(points), 1), max(256, 250_000 // max(len(points), 1))))  # as a rule, what a core's cache holds
    for start in range(0, len(queries), step):
        some = far[start:start + step]
        d = squared_distances(some, near)
        if exclude_same:
            d[query_ids[start:start + step, None] == point_ids[None, :]] = np.inf
        if len(points) > k:
            limit = _kth_at_most(d, k) + 1e-11 * points.shape[1] * ((some * some).sum(axis=1) + longest)
            keep = d <= np.minimum(limit, np.finfo(float).max)[:, None]
        else:
            keep = np.isfinite(d)
        r, p = np.nonzero(keep)
        v = np.zeros(len(r))
        for j in range(points.shape[1]):
            v += (queries[start + r, j] - points[p, j]) ** 2
        place = np.lexsort((p, v, r))
        r, p, v = r[place], p[place], v[place]
        top = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        rows.append(r[top] + start)
        cols.append(order[p[top]])
        dist.append(v[top])
    if not rows:
        return np.array([], int), np.array([], int), np.array([])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int,
                     exclude_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, point index, distance) of the k nearest points, ties to the smaller id."""
    rows, cols, square = squares_in_block(queries, query_ids, points, point_ids, k, exclude_same)
    return rows, cols, np.sqrt(square)


class _Cells:
    """Bounds of the cells of one group: pivot, smallest and largest distance to it, the few smallest ones."""

    def __init__(self, pivots: np.ndarray, table: pd.DataFrame, need: int):
        if "bundle" not in table:
            table = table.assign(bundle=table["cell"])
        table = table.sort_values("bundle", kind="stable")
        cell, self.low, self.high = table["cell"].to_numpy(), table["lo"].to_numpy(dtype=float), table["hi"].to_numpy(dtype=float)
        self.near = np.array([(list(v) + [np.inf] * need)[:need] for v in table["near"]], dtype=float)
        self.bundle, self.first = np.unique(table["bundle"].to_numpy(), return_index=True)
        self.pivots, self.need = pivots[cell], need
        self.longest = float((self.pivots * self.pivots).sum(axis=1).max(initial=0.0))

    def wanted(self, x: np.ndarray, limit: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, bundle) pairs, by row, of the bundles whose cells may hold one of a row's nearest; ``limit``: bounds known before."""
        limit = np.full(len(x), np.inf) if limit is None else limit
        step = max(1, ROUTE_CELLS // (len(self.pivots) * (self.need if np.isinf(limit).any() else 2)))
        for start in range(0, len(x), step):
            some, bound = x[start:start + step], limit[start:start + step]
            square = squared_distances(some, self.pivots)
            d = np.sqrt(square)
            if np.isinf(bound).any():
                reach = (d[:, :, None] + self.near[None, :, :]).reshape(len(some), -1)
                if reach.shape[1] >= self.need:
                    bound = np.minimum(bound, np.partition(reach, self.need - 1, axis=1)[:, self.need - 1])
            gap = np.maximum(np.maximum(d - self.high, self.low - d), 0.0)
            lengths = (some * some).sum(axis=1) + self.longest
            bound = bound * (1 + 1e-9) + 1e-6 * np.sqrt(lengths) + 1e-12  # roots of products near zero are coarse
            asked = gap <= bound[:, None]
            if np.isfinite(bound).all():
                # what lies in a cell is no nearer to the own pivot than to the cell's, so it is beyond the plane midway between them
                own = square.argmin(axis=1)
                apart = np.sqrt(squared_distances(self.pivots[own], self.pivots))
                beyond = square - square[np.arange(len(some)), own][:, None]
                asked &= beyond <= 2 * apart * bound[:, None] + 1e-9 * lengths[:, None]
            row, hit = np.nonzero(np.logical_or.reduceat(asked, self.first, axis=1))
            yield row + start, self.bundle[hit]


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray, half: np.ndarray) -> np.ndarray:
    step = max(1, ROUTE_CELLS // len(pivots))
    parts = [(x[s:s + step] @ pivots.T - half).argmax(axis=1) for s in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.array([], dtype=int)


def knn_join(left: DataFrame, right: DataFrame, k: int, features: list[str] | str, left_id: str, right_id: str,
             within: str | None = None, exclude_same: bool = False, block: int = BLOCK,
             max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(left_id, right_id, distance, rank): the k nearest right rows of each left row, all exact.

    ``within`` restricts neighbours to rows with an equal value of that column, of which there may be
    any number; NULL is a value of its own. ``exclude_same`` leaves out the right row with the left row's own id.
    """
    found = _candidates(left, right, k, features, left_id, right_id, within, exclude_same, block, max_pivots)
    order = Window.partitionBy("left_id").orderBy("distance", "right_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _broadcast_if_short(table: DataFrame) -> DataFrame:
    """A kept table marked for broadcast where it is short: its size is unknown to the planner, which would shuffle the vectors to meet it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _bounded(asking: DataFrame, placed: DataFrame, cells: DataFrame, pivots: np.ndarray, k: int, exclude_same: bool, block: int,
             slot: Callable, everywhere: Callable) -> DataFrame:
    """(lid, vec, grp, home, bound): every left row with its k-th distance in one block of its own cell; any k rows bound the k nearest."""
    numbers = np.sort(cells.where("cell >= 0").select("cell").toPandas()["cell"].to_numpy())  # no longer than the pivots
    own = pivots[numbers]
    half = 0.5 * (own * own).sum(axis=1)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=numbers[_nearest_pivot(_matrix(batch["vec"]), own, half)].astype("int32"))

    names = ["lid", "vec", "grp", "home"]
    fields = asking.select(*names).schema.fields
    settled = asking.select(*names).mapInPandas(settle, T.StructType([*fields, T.StructField("cell", T.IntegerType())]))
    loads = settled.groupBy("cell").agg(F.ceil(F.count("*") / (WIDE * block)).cast("long").alias("l_blocks"))
    plan = F.broadcast(cut_lineage(loads.join(cells.select("cell", F.ceil(F.col("n") / block).cast("long").alias("r_blocks")), "cell")))
    l_side = settled.join(plan, "cell").withColumn("l_block", slot("lid", "l_blocks")).select("cell", "l_block", *names)
    r_side = (placed.select("rid", F.col("vec").alias("rvec"), "cell").join(plan, "cell").where(slot("rid", "r_blocks") == 0)
              .withColumn("l_block", everywhere("l_blocks")).select("cell", "l_block", "rid", "rvec"))

    def bound(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        far = np.full(len(a), np.inf)
        if len(a) and len(b):
            q, _, d = nearest_in_block(_matrix(a["vec"]), a["lid"].to_numpy(), _matrix(b["rvec"]), b["rid"].to_numpy(), k, exclude_same)
            full = np.bincount(q, minlength=len(a)) == k
            last = np.zeros(len(a))
            np.maximum.at(last, q, d)
            far[full] = last[full]
        return a[names].assign(bound=far)

    return l_side.groupBy("cell", "l_block").cogroup(r_side.groupBy("cell", "l_block")).applyInPandas(
        bound, T.StructType([*fields, T.StructField("bound", T.DoubleType())]))


def _candidates(left: DataFrame, right: DataFrame, k: int, features: list[str] | str, left_id: str, right_id: str,
                within: str | None, exclude_same: bool, block: int, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(left_id, right_id, distance): the k nearest right rows of each left row in every block that it meets."""
    group = F.coalesce(F.concat(F.lit("="), c(within).cast("string")), F.lit("")) if within else F.lit("")
    ids = {f.name: f.dataType for f in left.schema}, {f.name: f.dataType for f in right.schema}
    lefts = left.select(c(left_id).alias("lid"), _vector(left, features).alias("vec"), group.alias("grp"))
    rights = cut_lineage(right.select(c(right_id).alias("rid"), _vector(right, features).alias("vec"), group.alias("grp")))
    out = T.StructType([T.StructField("left_id", ids[0][left_id]), T.StructField("right_id", ids[1][right_id]),
                        T.StructField("distance", T.DoubleType())])
    rows = rights.count()
    if rows == 0:
        return left.sparkSession.createDataFrame([], out)
    tasks = WIDE_TASKS * left.sparkSession.sparkContext.defaultParallelism
    if not within and rows > ROUTED and rights.rdd.getNumPartitions() < tasks // 2:
        rights = rights.repartition(tasks)  # rows from a few files would be placed by a few tasks
    need = k + 1 if exclude_same else k
    count = max(1, min(max_pivots, int(math.sqrt(rows / 4))))
    pivots = np.array([r[0] for r in rights.orderBy(F.xxhash64("rid"), "rid").limit(count).select("vec").collect()], dtype=float)
    pivots = np.unique(pivots, axis=0)

    if within:
        # a small group goes to a pool with others, a large one keeps its name
        sizes = rights.groupBy("grp").agg(F.count("*").alias("size"))
        pools = -(-rows // block)
        pool = F.when(F.col("size") > block, F.col("grp")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("grp"), F.lit(pools)).cast("string")))
        homes = _broadcast_if_short(cut_lineage(sizes.select("grp", pool.alias("home"), (F.col("size") > block).alias("large"))))
        rights, lefts = rights.join(homes, "grp"), lefts.join(homes, "grp")
    else:
        rights, lefts = (df.withColumn("home", F.lit("")).withColumn("large", F.lit(True)) for df in (rights, lefts))

    def assign(batches):
        half = 0.5 * (pivots * pivots).sum(axis=1)
        for batch in batches:
            if len(batch):
                x, far = _matrix(batch["vec"]), batch["large"].to_numpy(dtype=bool)
                cell, reach = np.full(len(x), -1, dtype="int32"), np.zeros(len(x))
                cell[far] = _nearest_pivot(x[far], pivots, half)
                reach[far] = np.sqrt(((x[far] - pivots[cell[far]]) ** 2).sum(axis=1))
                batch = batch.assign(cell=cell, reach=reach)
            else:
                batch = batch.assign(cell=pd.Series([], dtype="int32"), reach=pd.Series([], dtype=float))
            yield batch

    placed = rights.mapInPandas(assign, T.StructType(rights.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]))
    placed = cut_lineage(placed)
    # the few smallest distances of a cell: those of every task first
    part = F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")
    smallest = lambda lists: F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, need)
    ranked = placed.where("cell >= 0").withColumn("part", part).withColumn("rn", F.row_number().over(Window.partitionBy("home", "cell", "part").orderBy("reach"))).where(F.col("rn") <= need)
    close = ranked.groupBy("home", "cell").agg(smallest(F.array("reach")).alias("near"))
    extent = placed.groupBy("home", "cell").agg(F.count("*").alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))
    cells = cut_lineage(extent.join(close, ["home", "cell"], "left").withColumn("bundle", F.col("cell").cast("long")))

    fields = {f.name: f for f in lefts.schema}
    routed_schema = T.StructType([fields["lid"], fields["vec"], fields["grp"], T.StructField("home", T.StringType()), T.StructField("bundles", T.ArrayType(T.LongType()))])

    def dealt(rows: pd.DataFrame, bounds: _Cells) -> pd.DataFrame:
        # the bundles of a row stay one list here and become rows in Spark, so no task holds copies of the vectors
        lists = np.empty(len(rows), dtype=object)
        for row, bundle in bounds.wanted(_matrix(rows["vec"]), rows["bound"].to_numpy(dtype=float) if "bound" in rows else None):
            some, first = np.unique(row, return_index=True)
            for i, part in zip(some, np.split(bundle, first[1:])):
                lists[i] = part
        return rows[["lid", "vec", "grp", "home"]].assign(bundles=lists)

    def routed(asking: DataFrame, offered: DataFrame) -> DataFrame:
        if not within:
            bounds = _Cells(pivots, offered.toPandas(), need)  # no longer than the pivots

            def route(batches):
                for batch in batches:
                    if len(batch):
                        yield dealt(batch, bounds)

            return asking.mapInPandas(route, routed_schema)
        slots = cut_lineage(asking.groupBy("home").agg(F.ceil(F.count("*") / ROUTED).cast("long").alias("slots")))
        asked = asking.join(_broadcast_if_short(slots), "home").select("lid", "vec", "grp", "home", F.pmod(F.xxhash64("lid"), F.col("slots")).alias("slot"))
        numbers = slots.select(F.col("home").alias("_home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("_slot"))
        offered = offered.join(numbers, F.col("home") == F.col("_home")).select("_home", "_slot", "cell", "lo", "hi", "near", "bundle")

        def route_group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return dealt(a, _Cells(pivots, b, need)) if len(a) and len(b) else pd.DataFrame({n: [] for n in routed_schema.names})

        return asked.groupBy("home", "slot").cogroup(offered.groupBy("_home", "_slot")).applyInPandas(route_group, routed_schema)

    slot = lambda key, number: F.pmod(F.xxhash64(key, F.lit(17)), F.col(number))
    everywhere = lambda number: F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))
    far, offered = lefts.where("large"), cells.where("cell >= 0")
    counts = cut_lineage(far.groupBy("home").agg(F.count("*").alias("asking")))
    pairs = offered.groupBy("home").agg(F.sum("n").alias("n")).join(counts, "home").agg(F.sum(F.col("n") * F.col("asking").cast("double"))).first()[0]
    most = min(WIDE_ROWS, WIDE_BYTES // (8 * max(1, pivots.shape[1])))
    wide = max(WIDE * block, min(most, math.isqrt(int(pairs or 0) // tasks)))
    sample = (far.join(_broadcast_if_short(counts), "home").where(F.pmod(F.xxhash64("lid", F.lit(29)), F.greatest(F.lit(1), F.floor(F.col("asking") / SAMPLED))) == 0)
              .drop("asking"))
    sample = cut_lineage(sample)
    heard = sample.groupBy("home").agg(F.count("*").alias("heard"))
    asked = routed(sample, offered).select("home", F.explode("bundles").alias("bundle")).groupBy("home", "bundle").agg(F.count("*").alias("asked"))
    common = offered.drop("bundle").join(asked.select("home", F.col("bundle").cast("int").alias("cell"), "asked"), ["home", "cell"]).join(heard, "home")
    common = common.where(F.col("asked") >= F.col("heard") * COMMON)
    over = Window.partitionBy("home").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # no more cells in a home than pivots
    bundled = common.select("home", "cell", (-2 - F.floor((F.sum("n").over(over) - F.col("n")) / wide)).cast("long").alias("wide"))
    cells = cut_lineage(cells.join(bundled, ["home", "cell"], "left").withColumn("bundle", F.coalesce("wide", "bundle")).drop("wide"))
    if not within and not cells.where("bundle < -1").take(1):
        asking = counts.agg(F.sum("asking")).first()[0] or 0
        if asking > ROUTED:
            far = far.repartition(max(tasks, asking // (5 * ROUTED)))
        far = _bounded(far, placed, cells, pivots, k, exclude_same, block, slot, everywhere)
    meeting = routed(far, cells.where("cell >= 0")).select("lid", "vec", "grp", "home", "bundles")
    if within:
        meeting = meeting.unionByName(lefts.where(~F.col("large")).select("lid", "vec", "grp", "home", F.array(F.lit(-1).cast("long")).alias("bundles")))
    meeting = cut_lineage(meeting)
    dealt_rows = meeting.select("lid", "vec", "grp", "home", F.explode("bundles").alias("bundle"))
    loads = meeting.select("home", F.explode("bundles").alias("bundle")).groupBy("home", "bundle").agg(F.count("*").alias("load"))
    blocks = lambda name: F.ceil(F.col(name) / F.when(F.col("bundle") < -1, wide).otherwise(block)).cast("long")
    plan = (cells.groupBy("home", "bundle").agg(F.sum("n").alias("n")).join(loads, ["home", "bundle"])
            .select("home", "bundle", blocks("n").alias("r_blocks"), blocks("load").alias("l_blocks")))
    plan, bundles = _broadcast_if_short(cut_lineage(plan)), _broadcast_if_short(cells.select("home", "cell", "bundle"))
    keys = ["home", "bundle", "r_block", "l_block"]
    r_side = (placed.drop("reach", "large").join(bundles, ["home", "cell"]).join(plan, ["home", "bundle"])
              .withColumn("r_block", slot("rid", "r_blocks")).withColumn("l_block", everywhere("l_blocks")).select(*keys, "rid", "grp", F.col("vec").alias("rvec")))
    l_side = (dealt_rows.join(plan, ["home", "bundle"]).withColumn("l_block", slot("lid", "l_blocks"))
              .withColumn("r_block", everywhere("r_blocks")).select(*keys, "lid", "grp", F.col("vec").alias("lvec")))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        pairs = [(a, b)] if a["grp"].nunique() <= 1 and b["grp"].nunique() <= 1 else []
        if not pairs:
            others = dict(list(b.groupby("grp", sort=False)))
            pairs = [(mine, others[g]) for g, mine in a.groupby("grp", sort=False) if g in others]
        for mine, other in pairs:
            if len(mine) and len(other) and mine["grp"].iloc[0] == other["grp"].iloc[0]:
                lid, rid = mine["lid"].to_numpy(), other["rid"].to_numpy()
                q, p, d = nearest_in_block(_matrix(mine["lvec"]), lid, _matrix(other["rvec"]), rid, k, exclude_same)
                found.append(pd.DataFrame({"left_id": lid[q], "right_id": rid[p], "distance": d}))
        return pd.concat(found) if found else pd.DataFrame({"left_id": [], "right_id": [], "distance": []})

    return l_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInPandas(match, out)


def lsh_knn_join(left: DataFrame, right: DataFrame, k: int, features: list[str] | str, left_id: str, right_id: str,
                 max_distance: float, bucket_length: float, tables: int = 5, seed: int = 42) -> DataFrame:
    """Approximate alternative: random-projection buckets, pairs within ``max_distance``, best k kept.

    Rows of one bucket meet as the rows of one group of ``knn_join`` do, so a bucket of any size is compared in bounded blocks,
    each of which keeps k rows; pairs that share several buckets are counted once.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    a = left.select(c(left_id).alias("lid"), _vector(left, features).alias("vec")).dropDuplicates()
    b = right.select(c(right_id).alias("rid"), _vector(right, features).alias("vec")).dropDuplicates()
    vectors = lambda df: df.withColumn("features", array_to_vector("vec"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(vectors(b))

    def bucketed(df: DataFrame) -> DataFrame:
        hashed = model.transform(vectors(df)).select(*df.columns, F.posexplode("hashes").alias("place", "hash"))
        return hashed.select(*df.columns, F.concat_ws(":", "place", vector_to_array("hash")[0].cast("long")).alias("bucket"))

    near = _candidates(bucketed(a), bucketed(b), k, "vec", "lid", "rid", "bucket", False, BLOCK).where(F.col("distance") < max_distance).dropDuplicates()
    order = Window.partitionBy("left_id").orderBy("distance", "right_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
