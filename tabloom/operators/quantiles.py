"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer, which is fine for
a million rows and impossible for a trillion. Above a size limit the order statistics are found by
narrowing: one bounded sketch a column proposes pivots around all wanted ranks, one counting pass
says between which pivots each rank lies, and the values of those open intervals are counted and
ordered per interval. The driver sees only pivots, counts and the answers, however many ranks are wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.columns import c

DIRECT_ROWS = 2_000_000      # up to here one percentile() buffer per column is acceptable
FINAL_VALUES = 1_000_000     # rows of an interval ordered in one task; longer ones are ordered in buckets
SKETCH_ACCURACY = 10_000
BROADCAST_GROUPS = 200_000


def exact_quantiles(df: DataFrame, columns: Iterable[str], probs: Iterable[float],
                    direct_rows: int = DIRECT_ROWS,
                    final_values: int = FINAL_VALUES) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column over non-NULL values; None for an empty column."""
    columns, probs = list(dict.fromkeys(columns)), [float(p) for p in probs]
    if not columns:
        return {}
    narrow = df.select(*[c(n).cast("double").alias(n) for n in columns])
    totals = narrow.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(columns)]).first()
    total = {n: totals[f"n{i}"] for i, n in enumerate(columns)}
    result: dict[str, list[float | None]] = {n: [None] * len(probs) for n in columns}

    direct = [n for n in columns if 0 < total[n] <= direct_rows]
    if direct:
        row = narrow.agg(*[F.percentile(c(n), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}")
                           for i, n in enumerate(direct)]).first()
        result.update({n: list(row[f"q{i}"]) for i, n in enumerate(direct)})

    large = [n for n in columns if total[n] > direct_rows]
    if large:
        wanted: dict[str, set[int]] = {n: set() for n in large}
        for n in large:
            for p in probs:
                position = p * (total[n] - 1)
                wanted[n] |= {math.floor(position), math.ceil(position)}
        value = _select(narrow, wanted, total, final_values)
        for n in large:
            for i, p in enumerate(probs):
                position = p * (total[n] - 1)
                low, high = value[(n, math.floor(position))], value[(n, math.ceil(position))]
                result[n][i] = low + (high - low) * (position - math.floor(position))
    return result


def _codes(pivots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """2i for a value between pivots i - 1 and i, 2i + 1 for one equal to pivot i; NaN is the largest value."""
    return np.searchsorted(pivots, values, side="left") + np.searchsorted(pivots, values, side="right")


def _select(narrow: DataFrame, wanted: dict[str, set[int]], total: dict[str, int], final_values: int) -> dict[tuple[str, int], float]:
    """Values at the wanted 0-based ranks of every column: three passes, whatever their number."""
    names = list(wanted)
    table = narrow.select(*[c(n).alias(f"v{i}") for i, n in enumerate(names)])
    sketches = []
    for i, n in enumerate(names):
        places = {min(max(round((r + 0.5) / total[n] * SKETCH_ACCURACY) + m, 0), SKETCH_ACCURACY) for r in wanted[n] for m in (-2, 0, 2)}
        shares = ", ".join(f"{p / SKETCH_ACCURACY}D" for p in sorted(places))
        sketches.append(F.expr(f"percentile_approx(v{i}, array({shares}), {SKETCH_ACCURACY})").alias(f"p{i}"))
    proposed = table.agg(*sketches).first()
    pivots = [np.unique(np.array(proposed[f"p{i}"], dtype=float)) for i in range(len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(2 * len(p) + 1, dtype=np.int64) for p in pivots]
        for batch in batches:
            for i, p in enumerate(pivots):
                found[i] += np.bincount(_codes(p, batch.column(i).drop_null().to_numpy(zero_copy_only=False)), minlength=len(found[i]))
        for i, n in enumerate(found):
            code = np.nonzero(n)[0]
            yield pa.RecordBatch.from_pydict({"i": np.full(len(code), i, dtype=np.int32), "code": code.astype(np.int32), "cnt": n[code]})

    sizes = [np.zeros(2 * len(p) + 1, dtype=np.int64) for p in pivots]
    for row in table.mapInArrow(count, "i int, code int, cnt long").groupBy("i", "code").agg(F.sum("cnt").alias("cnt")).collect():
        sizes[row["i"]][row["code"]] = row["cnt"]

    value: dict[tuple[str, int], float] = {}
    asked, longest = [], 0
    for i, n in enumerate(names):
        until = np.cumsum(sizes[i])
        for r in sorted(wanted[n]):
            code = int(np.searchsorted(until, r, side="right"))
            if code % 2:
                value[(n, r)] = float(pivots[i][code // 2])
            else:
                asked.append((i, code, r, int(r - (until[code] - sizes[i][code]))))
                longest = max(longest, int(sizes[i][code]))
    if not asked:
        return value
    open_codes = [np.unique(np.array([code for j, code, _, _ in asked if j == i], dtype=np.int64)) for i in range(len(names))]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, p in enumerate(pivots):
                if len(open_codes[i]):
                    v, n = np.unique(batch.column(i).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                    code = _codes(p, v)
                    keep = np.isin(code, open_codes[i])
                    yield pa.RecordBatch.from_pydict({"i": np.full(int(keep.sum()), i, dtype=np.int32), "code": code[keep].astype(np.int32), "v": v[keep], "cnt": n[keep]})

    counted = table.mapInArrow(inside, "i int, code int, v double, cnt long").groupBy("i", "code", "v").agg(F.sum("cnt").alias("cnt"))
    if longest <= final_values:
        over = Window.partitionBy("i", "code").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn("before", F.sum("cnt").over(over) - F.col("cnt"))
    else:
        from tabloom.operators.ordered import prefix_counts

        ranked = prefix_counts(counted, ["i", "code"], ["v"], "cnt", "before")
    places = table.sparkSession.createDataFrame(asked, "i int, code int, rank long, place long")
    hit = (F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("cnt"))
    for row in ranked.join(F.broadcast(places), ["i", "code"]).where(hit).select("i", "rank", "v").collect():
        value[(names[row["i"]], row["rank"])] = row["v"]
    return value


def approx_quantiles(df: DataFrame, columns: Iterable[str], probs: Iterable[float],
                     accuracy: int = SKETCH_ACCURACY) -> dict[str, list[float | None]]:
    """One-pass sketch quantiles: elements of the column, rank error 1/accuracy."""
    columns, probs = list(columns), [float(p) for p in probs]
    if not columns:
        return {}
    row = df.agg(*[F.percentile_approx(c(n).cast("double"), probs, accuracy).alias(f"q{i}")
                   for i, n in enumerate(columns)]).first()
    return {n: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
            for i, n in enumerate(columns)}


def quantiles(df: DataFrame, columns: Iterable[str], probs: Iterable[float],
              exact: bool = True) -> dict[str, list[float | None]]:
    return exact_quantiles(df, columns, probs) if exact else approx_quantiles(df, columns, probs)


def grouped_quantiles(df: DataFrame, group: list[str], column: str, probs: Iterable[float],
                      direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Exact quantiles per group: (group..., n, q array).

    While every group is small, one aggregation. Otherwise values are first counted per
    (group, value), then prefix sums over a bucketed order give each value its rank range, so a
    group holding a third of the table is spread over many tasks.
    """
    probs = [float(p) for p in probs]
    keys = [c(g) for g in group]
    value = c(column).cast("double")
    largest = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= direct_rows:
        return df.groupBy(*keys).agg(
            F.count(value).alias("n"),
            F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("q"))
    from tabloom.operators.ordered import prefix_counts

    counted = (df.where(value.isNotNull()).groupBy(*keys, value.alias("v"))
               .agg(F.count("*").alias("cnt")))
    ranked = prefix_counts(counted, group, ["v"], "cnt", "before")
    totals = df.groupBy(*[c(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.count(value).alias("n"))
    match = F.lit(True)
    for i, g in enumerate(group):
        match = match & c(g).eqNullSafe(F.col(f"_g{i}"))
    # the values are met by their groups' sizes, never gathered by group
    few = totals.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = ranked.join(F.broadcast(totals) if few else totals, match, "left").select(*keys, "n", "v", "cnt", "before")
    picks = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        inside = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("cnt"))
        low, high = F.floor(position), F.ceil(position)
        picks += [F.max(F.when(inside(low), F.col("v"))).alias(f"lo{i}"),
                  F.max(F.when(inside(high), F.col("v"))).alias(f"hi{i}")]
    found = joined.groupBy(*keys).agg(*picks).join(totals, match, "right")
    q = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}"))
         * (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))) for i, p in enumerate(probs)]
    return found.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(group)], "n", F.when(F.col("n") > 0, F.array(*q)).alias("q"))
