"""Filling missing values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c, is_numeric, numeric_columns, replace_columns, unused_name
from tabloom.operators.aggregate import column_values
from tabloom.operators.fitted import Fitted
from tabloom.operators.quantiles import exact_quantiles

MAX_MASKS = 4_096            # patterns of gaps whose Gram matrices the driver holds


def null_counts(df: DataFrame) -> dict[str, int]:
    if not df.columns:
        return {}
    row = df.agg(*[F.count_if(c(n).isNull()).alias(f"c{i}") for i, n in enumerate(df.columns)]).first()
    return {n: row[f"c{i}"] for i, n in enumerate(df.columns)}


def mode_values(df: DataFrame, columns: list[str]) -> dict:
    """{column: most frequent known value, the smallest on ties, or None} of all columns from one shuffle of their values.

    Values are compared as text, which orders texts, booleans, dates and timestamps alike.
    """
    if not columns:
        return {}
    counted = column_values(df.select(*[c(n) for n in columns])).where(F.col("position") >= 0)
    best = Window.partitionBy("position").orderBy(F.desc("copies"), "value")
    top = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") == 1).collect()  # a row per column
    texts = {columns[r["position"]]: r["value"] for r in top}
    typed = [F.lit(texts[n]).cast(df.schema[n].dataType).alias(f"v{i}") for i, n in enumerate(columns) if n in texts]
    row = df.sparkSession.range(1).select(*typed).first() if typed else {}
    return {n: row[f"v{i}"] if n in texts else None for i, n in enumerate(columns)}


def fit_impute_missing(df: DataFrame, columns: list[str] | None = None) -> Fitted:
    """Median for numeric columns, mode for the others; an all-NULL column stays NULL."""
    gaps = [n for n, k in null_counts(df).items() if k and (columns is None or n in columns)]
    numeric = [n for n in gaps if is_numeric(df, n)]
    medians = {n: q[0] for n, q in exact_quantiles(df, numeric, [0.5]).items()}
    modes = mode_values(df, [n for n in gaps if n not in medians])
    fills = {n: v for n, v in {**medians, **modes}.items() if v is not None}

    def apply(other: DataFrame) -> DataFrame:
        return replace_columns(other, {
            n: F.coalesce(c(n).cast("double") if n in medians else c(n), F.lit(v)) for n, v in fills.items()})

    return Fitted(apply, {"fills": fills})


def impute_missing(df: DataFrame) -> DataFrame:
    return fit_impute_missing(df).transform(df)


def constant_impute(df: DataFrame, columns: list[str] | None = None, fill_value=0) -> DataFrame:
    """Same constant everywhere, cast to each column's type; columns that cannot hold it are left."""
    names = [n for n in (columns or df.columns) if n in df.columns]
    fillable = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
    new = {}
    for n in names:
        kind = df.schema[n].dataType
        if isinstance(kind, fillable):
            text = str(fill_value).lower() if isinstance(fill_value, bool) else str(fill_value)
            new[n] = F.coalesce(c(n), F.lit(text).try_cast(kind))
    return replace_columns(df, new)


def add_missing_indicators(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = [n for n in (columns or [n for n, k in null_counts(df).items() if k]) if n in df.columns]
    if not names:
        raise ValueError("No column has a gap to mark.")
    return replace_columns(df, {f"{n}_was_missing": c(n).isNull().cast("int") for n in names})


def knn_impute(df: DataFrame, n_neighbors: int = 5, columns: list[str] | None = None,
               exclude: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Mean of the feature over the nearest rows that have it, by distance over shared features.

    The squared distance is the mean squared difference over the features both rows have, times the number of features. All patterns of gaps
    meet in one block join (``operators/masked.py``). A column mean fills what has no donor. ``key`` names a unique column (ties go to the
    smaller key).
    """
    from tabloom.operators.masked import donor_means

    names = numeric_columns(df, columns, [key] + list(exclude or []) if key else exclude)
    if not names:
        raise ValueError("Neighbours are found by numeric columns, and there are none.")
    if key is None:
        raise ValueError("key required: a unique column that identifies rows")
    means = df.agg(*[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    fallback = {n: means[f"m{i}"] for i, n in enumerate(names)}
    best = donor_means(df, key, names, max(1, int(n_neighbors))).withColumnRenamed("_id", "_left_id")
    joined = df.join(best, c(key) == F.col("_left_id"), "left")
    return joined.select(*[F.coalesce(c(n).cast("double"), F.col(f"_fill_{names.index(n)}"), F.lit(fallback[n])).alias(n)
                           if n in names else c(n) for n in df.columns])


def _mask_grams(df: DataFrame, names: list[str], mean: list[float], spread: list[float]) -> dict[str, np.ndarray]:
    """{mask: Gram matrix of (standardised values with 0 for gaps, 1)} over the rows of each pattern of gaps ("1" marks a gap).

    Every task adds up its rows per mask before anything is shuffled; the driver receives masks x (columns + 1)^2 numbers.
    """
    size = len(names) + 1
    middle, scale = np.array(mean), np.array(spread)
    slim = df.select(F.array(*[c(n).cast("double") for n in names]).alias("x"))

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([np.asarray(v, dtype=float) for v in batch["x"]], dtype=float).reshape(-1, size - 1)
            gaps = np.isnan(x)
            z = np.column_stack([np.where(gaps, 0.0, (x - middle) / scale), np.ones(len(x))])
            kinds, which = np.unique(gaps, axis=0, return_inverse=True)
            which = which.ravel()
            for k, kind in enumerate(kinds):
                rows = z[which == k]
                mask = "".join("01"[int(g)] for g in kind)
                total[mask] = total.get(mask, 0.0) + rows.T @ rows
        if total:
            yield pd.DataFrame({"mask": list(total), "part": [g.ravel() for g in total.values()]})

    parts = slim.mapInPandas(partial, "mask string, part array<double>")
    cells = parts.select("mask", F.posexplode("part").alias("i", "v")).groupBy("mask", "i").agg(F.sum("v").alias("v")).collect()
    grams: dict[str, np.ndarray] = {}
    for cell in cells:
        grams.setdefault(cell["mask"], np.zeros(size * size))[cell["i"]] = cell["v"]
    return {mask: g.reshape(size, size) for mask, g in sorted(grams.items())}


def _started(mask: str) -> np.ndarray:
    """How the filled row (and the constant) depends on the known values: gaps start at the mean, which is 0."""
    return np.diag([float(g == "0") for g in mask] + [1.0])


def _filled(turn: np.ndarray, target: int, weights: np.ndarray) -> None:
    turn[target] = np.delete(turn, target, axis=0).T @ weights


def fit_iterative_impute(df: DataFrame, max_iter: int = 10, columns: list[str] | None = None, exclude: list[str] | None = None,
                         tol: float = 1e-3, ridge: float = 1e-3) -> Fitted:
    """Round-robin regressions: each column with gaps is predicted from the others, starting at the means, fewest gaps first.

    Within a pattern of gaps every filled value is one linear function of the known values, whatever the round. So one pass gathers a Gram
    matrix per pattern, and all rounds are solved from these on the driver: the Gram of the filled rows follows by multiplication, the table is
    not read again. Rounds end when the filled values of a round change by less than ``tol`` (root mean square, in standard deviations).
    Tables with more than ``MAX_MASKS`` patterns go through one aggregation per column and round instead, which gives the same rounds.
    """
    names = numeric_columns(df, columns, exclude)
    if not names:
        raise ValueError("Regressions fill numeric columns, and there are none.")
    work = df.select(*[c(n) for n in names])
    missing = null_counts(work)
    stats = work.agg(*[a for i, n in enumerate(names) for a in (F.avg(c(n)).alias(f"m{i}"), F.stddev_pop(c(n)).alias(f"s{i}"))]).first()
    mean, spread = [stats[f"m{i}"] or 0.0 for i in range(len(names))], [stats[f"s{i}"] or 1.0 for i in range(len(names))]
    order = sorted((i for i, n in enumerate(names) if missing[n] and stats[f"m{i}"] is not None), key=lambda i: (missing[names[i]], names[i]))
    size = len(names) + 1
    steps: list[tuple[int, np.ndarray]] = []

    def solved(gram: np.ndarray, target: int) -> np.ndarray:
        others = np.delete(np.arange(size), target)
        penalty = ridge * np.eye(size - 1)
        penalty[-1, -1] = 0.0
        return np.linalg.solve(gram[np.ix_(others, others)] + penalty, gram[others, target])

    flags = F.concat(*[F.when(c(n).isNull(), "1").otherwise("0") for n in names])
    few = work.select(flags.alias("m")).distinct().limit(MAX_MASKS + 1).count() <= MAX_MASKS if order else False
    if few:
        grams = _mask_grams(work, names, mean, spread)
        turns = {mask: _started(mask) for mask in grams}
        cells = {t: sum(grams[m][-1, -1] for m in grams if m[t] == "1") for t in order}
        for _ in range(max_iter):
            moved = 0.0
            for t in order:
                weights = solved(sum(turns[m] @ g @ turns[m].T for m, g in grams.items() if m[t] == "0"), t)
                steps.append((t, weights))
                for mask, turn in turns.items():
                    if mask[t] == "1":
                        was = turn[t].copy()
                        _filled(turn, t, weights)
                        moved += float((turn[t] - was) @ grams[mask] @ (turn[t] - was)) / cells[t]
            if moved < len(order) * tol ** 2:
                break
    elif order:
        steps = _rounds_by_rows(work, names, mean, spread, order, max_iter, tol, solved)

    def apply(other: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def fill(values: pd.Series) -> pd.Series:
            x = np.array([np.asarray(v, dtype=float) for v in values], dtype=float).reshape(-1, size - 1)
            gaps = np.isnan(x)
            z = np.column_stack([np.where(gaps, 0.0, (x - np.array(mean)) / np.array(spread)), np.ones(len(x))])
            out = np.zeros(x.shape)
            kinds, which = np.unique(gaps, axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                turn = _started("".join("01"[int(g)] for g in kind))
                for target, weights in steps:
                    if kind[target]:
                        _filled(turn, target, weights)
                rows = which.ravel() == k
                out[rows] = (z[rows] @ turn.T)[:, :-1] * np.array(spread) + np.array(mean)
            return pd.Series(list(out), dtype=object)

        if not steps:
            return other
        ready = other.withColumn("_filled", fill(F.array(*[c(n).cast("double") for n in names])))
        return ready.select(*[F.coalesce(c(n).cast("double"), F.col("_filled")[names.index(n)]).alias(n) if n in names and names.index(n) in order
                              else c(n) for n in other.columns])

    return Fitted(apply, {"steps": [(names[t], w.tolist()) for t, w in steps], "rounds": len(steps) // max(1, len(order))})


def _rounds_by_rows(df: DataFrame, names: list[str], mean: list[float], spread: list[float], order: list[int], max_iter: int, tol: float, solved) -> list:
    """The same rounds for very many patterns: filled rows are kept by a checkpoint, one Gram matrix is added up per column and round."""
    from tabloom.session import cut_lineage

    size = len(names) + 1
    kept = F.array(*[((c(n).cast("double") - mean[i]) / spread[i]) for i, n in enumerate(names)])
    work = cut_lineage(df.select(kept.alias("o")).withColumn("x", F.transform("o", lambda v: F.coalesce(v, F.lit(0.0)))))
    arrays = lambda column: np.array([np.asarray(v, dtype=float) for v in column], dtype=float).reshape(-1, size - 1)
    steps: list[tuple[int, np.ndarray]] = []
    for _ in range(max_iter):
        moved = 0.0
        for t in order:
            def partial(batches, t=t):
                total = np.zeros((size, size))
                for batch in batches:
                    x, known = arrays(batch["x"]), ~np.isnan(arrays(batch["o"])[:, t])
                    z = np.column_stack([x, np.ones(len(x))])[known]
                    total += z.T @ z
                yield pd.DataFrame({"part": [total.ravel()]})

            cells = work.mapInPandas(partial, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
            gram = np.zeros(size * size)
            for cell in cells:
                gram[cell["i"]] = cell["v"]
            weights = solved(gram.reshape(size, size), t)
            steps.append((t, weights))

            def refill(batches, t=t, weights=weights):
                for batch in batches:
                    x, gap = arrays(batch["x"]), np.isnan(arrays(batch["o"])[:, t])
                    new = np.column_stack([np.delete(x, t, axis=1), np.ones(len(x))]) @ weights
                    change = np.where(gap, new - x[:, t], 0.0)
                    x[gap, t] = new[gap]
                    yield pd.DataFrame({"o": batch["o"], "x": pd.Series(list(x), index=batch.index, dtype=object), "g": gap.astype("int32"), "c": change ** 2})

            now = cut_lineage(work.mapInPandas(refill, "o array<double>, x array<double>, g int, c double"))
            change = now.agg(F.sum("c").alias("c"), F.sum("g").alias("g")).first()
            moved += (change["c"] or 0.0) / max(1, change["g"] or 0)
            work = now.select("o", "x")
        if moved < len(order) * tol ** 2:
            break
    return steps


def iterative_impute(df: DataFrame, max_iter: int = 10, columns: list[str] | None = None,
                     exclude: list[str] | None = None, tol: float = 1e-3) -> DataFrame:
    return fit_iterative_impute(df, max_iter, columns, exclude, tol).transform(df)
