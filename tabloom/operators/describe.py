"""Exploratory statistics and chart data. Aggregates use every row; only point charts sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.columns import (c, categorical_columns, is_integer, is_numeric, numeric_columns, require_column,
                                       require_numeric, string_columns)
from tabloom.functions.pvalues import normal_quantile, t_two_sided
from tabloom.functions.seeded import seeded_key
from tabloom.operators import aggregate
from tabloom.operators.clean import constant_columns, pairwise_correlations
from tabloom.operators.impute import null_counts
from tabloom.operators.joins import lookup_join
from tabloom.operators.ordered import steps
from tabloom.operators.quantiles import exact_quantiles, grouped_quantiles
from tabloom.operators.series import adf_test

# fixed values: largest Shapiro-Wilk sample and the advice texts
SHAPIRO_ROWS = 5_000
JOINT_CELLS = 100_000        # counts a task holds before it passes them on
LOOKS_NORMAL = "Close to a normal distribution."
NOT_NORMAL = "Far from a normal distribution; a log, power or quantile transform may help."


def _frame(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) for every ordered pair, the diagonal included."""
    names = numeric_columns(df, columns)
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns.")
    found = pairwise_correlations(df, names)
    rows = [(n, n, 1.0) for n in names] + [t for (a, b), (r, _) in found.items() for t in ((a, b, r), (b, a, r))]
    return _frame(df, rows, "col_a string, col_b string, r double")


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """Correlation of each numeric column with the target, strongest first; top five per sign marked."""
    require_column(df, target, "target_column")
    if not is_numeric(df, target):
        raise ValueError(f"The target {target!r} is not numeric.")
    found = {a: r for (a, _), (r, _) in pairwise_correlations(df, [n for n in numeric_columns(df) if n != target], [target]).items()}
    ranked = sorted(found, key=lambda n: (found[n] is None, -abs(found[n] or 0.0), n))
    positive = [n for n in ranked if (found[n] or 0) > 0][:5]
    negative = [n for n in ranked if (found[n] or 0) < 0][:5]
    rows = [(i + 1, n, found[n], n in positive, n in negative) for i, n in enumerate(ranked)]
    return _frame(df, rows, "rank int, column string, r double, top_positive boolean, top_negative boolean")


def correlation_significance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """r, complete pairs and two-sided t-based p for every numeric pair."""
    rows = []
    for (a, b), (r, n) in pairwise_correlations(df, numeric_columns(df, columns)).items():
        p = None
        if r is not None and n > 2:
            p = 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((a, b, r, n, p))
    return _frame(df, rows, "col_a string, col_b string, r double, n long, p double")


def _bins(x: np.ndarray, edges: list[float]) -> np.ndarray:
    """``right_closed_code`` of values without NULL, -1 outside; NaN is the largest value, as in Spark."""
    above = lambda e: (x > e) | (np.isnan(x) & ~np.isnan(e))
    if len(edges) < 2:
        return np.full(len(x), -1)
    return np.where(~above(edges[-1]) & ((x >= edges[0]) | np.isnan(x)), sum((above(e).astype(np.int64) for e in edges[1:-1]), np.zeros(len(x), np.int64)), -1)


def _joint_counts(edges: list[list[float]], target_edges: list[float] | None):
    """Per task the rows of every (feature, bin, target bin or class); the last column is the target, its values are classes without edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}

        def rows() -> pa.RecordBatch:
            feature, x, y = zip(*found) if found else ((), (), ())
            out = pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(x, pa.int32()), pa.array(y, pa.string()), pa.array(list(found.values()), pa.int64())],
                                             ["feature", "x", "y", "n"])
            found.clear()
            return out

        for batch in batches:
            if target_edges is None:
                classes = batch.column(len(edges)).dictionary_encode()
                code, names = classes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), classes.dictionary.to_pylist()
            else:
                code, names = _bins(batch.column(len(edges)).to_numpy(zero_copy_only=False), target_edges), [str(i) for i in range(len(target_edges))]
            for i, mine in enumerate(edges):
                width = len(mine) + 1
                x = _bins(batch.column(i).to_numpy(zero_copy_only=False), mine) if len(mine) > 1 else np.zeros(len(code), np.int64)
                counts = np.bincount((code + 1) * width + x + 1)
                for cell in np.flatnonzero(counts).tolist():
                    y, v = cell // width - 1, cell % width - 1
                    key = i, None if v < 0 else v, None if y < 0 else names[y]
                    found[key] = found.get(key, 0) + int(counts[cell])
            if len(found) > JOINT_CELLS:
                yield rows()
        yield rows()
    return run


def mutual_information(df: DataFrame, target: str, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of each numeric feature with the target, medians filled in.

    One set of passes finds the edges of all features and of a numeric target. Tasks count their rows by (feature, bin, target bin),
    at most features x bins x target classes, and these counts are added up.
    """
    require_column(df, target, "target_column")
    names = [n for n in numeric_columns(df, columns) if n != target]
    if not names:
        raise ValueError("No numeric column beside the target.")
    known = df.where(c(target).isNotNull())
    classes = aggregate.infer_task_type(known, target) == "classification"
    found = exact_quantiles(known, names if classes else [*names, target], [i / bins for i in range(bins + 1)] + [0.5])
    edges = {n: sorted({v for v in q[:-1] if v is not None}) for n, q in found.items()}
    values = [F.coalesce(c(n).cast("double"), F.lit(found[n][-1]).cast("double")).alias(f"v{i}") for i, n in enumerate(names)]
    table = known.select(*values, c(target).cast("string" if classes else "double").alias("y"))
    counted = table.mapInArrow(_joint_counts([edges[n] for n in names], None if classes else edges[target]), "feature int, x int, y string, n long")
    cells = (counted.groupBy("feature", "x", "y").agg(F.sum("n").alias("n"))
             .withColumn("feature", F.array(*[F.lit(n) for n in names])[F.col("feature")]))
    feature = Window.partitionBy("feature")
    total, nx, ny = F.sum("n").over(feature), F.sum("n").over(Window.partitionBy("feature", "x")), F.sum("n").over(Window.partitionBy("feature", "y"))
    term = F.col("n") / total * F.log(F.col("n") * total / (nx * ny))
    return (cells.select("feature", term.alias("t")).groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mutual_information"))
            .orderBy(F.desc("mutual_information"), "feature"))


def _dagostino(n: int, skew: float, kurt: float) -> tuple[float, float]:
    """K2 of D'Agostino (1970) for skewness and Anscombe & Glynn (1983) for kurtosis; p by chi-square with 2 df."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - mean) / math.sqrt(var)
    beta = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + math.sqrt(1 + 4 / beta ** 2))
    base = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k2 = z_skew ** 2 + z_kurt ** 2
    return k2, math.exp(-k2 / 2)


# fixed values: polynomial coefficients of Royston's (1995) Shapiro-Wilk approximation, lowest power first
ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
ROYSTON_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_LARGE_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients, x: float) -> float:
    return sum(k * x ** i for i, k in enumerate(coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of a bounded sample (3 to 5000 values)."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = float(m @ m)
    a = np.zeros(n)
    u = 1 / math.sqrt(n)
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0.0, math.sqrt(0.5))
    else:
        a[-1] = m[-1] / math.sqrt(ss) + _poly(ROYSTON_LAST, u)
        a[0] = -a[-1]
        if n > 5:
            a[-2] = m[-2] / math.sqrt(ss) + _poly(ROYSTON_SECOND, u)
            a[1] = -a[-2]
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
    w = min(1.0, float((a @ x) ** 2 / np.sum((x - x.mean()) ** 2)))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    tail = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if tail >= gamma:
            return w, 0.0
        z = (-math.log(gamma - tail) - _poly(ROYSTON_SMALL_MEAN, n)) / math.exp(_poly(ROYSTON_SMALL_SD, n))
    else:
        log_n = math.log(n)
        z = (tail - _poly(ROYSTON_LARGE_MEAN, log_n)) / math.exp(_poly(ROYSTON_LARGE_SD, log_n))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def normality_test(df: DataFrame, column: str, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Moments and K2 over all rows; Shapiro-Wilk, defined for at most 5000 values, over a seeded sample."""
    require_numeric(df, column)
    x = c(column).cast("double")
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                 F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt")).first()
    n = row["n"]
    k2 = p = w = wp = None
    if n >= 8 and row["std"]:
        k2, p = _dagostino(n, row["skew"], row["kurt"])
    if n >= 3:
        order = seeded_key(seed, *(key or [column]))
        picked = df.where(x.isNotNull()).select(x.alias("x"), order.alias("o")).orderBy("o", "x").limit(SHAPIRO_ROWS)
        w, wp = shapiro_wilk(np.array([r["x"] for r in picked.collect()]))
        w, wp = (None, None) if w != w else (w, wp)
    normal = True if p is None else p > 0.05
    advice = LOOKS_NORMAL if normal else NOT_NORMAL
    return _frame(df, [(column, n, row["mean"], row["std"], row["skew"], row["kurt"], w, wp, None if wp is None else wp > 0.05,
                        k2, p, None if p is None else p > 0.05, advice)],
                  "column string, n long, mean double, std double, skewness double, kurtosis double, shapiro_stat double, "
                  "shapiro_p double, is_normal_shapiro boolean, dagostino_stat double, dagostino_p double, "
                  "is_normal_dagostino boolean, recommendation string")


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Variance inflation on complete cases: the diagonal of the inverse correlation matrix."""
    names = numeric_columns(df, columns)
    if len(names) < 2:
        raise ValueError("Inflation takes two numeric columns.")
    found = pairwise_correlations(df.dropna(subset=names), names)
    size = len(names)
    matrix = np.eye(size)
    for (a, b), (r, _) in found.items():
        i, j = names.index(a), names.index(b)
        matrix[i, j] = matrix[j, i] = 0.0 if r is None else r
    # columns that others determine exactly have no finite inflation; a numerically singular inverse is noise
    singular = np.linalg.cond(matrix) > 1e14
    diagonal = np.full(size, np.inf) if singular else np.diag(np.linalg.inv(matrix))
    if singular:
        for i in range(size):
            others = [j for j in range(size) if j != i]
            fit = np.linalg.lstsq(matrix[np.ix_(others, others)], matrix[others, i], rcond=1e-12)[0]
            rest = 1 - float(matrix[others, i] @ fit)
            diagonal[i] = 1 / rest if rest > 1e-10 else np.inf
    rows = [(n, float(np.round(v, 2)), bool(v > 10)) for n, v in zip(names, diagonal)]
    return _frame(df, rows, "column string, vif double, high boolean")


def value_counts(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    require_column(df, column)
    return (df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "value").limit(top_n))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count) of equal-width bins, empty bins included, the last edge in the last bin."""
    require_numeric(df, column)
    x = c(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return _frame(df, [], "bin int, low double, high double, count long")
    width = (high - low) / bins
    index = F.lit(1) if width == 0 else F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counted = df.where(x.isNotNull()).groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), (F.lit(low) + F.col("bin") * width).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"))


def seeded_sample(df: DataFrame, max_rows: int, key: list[str], seed: int = 42) -> DataFrame:
    """Uniform sample without replacement, the same rows on every run; rows come in sample order."""
    return df.orderBy(seeded_key(seed, *key), *[c(k) for k in key]).limit(max_rows)


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], max_rows: int, color: str | None = None, seed: int = 42) -> DataFrame:
    names = list(dict.fromkeys([require_column(df, x), require_column(df, y)] + ([color] if color else [])))
    return seeded_sample(df, max_rows, key, seed).select(*[c(n) for n in names])


def pairplot_sample(df: DataFrame, key: list[str], columns: list[str], max_rows: int, color: str | None = None, seed: int = 42) -> DataFrame:
    """A seeded sample of the numeric ones of ``columns``."""
    names = numeric_columns(df, columns)
    if len(names) < 2:
        raise ValueError("Pairs take two numeric columns.")
    return seeded_sample(df, max_rows, key, seed).select(*[c(n) for n in names], *([c(color)] if color else []))


def box_stats(df: DataFrame, column: str, group_by: str | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers and outlier count, per group when asked."""
    require_numeric(df, column)
    work = df.withColumn("_all", F.lit("all")) if group_by is None else df
    group = group_by or "_all"
    stats = grouped_quantiles(work, [group], column, [0.25, 0.5, 0.75])
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    stats = stats.select(c(group), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
                         (F.col("q")[0] - reach).alias("lower_fence"), (F.col("q")[2] + reach).alias("upper_fence"))
    x = c(column).cast("double")
    within = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    placed = lookup_join(work.select(c(group), c(column)), stats, [group], "n").where(x.isNotNull() & c(group).isNotNull())
    fixed = [F.first(n).alias(n) for n in ("q1", "median", "q3", "lower_fence", "upper_fence")]
    out = placed.groupBy(c(group)).agg(F.count("*").alias("n"), *fixed, F.min(F.when(within, x)).alias("whisker_low"),
                                       F.max(F.when(within, x)).alias("whisker_high"), F.count_if(~within).alias("outliers"))
    return out if group_by else out.drop("_all")


def violin_density(df: DataFrame, column: str, group_by: str | None = None, bins: int = 64) -> DataFrame:
    """Gaussian-smoothed histogram per group at ``bins`` centres (Scott bandwidth from binned moments).

    Each (group, bin) count is spread over the fixed set of centres, so the work after the first
    aggregation is groups x bins x bins whatever the row count.
    """
    require_numeric(df, column)
    work = df if group_by else df.withColumn("_all", F.lit("all"))
    group = group_by or "_all"
    x = c(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        raise ValueError(f"Column '{column}' has no spread.")
    width = (high - low) / bins
    index = F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    counted = work.where(x.isNotNull()).groupBy(c(group), index.alias("b")).agg(F.count("*").alias("n"))
    moments = work.groupBy(c(group)).agg(F.count(x).alias("total"), F.stddev_samp(x).alias("sd"))
    band = F.greatest(F.coalesce(F.col("sd"), F.lit(0.0)) * F.pow(F.col("total").cast("double"), F.lit(-0.2)), F.lit(width / 2))
    spread = counted.join(moments, group).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    gap = (F.col("at") - F.col("b")) * F.lit(width) / band
    density = F.sum(F.col("n") * F.exp(-0.5 * gap * gap) / (band * math.sqrt(2 * math.pi) * F.col("total")))
    out = spread.groupBy(c(group), "at").agg(density.alias("density"))
    out = out.select(c(group), (F.lit(low) + (F.col("at") + 0.5) * width).alias("x"), "density")
    return out if group_by else out.drop("_all")


def missing_pattern(df: DataFrame) -> DataFrame:
    """(pattern, rows): which columns are NULL together, over the whole table; 1 marks a NULL."""
    if not any(null_counts(df).values()):
        raise ValueError("No missing values.")
    bits = F.concat(*[F.when(c(n).isNull(), "1").otherwise("0") for n in df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("rows"))


def missing_mask(df: DataFrame, order_by: list[str], max_rows: int) -> DataFrame:
    """NULL mask of the first ``max_rows`` rows along an order."""
    return df.orderBy(*[c(n) for n in order_by]).limit(max_rows).select(*[c(n).isNull().alias(n) for n in df.columns])


def line_series(df: DataFrame, x: str, ys: list[str], color: str | None = None, slices: int | None = None) -> DataFrame:
    """Sorted points; with ``slices`` the mean in each of so many equal slices of the x range."""
    names = [require_column(df, x)] + [require_column(df, y) for y in ys] + ([color] if color else [])
    known = df.where(c(x).isNotNull())
    if slices is None:
        return known.select(*[c(n) for n in names]).orderBy(c(x))
    stamp = not is_numeric(df, x)
    key = F.unix_micros(c(x).cast("timestamp")) if stamp else c(x).cast("double")
    low, high = known.agg(F.min(key), F.max(key)).first()
    if low is None:
        return known.select(*[c(n) for n in names])
    step = (high - low) / slices or 1
    slot = F.least(F.floor((key - F.lit(low)) / F.lit(step)), F.lit(slices - 1)).cast("long")
    group = [slot.alias("_slot")] + ([c(color)] if color else [])
    at = F.min(c(x)).alias(x)
    out = known.groupBy(*group).agg(at, *[F.avg(c(y)).alias(y) for y in ys])
    return out.select(*[c(n) for n in names]).orderBy(c(x))


def qq_points(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Normal against sample quantiles at plotting positions, with the least-squares line through them."""
    require_numeric(df, column)
    n = df.agg(F.count(c(column))).first()[0]
    if n < 2:
        raise ValueError("Need at least 2 values.")
    m = min(points, n)
    probs = [(i - 0.5) / m for i in range(1, m + 1)]
    sample = exact_quantiles(df, [column], probs)[column]
    theory = [normal_quantile(p) for p in probs]
    slope, intercept = np.polyfit(theory, sample, 1) if m > 1 else (0.0, sample[0])
    rows = [(float(t), float(s), float(slope), float(intercept)) for t, s in zip(theory, sample)]
    return _frame(df, rows, "theoretical double, sample double, slope double, intercept double")


# fixed values: words in a column name that suggest the target or the future
TARGET_WORDS = ("result", "flag", "label", "outcome", "y_", "target", "score", "approved", "churn", "default")
FUTURE_WORDS = ("final", "outcome", "actual", "post", "result")
LEAKAGE_R = 0.95
UNIQUE_SHARE = 0.95
UUID_PATTERN = "^\\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\\}?$"
UUID_SHARE = 0.95
MONOTONE_SHARE = 0.99
TREND_STRETCHES = 10
ADF_P = 0.05


def _identifier_trends(df: DataFrame, target: str, ids: list[str]) -> list[tuple[str, str, str]]:
    """Integer identifiers along which the target's mean rises, or falls, over every one of ten equal stretches."""
    cuts = {n: sorted({q for q in found if q is not None})
            for n, found in exact_quantiles(df, ids, [i / TREND_STRETCHES for i in range(1, TREND_STRETCHES)]).items()} if ids else {}
    ids = [n for n in ids if len(cuts[n]) == TREND_STRETCHES - 1]
    if not ids:
        return []
    aggs = []
    for i, n in enumerate(ids):
        bounds = [float("-inf"), *cuts[n], float("inf")]
        value = c(n).cast("double")
        aggs += [F.avg(F.when((value > F.lit(low)) & (value <= F.lit(high)), c(target))).alias(f"m{i}_{k}") for k, (low, high) in enumerate(zip(bounds, bounds[1:]))]
    row = df.agg(*aggs).first()
    found = []
    for i, n in enumerate(ids):
        means = [row[f"m{i}_{k}"] for k in range(TREND_STRETCHES)]
        if None in means:
            continue
        for word, ordered_means in (("rises", means), ("falls", means[::-1])):
            if all(a < b for a, b in zip(ordered_means, ordered_means[1:])):
                found.append((n, "identifier_trend", f"mean of the target {word} over {TREND_STRETCHES} stretches"))
    return found


def leakage_scan(df: DataFrame, target: str, order_by: list[str] | None = None) -> DataFrame:
    """(column, rule, evidence): columns that may tell a model the target, or the row.

    - ``target_proxy``: correlation with the target above 0.95; ``semantic_name``, ``future_name``: telling words in the name.
    - ``identifier``: integers or strings that are nearly unique; ``uuid_identifier``: strings that nearly all look like UUIDs.
    - ``identifier_trend``: a nearly unique integer along which the target's mean moves one way over ten equal stretches.
    - ``monotone_identifier``: a nearly unique column that rises, or falls, in 99 % of the steps along ``order_by`` (columns that end in a
      unique key; without them the rows have no order to follow). NULLs are passed over.

    Distinct counts and patterns come from one aggregate; stretches from exact quantiles and one more; steps from one pass over ordered buckets.
    """
    require_column(df, target, "target_column")
    found = []
    if is_numeric(df, target):
        for (n, _), (r, _k) in pairwise_correlations(df, [n for n in numeric_columns(df) if n != target], [target]).items():
            if r is not None and abs(r) > LEAKAGE_R:
                found.append((n, "target_proxy", f"r={r:.4f}"))
    others = [n for n in df.columns if n != target]
    for n in others:
        low = n.lower()
        found += [(n, "semantic_name", w) for w in TARGET_WORDS if w in low]
        found += [(n, "future_name", w) for w in FUTURE_WORDS if w in low]
    texts = [n for n in others if n in string_columns(df)]
    ids = [n for n in others if is_integer(df, n) or n in texts]
    if ids:
        row = df.agg(*[a for i, n in enumerate(ids) for a in (F.count_distinct(c(n)).alias(f"u{i}"), F.count(c(n)).alias(f"n{i}"))],
                     *[F.count_if(c(n).rlike(UUID_PATTERN)).alias(f"p{ids.index(n)}") for n in texts]).first()
        known = {n: row[f"n{i}"] for i, n in enumerate(ids)}
        unique = [n for i, n in enumerate(ids) if known[n] and row[f"u{i}"] / known[n] > UNIQUE_SHARE]
        found += [(n, "identifier", f"{row[f'u{ids.index(n)}']} of {known[n]} distinct") for n in unique]
        found += [(n, "uuid_identifier", f"{row[f'p{ids.index(n)}']} of {known[n]} like a UUID") for n in texts
                  if known[n] and row[f"p{ids.index(n)}"] / known[n] > UUID_SHARE]
        if is_numeric(df, target):
            found += _identifier_trends(df, target, [n for n in unique if is_integer(df, n)])
        if order_by and unique:
            for n, (count, rises, falls) in steps(df, order_by, unique).items():
                found += [(n, "monotone_identifier", f"{word} in {k} of {count} steps") for word, k in (("rises", rises), ("falls", falls))
                          if count and k / count >= MONOTONE_SHARE]
    return _frame(df, found, "column string, rule string, evidence string")


def quality_recommendations(df: DataFrame, target: str | None = None, order_by: list[str] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """(column, finding, operator): the rule table applied to the measured quality of each column.

    With ``order_by`` the rows are a series, or one per ``group_by``: the target, or without one every numeric column, is tested for a unit root
    (ADF, p > 0.05 in any series).
    """
    rows: list[tuple[str, str, str]] = []
    total = df.count()
    gaps = null_counts(df)
    constant = set(constant_columns(df))
    numeric = numeric_columns(df)
    features = [n for n in numeric if n != target]
    for n in df.columns:
        share = gaps[n] / total if total else 0.0
        if share > 0.5:
            rows.append((n, "missing > 50 %", "drop_high_missing"))
        elif share >= 0.05:
            rows.append((n, "missing 5-50 %", "knn_impute + add_missing_indicators"))
        elif share > 0:
            rows.append((n, "missing < 5 %", "impute_missing"))
        if n in constant:
            rows.append((n, "constant", "drop_constant"))
    if numeric:
        skews = df.agg(*[F.skewness(c(n)).alias(f"s{i}") for i, n in enumerate(numeric)]).first()
        for i, n in enumerate(numeric):
            if skews[f"s{i}"] is not None and skews[f"s{i}"] > 1.5:
                rows.append((n, "skewness > 1.5", "target_log_transform" if n == target else "log_transform"))
        for r in aggregate.outlier_summary(df.select(*[c(n) for n in features])).collect() if features else []:
            if r["iqr_pct"] is not None and r["iqr_pct"] > 10:
                rows.append((r["column"], "outlier rate > 10 %", "winsorize"))
    if order_by:
        along = set(order_by) | set(group_by or [])
        for n in [target] if target in numeric else [n for n in features if n not in along and n not in constant]:
            if adf_test(df, n, order_by, group_by).where(F.col("adf_p") > ADF_P).limit(1).count():
                rows.append((n, "ADF p > 0.05", "differencing, forecast_ar with d = 1"))
    tested = [n for n in features if n not in constant]
    if len(tested) >= 2:
        rows += [(r["column"], "VIF > 10", "drop_correlated") for r in vif(df, tested).collect() if r["high"]]
    texts = [n for n in categorical_columns(df) if n != target]
    if texts:
        row = df.agg(*[F.count_distinct(c(n)).alias(f"u{i}") for i, n in enumerate(texts)]).first()
        for i, n in enumerate(texts):
            k = row[f"u{i}"]
            how = "target_encode or hash_encode" if k > 50 else "ordinal_encode or one_hot_encode" if k >= 5 else "one_hot_encode"
            rows.append((n, "cardinality > 50" if k > 50 else "cardinality 5-50" if k >= 5 else "cardinality < 5", how))
    if target and aggregate.infer_task_type(df, target) == "classification":
        ratio = aggregate.class_balance(df, target).first()["imbalance_ratio"]
        if ratio and ratio > 5:
            rows.append((target, "class imbalance > 5", "smote + class_weight"))
    return _frame(df, rows, "column string, finding string, operator string")
