"""Scaling and numeric transforms; every statistic of a call comes from one pass."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c, is_numeric, numeric_columns, replace_columns, require_column, require_numeric
from tabloom.operators.fitted import Fitted
from tabloom.operators.quantiles import approx_quantiles, exact_quantiles, quantiles


def _names(df, columns, exclude, verb="scale"):
    names = numeric_columns(df, columns, exclude)
    if not names:
        raise ValueError(f"The selection holds no numeric column to {verb}.")
    return names


def _affine(shift: dict[str, float | None], width: dict[str, float | None]) -> Fitted:
    """(x - shift) / width; a zero width divides by 1, an all-NULL column stays NULL."""
    def apply(other: DataFrame) -> DataFrame:
        return replace_columns(other, {
            n: (c(n).cast("double") - F.lit(float(shift[n] or 0.0))) / F.lit(float(width[n] or 1.0)) for n in shift})
    return Fitted(apply, {"shift": shift, "width": width})


def fit_standard_scale(df: DataFrame, columns=None, exclude=None) -> Fitted:
    names = _names(df, columns, exclude)
    row = df.agg(*[a for i, n in enumerate(names)
                   for a in (F.avg(c(n)).alias(f"m{i}"), F.stddev_pop(c(n)).alias(f"s{i}"))]).first()
    return _affine({n: row[f"m{i}"] for i, n in enumerate(names)}, {n: row[f"s{i}"] for i, n in enumerate(names)})


def fit_minmax_scale(df: DataFrame, columns=None, exclude=None) -> Fitted:
    names = _names(df, columns, exclude)
    row = df.agg(*[a for i, n in enumerate(names)
                   for a in (F.min(c(n)).alias(f"a{i}"), F.max(c(n)).alias(f"b{i}"))]).first()
    low = {n: row[f"a{i}"] for i, n in enumerate(names)}
    return _affine(low, {n: None if low[n] is None else row[f"b{i}"] - low[n] for i, n in enumerate(names)})


def fit_robust_scale(df: DataFrame, columns=None, exclude=None, exact: bool = True) -> Fitted:
    names = _names(df, columns, exclude)
    found = quantiles(df, names, [0.25, 0.5, 0.75], exact)
    return _affine({n: q[1] for n, q in found.items()},
                   {n: None if q[0] is None else q[2] - q[0] for n, q in found.items()})


def fit_max_abs_scale(df: DataFrame, columns=None, exclude=None) -> Fitted:
    names = _names(df, columns, exclude)
    row = df.agg(*[F.max(F.abs(c(n))).alias(f"a{i}") for i, n in enumerate(names)]).first()
    return _affine({n: 0.0 for n in names}, {n: row[f"a{i}"] for i, n in enumerate(names)})


def standard_scale(df, columns=None, exclude=None):
    return fit_standard_scale(df, columns, exclude).transform(df)


def minmax_scale(df, columns=None, exclude=None):
    return fit_minmax_scale(df, columns, exclude).transform(df)


def robust_scale(df, columns=None, exclude=None, exact=True):
    return fit_robust_scale(df, columns, exclude, exact).transform(df)


def max_abs_scale(df, columns=None, exclude=None):
    return fit_max_abs_scale(df, columns, exclude).transform(df)


def _yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def fit_power_transform(df: DataFrame, method: str = "yeo-johnson", columns=None, exclude=None) -> Fitted:
    """Maximum-likelihood lambda per column (profile over a grid, refined), then standardised."""
    if method not in {"yeo-johnson", "box-cox"}:
        raise ValueError(f"Unknown power transform {method!r}: yeo-johnson and box-cox are there.")
    names = _names(df, columns, exclude, "transform")
    if method == "box-cox":
        lows = df.agg(*[F.min(c(n)).alias(f"a{i}") for i, n in enumerate(names)]).first()
        if any(v is not None and v <= 0 for v in lows):
            raise ValueError("A Box-Cox transform is defined above zero only; Yeo-Johnson takes any number.")
    change = _yeo_johnson if method == "yeo-johnson" else _box_cox
    narrow = df.select(*[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    centre, step = [0.0] * len(names), 0.5
    for _ in range(5):
        grid = [[round(mid + step * k, 10) for k in range(-10, 11)] for mid in centre]
        for i, best in _likelihood_peaks(narrow, grid, method).items():
            centre[i] = best
        step /= 10
    centre = dict(zip(names, centre))
    changed = df.select(*[change(c(n).cast("double"), centre[n]).alias(n) for n in names])
    scaler = fit_standard_scale(changed)

    def apply(other: DataFrame) -> DataFrame:
        return scaler.transform(replace_columns(other, {n: change(c(n).cast("double"), centre[n]) for n in names}))

    return Fitted(apply, {"lambdas": centre})


def _likelihood_peaks(narrow: DataFrame, grid: list[list[float]], method: str) -> dict[int, float]:
    """Best lambda of each column's grid. Arrow batches are reduced to (n, mean, M2) per lambda in the
    tasks, so what is aggregated is a few numbers per batch."""
    signed = method == "yeo-johnson"

    def moments(batches):
        for batch in batches:
            out = []
            for i, lams in enumerate(grid):
                x = batch[f"x{i}"].to_numpy(dtype=float)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                size = np.log1p(np.abs(x)) if signed else np.log(x)
                up = x >= 0 if signed else np.ones(len(x), dtype=bool)
                jacobian = float(np.sum(np.where(up, size, -size)))
                for k, lam in enumerate(lams):
                    power = np.where(up, lam, 2 - lam)
                    safe = np.where(np.abs(power) < 1e-12, 1.0, power)
                    y = np.where(np.abs(power) < 1e-12, size, np.expm1(power * size) / safe)
                    y = np.where(up, y, -y)
                    out.append((i, k, float(len(y)), float(y.mean()), float(((y - y.mean()) ** 2).sum()), jacobian))
            yield pd.DataFrame(out, columns=["i", "k", "n", "mean", "m2", "jac"])

    parts = narrow.mapInPandas(moments, "i int, k int, n double, mean double, m2 double, jac double")
    total = F.sum("n")
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.pow(F.sum(F.col("n") * F.col("mean")), 2) / total
    rows = parts.groupBy("i", "k").agg(total.alias("n"), (spread / total).alias("var"), F.sum("jac").alias("jac")).collect()
    best: dict[int, tuple[float, int]] = {}
    for row in rows:
        if row["var"] and row["var"] > 0 and math.isfinite(row["var"]):
            score = -0.5 * row["n"] * math.log(row["var"]) + (grid[row["i"]][row["k"]] - 1) * row["jac"]
            if row["i"] not in best or (score, -row["k"]) > best[row["i"]]:
                best[row["i"]] = (score, -row["k"])
    return {i: grid[i][-k] for i, (_, k) in best.items()}


def power_transform(df, method="yeo-johnson", columns=None, exclude=None):
    return fit_power_transform(df, method, columns, exclude).transform(df)


def fit_quantile_transform(df: DataFrame, output_distribution: str = "normal", n_quantiles: int = 1000,
                           columns=None, exclude=None, exact: bool = True) -> Fitted:
    """Rank-preserving map through reference quantiles, interpolated from both sides for ties.

    The quantiles are order statistics at every size; ``exact=False`` takes them from a sketch.
    """
    if output_distribution not in {"normal", "uniform"}:
        raise ValueError(f"Unknown output distribution {output_distribution!r}: normal and uniform are there.")
    names = _names(df, columns, exclude, "transform")
    rows = df.count()
    count = max(min(int(n_quantiles), rows), 2)
    share = np.linspace(0, 1, count)
    found = (exact_quantiles(df, names, share.tolist()) if exact
             else approx_quantiles(df, names, share.tolist(), 100_000))
    normal = output_distribution == "normal"

    def mapper(points: np.ndarray):
        @F.pandas_udf("double")
        def convert(values: pd.Series) -> pd.Series:
            x = values.to_numpy(dtype=float)
            u = 0.5 * (np.interp(x, points, share) - np.interp(-x, -points[::-1], -share[::-1]))
            u[np.isnan(x)] = np.nan
            if normal:
                inverse = NormalDist().inv_cdf
                u = np.array([inverse(min(max(v, 1e-7), 1 - 1e-7)) if v == v else np.nan for v in u])
            return pd.Series(u).where(~np.isnan(x), None)
        return convert

    def apply(other: DataFrame) -> DataFrame:
        return replace_columns(other, {n: mapper(np.maximum.accumulate(np.array(q, dtype=float)))(c(n).cast("double"))
                                       for n, q in found.items() if q[0] is not None})

    return Fitted(apply, {"quantiles": found})


def quantile_transform(df, output_distribution="normal", n_quantiles=1000, columns=None, exclude=None):
    return fit_quantile_transform(df, output_distribution, n_quantiles, columns, exclude).transform(df)


def _log1p_floor(name: str) -> Column:
    return F.log1p(F.when(c(name) < 0, F.lit(0)).otherwise(c(name)).cast("double"))


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    names = [n for n in (columns or []) if n in df.columns]
    if not names:
        raise ValueError("None of the columns given is numeric, so there is nothing to take logarithms of.")
    return replace_columns(df, {f"{n}_log1p": _log1p_floor(n) for n in names})


def target_log_transform(df: DataFrame, column: str) -> DataFrame:
    return replace_columns(df, {require_numeric(df, column): _log1p_floor(column)})


def bin_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct quantile edges, lowest and highest included."""
    found = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
    return sorted({v for v in found if v is not None})


def right_closed_code(x: Column, edges: list[float]) -> Column:
    """0-based bin of x in (edge, edge] intervals, the lowest edge included; NULL outside."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    code = F.lit(0)
    for edge in edges[1:-1]:
        code = code + F.when(x > F.lit(edge), 1).otherwise(0)
    return F.when((x >= edges[0]) & (x <= edges[-1]), code)


def fit_bin_numeric(df: DataFrame, column: str, bins: int = 5) -> Fitted:
    require_column(df, column)
    edges = bin_edges(df, column, int(bins))

    def apply(other: DataFrame) -> DataFrame:
        return replace_columns(other, {f"{column}_bin": right_closed_code(c(column).cast("double"), edges)})

    return Fitted(apply, {"edges": edges})


def bin_numeric(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    return fit_bin_numeric(df, column, bins).transform(df)


def interaction_features(df: DataFrame, pairs: list) -> DataFrame:
    new = {f"{p[0]}_x_{p[1]}": c(p[0]) * c(p[1]) for p in (pairs or [])
           if isinstance(p, (list, tuple)) and len(p) == 2 and all(n in df.columns and is_numeric(df, n) for n in p)}
    if not new:
        raise ValueError("No pair of the columns given is numeric on both sides.")
    return replace_columns(df, new)


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    new = {f"{n}_pow{d}": F.pow(c(n).cast("double"), F.lit(float(d))) for n in (columns or [])
           if n in df.columns and is_numeric(df, n) for d in range(2, int(degree) + 1)}
    if not new:
        raise ValueError("None of the columns given is numeric, so there are no powers to make.")
    return replace_columns(df, new)


def cyclical_encode(df: DataFrame, column: str, period: float) -> DataFrame:
    require_numeric(df, column)
    if period is None:
        raise ValueError("Give the length of the cycle, such as 24 for hours of a day.")
    angle = F.lit(2 * math.pi) * c(column) / F.lit(float(period))
    return replace_columns(df, {f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})


def fourier_features(df: DataFrame, column: str | None = None, period: float | None = None, order: int = 3,
                     time_column: str | None = None) -> DataFrame:
    """Sine and cosine terms of a position; a date becomes whole days since the earliest one."""
    name = require_column(df, column or time_column)
    if period is None:
        raise ValueError("Give the length of the season in steps of the column.")
    if is_numeric(df, name):
        position = c(name).cast("double")
    else:
        from tabloom.operators.dates import parsed_timestamp

        stamp = parsed_timestamp(df, name)
        first = df.agg(F.min(F.unix_micros(stamp))).first()[0]
        if first is None:
            raise ValueError(f"Column {name!r} holds neither numbers nor dates.")
        position = F.floor((F.unix_micros(stamp) - F.lit(first)) / F.lit(86_400_000_000)).cast("double")
    new = {}
    for k in range(1, max(1, int(order)) + 1):
        angle = F.lit(2 * math.pi * k) * position / F.lit(float(period))
        new[f"fourier_{name}_sin{k}"] = F.sin(angle)
        new[f"fourier_{name}_cos{k}"] = F.cos(angle)
    return replace_columns(df, new)
