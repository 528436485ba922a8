"""Isolation forest (Liu, Ting and Zhou 2008): trees grown from small hashed subsamples, rows scored in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.columns import c, numeric_columns
from tabloom.operators.fitted import Fitted
from tabloom.operators.quantiles import exact_quantiles

TREES, SUBSAMPLE = 100, 256
NODE = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes as (node, feature, cut, left, right, size, depth); leaves have feature -1."""
    nodes: list[list] = []
    todo = [(points, 0, -1, "")]
    while todo:
        part, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][3 if side == "left" else 4] = at
        spans = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(points.shape[1])
        usable = np.nonzero(spans > 0)[0]
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes.append([at, -1, 0.0, -1, -1, len(part), depth])
            continue
        feature = int(rng.choice(usable))
        low = part[:, feature].min()
        cut = float(rng.uniform(low, low + spans[feature]))
        nodes.append([at, feature, cut, -1, -1, len(part), depth])
        below = part[:, feature] < cut
        todo.append((part[below], depth + 1, at, "left"))
        todo.append((part[~below], depth + 1, at, "right"))
    return [tuple(n) for n in nodes]


def fit_isolation_forest(df: DataFrame, columns: list[str] | None = None, exclude: list[str] | None = None,
                         target_column: str | None = None, contamination="auto", seed: int = 42,
                         trees: int = TREES, subsample: int = SUBSAMPLE, key: list[str] | None = None) -> Fitted:
    """Medians fill gaps. ``transform`` adds ``anomaly_score`` in (0, 1) and ``is_anomaly``.

    Each tree draws its own ``subsample`` rows, by a hash of ``key`` (of all columns without one: then equal rows are drawn together).
    """
    names = [n for n in numeric_columns(df, columns, exclude) if n != target_column]
    if not names:
        raise ValueError("The forest splits numeric columns, and there are none.")
    medians = {n: q[0] if q[0] is not None else 0.0 for n, q in exact_quantiles(df, names, [0.5]).items()}
    point = F.array(*[F.coalesce(c(n).cast("double"), F.lit(medians[n])) for n in names])
    rows = df.count()
    size = min(subsample, rows)
    points = df.select(point.alias("x"), F.xxhash64(*[c(n) for n in key or df.columns], F.lit(seed)).alias("h"))
    uniform = lambda *keys: F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(2 ** 53))
    # a tree draws its rows by hash; the share is so much larger that fewer than asked for come with a chance of about 1e-9
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    share = min(1.0, (size + 6 * math.sqrt(size) + 12) / max(rows, 1))
    picked = points.withColumn("tree", F.explode(F.filter(every, lambda t: uniform(F.col("h"), t) < F.lit(share))))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("h", "tree"), "x")
    sampled = picked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        matrix = np.stack(part.sort_values("rn")["x"].to_numpy()).astype(float)
        nodes = _grow(matrix, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])

    # at most trees x (2 x subsample) nodes
    grown = sampled.select("tree", "rn", "x").groupBy("tree").applyInPandas(build, NODE).toPandas().sort_values(["tree", "node"])
    forest = [(g["feature"].to_numpy(), g["cut"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(),
               g["depth"].to_numpy() + np.array([expected_depth(s) for s in g["size"]])) for _, g in grown.groupby("tree")]
    scale = expected_depth(size) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        matrix = np.stack(x.to_numpy()).astype(float)
        total = np.zeros(len(matrix))
        every = np.arange(len(matrix))
        for feature, cut, left, right, length in forest:
            at = np.zeros(len(matrix), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = matrix[every, np.maximum(feature[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return pd.Series(2.0 ** (-total / len(forest) / scale))

    def scored(other: DataFrame) -> DataFrame:
        return other.withColumn("anomaly_score", score(point))

    if contamination == "auto":
        limit_score = 0.5
    else:
        limit_score = exact_quantiles(scored(df), ["anomaly_score"], [1 - float(contamination)])["anomaly_score"][0]

    def apply(other: DataFrame) -> DataFrame:
        return scored(other).withColumn("is_anomaly", F.col("anomaly_score") > F.lit(limit_score))

    return Fitted(apply, {"threshold": limit_score})


def isolation_forest_outliers(df: DataFrame, contamination="auto", columns=None, exclude=None,
                              target_column: str | None = None, seed: int = 42) -> DataFrame:
    fitted = fit_isolation_forest(df, columns, exclude, target_column, contamination, seed)
    return fitted.transform(df).where(~F.col("is_anomaly")).drop("anomaly_score", "is_anomaly")
