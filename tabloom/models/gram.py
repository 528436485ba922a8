"""Sums, counts and cross-product matrices of feature vectors, per class when asked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c


def cross_products(df: DataFrame, features: str, by: str | None = None, extra: str | None = None) -> dict[float, tuple[float, np.ndarray, np.ndarray]]:
    """{class: (rows, sum vector, X'X)}; ``extra`` appends a scalar column to the vector.

    Arrow batches are reduced to one matrix each before anything is shuffled; the driver receives
    classes x features^2 numbers.
    """
    vector = vector_to_array(c(features))
    if extra:
        vector = F.concat(vector, F.array(c(extra).cast("double")))
    slim = df.select((c(by).cast("double") if by else F.lit(0.0)).alias("k"), vector.alias("x"))

    def partial(batches):
        for batch in batches:
            out = []
            for key, rows in batch.groupby("k", sort=False):
                x = np.stack(rows["x"].to_numpy()).astype(float)
                out.append((key, np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])))
            yield pd.DataFrame(out, columns=["k", "part"])

    parts = slim.mapInPandas(partial, "k double, part array<double>")
    cells = parts.select("k", F.posexplode("part").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    flat: dict[float, dict[int, float]] = {}
    for cell in cells:
        flat.setdefault(cell["k"], {})[cell["i"]] = cell["v"]
    out = {}
    for k, values in flat.items():
        v = np.array([values[i] for i in range(len(values))])
        size = int((-1 + (1 + 4 * (len(v) - 1)) ** 0.5) / 2)
        out[k] = (v[0], v[1:size + 1], v[size + 1:].reshape(size, size))
    return out
