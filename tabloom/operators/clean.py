"""Column selection, de-duplication, outlier filters, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import c, existing, is_numeric, numeric_columns, replace_columns, require_column
from tabloom.operators.fitted import Fitted
from tabloom.operators.quantiles import exact_quantiles, quantiles

PAIRS_PER_PASS = 400


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c(n) for n in existing(df, columns)])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*existing(df, columns))


def rename_columns(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    known = {old: new for old, new in (rename or {}).items() if old in df.columns}
    if not known:
        raise ValueError("The table has none of the columns to rename.")
    return df.withColumnsRenamed(known)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row duplicates; NULLs count as equal."""
    return df.dropDuplicates()


def drop_high_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    if not df.columns:
        return df
    row = df.agg(*[F.avg(c(n).isNull().cast("int")).alias(f"m{i}") for i, n in enumerate(df.columns)]).first()
    keep = [n for i, n in enumerate(df.columns) if row[f"m{i}"] is not None and row[f"m{i}"] <= threshold]
    return df.select(*[c(n) for n in keep])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, NULL counted as a value; one pass, no distinct."""
    names = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    aggs = [F.count("*").alias("n")]
    for i, n in enumerate(names):
        aggs += [F.min(c(n)).eqNullSafe(F.max(c(n))).alias(f"e{i}"), F.count(c(n)).alias(f"c{i}")]
    row = df.agg(*aggs).first()
    return [n for i, n in enumerate(names) if row[f"e{i}"] and row[f"c{i}"] in (0, row["n"])]


def drop_constant(df: DataFrame) -> DataFrame:
    constant = constant_columns(df)
    if not constant:
        raise ValueError("Every column varies.")
    return df.drop(*constant)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are known, NULL where one of them does not vary there."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    r = F.covar_pop(x, y) / F.when(spread > 0, spread)
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def pairwise_correlations(df: DataFrame, columns: list[str],
                          partners: list[str] | None = None) -> dict[tuple[str, str], tuple[float | None, int]]:
    """{(a, b): (Pearson r, complete pairs)} for a before b; NULL-safe per pair."""
    if partners is None:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    else:
        pairs = [(a, b) for a in columns for b in partners if a != b]
    found: dict[tuple[str, str], tuple[float | None, int]] = {}
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        block = pairs[start:start + PAIRS_PER_PASS]
        aggs = []
        for i, (a, b) in enumerate(block):
            x, y = c(a).cast("double"), c(b).cast("double")
            aggs += [pearson(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
        row = df.agg(*aggs).first()
        for i, pair in enumerate(block):
            r = row[f"r{i}"]
            found[pair] = (None if r is None or r != r else r, row[f"n{i}"])
    return found


def correlated_columns(df: DataFrame, threshold: float = 0.95) -> list[str]:
    """The later column of every pair whose absolute correlation exceeds the threshold."""
    columns = numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("A correlation takes two numeric columns.")
    correlations = pairwise_correlations(df, columns)
    late = {b for (a, b), (r, _) in correlations.items() if r is not None and abs(r) > threshold}
    return [n for n in columns if n in late]


def drop_correlated(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    late = correlated_columns(df, threshold)
    if not late:
        raise ValueError(f"No pair of columns correlates beyond {threshold}.")
    return df.drop(*late)


def filter_outliers(df: DataFrame, mode: str = "sequential") -> DataFrame:
    """IQR fences at 1.5. Sequential: each column's quartiles come from the rows left so far."""
    columns = numeric_columns(df)
    if mode == "simultaneous":
        found = exact_quantiles(df, columns, [0.25, 0.75])
        keep = F.lit(True)
        for n in columns:
            keep = keep & _fence(n, found[n])
        return df.where(keep)
    for n in columns:
        df = df.where(_fence(n, exact_quantiles(df, [n], [0.25, 0.75])[n]))
    return df


def _fence(name: str, quartiles: list[float | None]):
    low, high = quartiles
    if low is None or high - low <= 0:
        return F.lit(True)
    reach = 1.5 * (high - low)
    return c(name).between(low - reach, high + reach)


def zscore_outlier_removal(df: DataFrame, threshold: float = 3.0, columns=None, exclude=None,
                           target_column: str | None = None) -> DataFrame:
    """Rows whose every tested value lies within ``threshold`` population deviations; NULL passes."""
    names = [n for n in numeric_columns(df, columns, exclude) if n != target_column]
    if not names:
        raise ValueError("The table has no numeric column to score.")
    row = df.agg(*[a for i, n in enumerate(names)
                   for a in (F.avg(c(n)).alias(f"m{i}"), F.stddev_pop(c(n)).alias(f"s{i}"))]).first()
    keep = F.lit(True)
    for i, n in enumerate(names):
        mean, spread = row[f"m{i}"], row[f"s{i}"]
        if spread:
            keep = keep & F.coalesce(F.abs((c(n) - mean) / spread) <= threshold, F.lit(True))
    return df.where(keep)


def _clipped(col, low, high):
    out = col
    if low is not None:
        out = F.when(col < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(col > F.lit(high), F.lit(high)).otherwise(out)
    return out


def clip_values(df: DataFrame, column: str, min=None, max=None) -> DataFrame:
    require_column(df, column)
    if min is None and max is None:
        raise ValueError("Give a lower or an upper bound.")
    return replace_columns(df, {column: _clipped(c(column), min, max)})


def fit_winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99, columns=None,
                  exclude=None, exact: bool = True) -> Fitted:
    if not 0 <= lower < upper <= 1:
        raise ValueError(f"Shares must rise from 0 to 1, not from {lower} to {upper}.")
    names = numeric_columns(df, columns, exclude)
    if not names:
        raise ValueError("The table has no numeric column to pull in.")
    limits = quantiles(df, names, [lower, upper], exact)
    limits = {n: v for n, v in limits.items() if v[0] is not None}

    def apply(other: DataFrame) -> DataFrame:
        return replace_columns(other, {n: _clipped(c(n).cast("double"), *v) for n, v in limits.items()})

    return Fitted(apply, {"limits": limits})


def winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99, columns=None,
              exclude=None, exact: bool = True) -> DataFrame:
    return fit_winsorize(df, lower, upper, columns, exclude, exact).transform(df)


def filter_target_not_null(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[require_column(df, target, "target_column")])
