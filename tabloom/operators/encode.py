"""Categorical encodings; learned tables are joined, never mapped value by value in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c, categorical_columns, is_numeric, replace_columns, require_column, string_columns
from tabloom.functions.seeded import seeded_fraction
from tabloom.operators.fitted import Fitted
from tabloom.operators.joins import lookup_join
from tabloom.operators.ordered import prefix_counts

MAX_EXPANDED = 1_000         # columns one-hot and hash encoding may add per column
MISSING_CATEGORY = "__nan__"  # fixed value: the name NULL takes as an ordinal category


def category_levels(df: DataFrame, column: str, limit: int) -> list:
    """Sorted distinct non-NULL values, at most ``limit + 1`` of them read to the driver."""
    rows = (df.select(c(column).alias("v")).where(F.col("v").isNotNull()).distinct()
            .limit(limit + 1).collect())
    return sorted(r["v"] for r in rows)


def fit_one_hot_encode(df: DataFrame, columns: list[str] | None = None, max_unique: int = 15) -> Fitted:
    if columns:
        levels = {n: category_levels(df, n, MAX_EXPANDED) for n in columns if n in df.columns}
        wide = [n for n, v in levels.items() if len(v) > MAX_EXPANDED]
        if wide:
            raise ValueError(f"Too many categories to one-hot encode: {wide}. Use hash_encode or target_encode.")
    else:
        levels = {n: category_levels(df, n, max_unique) for n in string_columns(df)}
        levels = {n: v for n, v in levels.items() if len(v) <= max_unique}
    if not levels:
        raise ValueError("No column is fit for one-hot encoding.")

    def apply(other: DataFrame) -> DataFrame:
        kept = [c(n) for n in other.columns if n not in levels]
        flags = [F.coalesce(c(n) == F.lit(v), F.lit(False)).alias(f"{n}_{v}") for n, vs in levels.items() for v in vs]
        return other.select(*kept, *flags)

    return Fitted(apply, {"levels": levels})


def one_hot_encode(df, columns=None, max_unique=15):
    return fit_one_hot_encode(df, columns, max_unique).transform(df)


def _joined(other: DataFrame, table: DataFrame, column: str, value: str, count: str | None,
            text: bool = False) -> tuple[DataFrame, str]:
    """``other`` with the table's value for ``column`` under a scratch name."""
    scratch = f"_{column}__{value}"
    table = table.select(F.col("key").alias("_key_" + column), F.col(value).alias(scratch),
                         *([F.col(count).alias("_cnt")] if count else []))
    key = F.coalesce(c(column).cast("string"), F.lit(MISSING_CATEGORY)) if text else c(column)
    keyed = other.withColumn("_key_" + column, key)
    out = lookup_join(keyed, table, ["_key_" + column], "_cnt" if count else None)
    return out.drop("_key_" + column), scratch


def fit_ordinal_encode(df: DataFrame, columns: list[str] | None = None) -> Fitted:
    """Codes by sorted category, NULL being a category of its own; unseen values become -1."""
    names = categorical_columns(df, columns)
    if not names:
        raise ValueError("No column is fit for ordinal encoding.")
    tables = {}
    for n in names:
        text = not is_numeric(df, n)
        key = F.coalesce(c(n).cast("string"), F.lit(MISSING_CATEGORY)) if text else c(n)
        counted = df.groupBy(key.alias("key")).agg(F.count("*").alias("cnt"), F.lit(1).alias("one"))
        tables[n] = (prefix_counts(counted, [], ["key"], "one", "code").drop("one"), text)

    def apply(other: DataFrame) -> DataFrame:
        order = other.columns
        for n, (table, text) in tables.items():
            other, code = _joined(other, table, n, "code", "cnt", text)
            other = replace_columns(other, {n: F.coalesce(F.col(f"`{code}`"), F.lit(-1)).cast("int")}).drop(code)
        return other.select(*[c(n) for n in order])

    return Fitted(apply)


def ordinal_encode(df, columns=None):
    return fit_ordinal_encode(df, columns).transform(df)


def fit_label_encode(df: DataFrame, column: str, order_by: list[str]) -> Fitted:
    """Codes by first appearance along ``order_by``; NULL becomes -1."""
    require_column(df, column)
    first = F.min(F.struct(*[c(n) for n in order_by]))
    counted = (df.where(c(column).isNotNull()).groupBy(c(column).alias("key"))
               .agg(first.alias("first"), F.count("*").alias("cnt")))
    flat = counted.select("key", "cnt", F.lit(1).alias("one"),
                          *[F.col("first")[n].alias(f"o{i}") for i, n in enumerate(order_by)])
    order = [f"o{i}" for i in range(len(order_by))] + ["key"]
    table = prefix_counts(flat, [], order, "one", "code").select("key", "cnt", "code")

    def apply(other: DataFrame) -> DataFrame:
        columns = other.columns
        out, code = _joined(other, table, column, "code", "cnt")
        return replace_columns(out, {column: F.coalesce(F.col(f"`{code}`"), F.lit(-1)).cast("int")}).select(*[c(n) for n in columns])

    return Fitted(apply, {"table": table})


def label_encode(df, column, order_by):
    return fit_label_encode(df, column, order_by).transform(df)


def fit_frequency_encode(df: DataFrame, columns: list[str] | None = None, normalize: bool = True) -> Fitted:
    names = categorical_columns(df, columns)
    if not names:
        raise ValueError("No column is fit for frequency encoding.")
    tables = {}
    for n in names:
        counted = df.where(c(n).isNotNull()).groupBy(c(n).alias("key")).agg(F.count("*").alias("cnt"))
        if normalize:
            known = df.agg(F.count(c(n))).first()[0]
            freq = F.col("cnt") / F.lit(float(known or 1))
        else:
            freq = F.col("cnt")
        tables[n] = counted.withColumn("freq", freq)

    def apply(other: DataFrame) -> DataFrame:
        for n, table in tables.items():
            other, value = _joined(other, table, n, "freq", "cnt")
            other = other.withColumn(f"{n}_freq", F.coalesce(F.col(f"`{value}`"), F.lit(0))).drop(value)
        return other

    return Fitted(apply)


def frequency_encode(df, columns=None, normalize=True):
    return fit_frequency_encode(df, columns, normalize).transform(df)


def numeric_target(df: DataFrame, target: str, order_by: list[str] | None = None):
    """Numeric target as it is; a two-valued one as 0/1 by first appearance (or sorted without an order)."""
    if is_numeric(df, target):
        return c(target).cast("double")
    values = category_levels(df, target, 2)
    if len(values) != 2:
        raise ValueError(f"target column has {len(values) if len(values) < 3 else 'more than 2'} non-numeric classes - "
                         "target encoding needs a numeric (regression) or binary target.")
    if order_by:
        first = df.where(c(target).isNotNull()).agg(F.min_by(c(target), F.struct(*[c(n) for n in order_by]))).first()[0]
        values = [first] + [v for v in values if v != first]
    return F.when(c(target) == F.lit(values[0]), 0.0).when(c(target) == F.lit(values[1]), 1.0)


def fit_target_encode(df: DataFrame, columns: list[str] | None, target_column: str, smoothing: float = 10.0,
                      order_by: list[str] | None = None) -> Fitted:
    """(n*mean + s*global)/(n + s) per category, in place; unseen and NULL become the global mean."""
    require_column(df, target_column, "target_column")
    names = [n for n in categorical_columns(df, columns) if n != target_column]
    if not names:
        raise ValueError("No column beside the target is fit for target encoding.")
    y = numeric_target(df, target_column, order_by)
    overall = df.agg(F.avg(y)).first()[0]
    if overall is None:
        raise ValueError(f"'{target_column}' has no value to encode by.")
    tables = {}
    for n in names:
        stats = (df.where(c(n).isNotNull()).groupBy(c(n).alias("key"))
                 .agg(F.count(y).alias("k"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"), F.count("*").alias("cnt")))
        tables[n] = stats.select("key", "cnt", ((F.col("s") + smoothing * overall) / (F.col("k") + smoothing)).alias("enc"))

    def apply(other: DataFrame) -> DataFrame:
        order = other.columns
        for n, table in tables.items():
            other, value = _joined(other, table, n, "enc", "cnt")
            other = replace_columns(other, {n: F.coalesce(F.col(f"`{value}`"), F.lit(overall))}).drop(value)
        return other.select(*[c(n) for n in order])

    return Fitted(apply, {"global_mean": overall})


def target_encode(df: DataFrame, columns: list[str] | None, target_column: str, smoothing: float = 10.0,
                  order_by: list[str] | None = None, folds: int | None = None, key: list[str] | None = None,
                  seed: int = 42) -> DataFrame:
    """With ``folds`` each row is encoded by the statistics of the other folds (no leakage)."""
    if not folds:
        return fit_target_encode(df, columns, target_column, smoothing, order_by).transform(df)
    if not key:
        raise ValueError("key required for out-of-fold encoding: columns that identify rows")
    names = [n for n in categorical_columns(df, columns) if n != target_column]
    y = numeric_target(df, target_column, order_by)
    work = df.withColumn("_fold", F.floor(seeded_fraction(seed, *key) * folds).cast("int")).withColumn("_y", y)
    overall = df.agg(F.avg(y)).first()[0]
    order = df.columns
    for n in names:
        per_fold = (work.where(c(n).isNotNull()).groupBy(c(n).alias("_cat"), "_fold")
                    .agg(F.count("_y").alias("k"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("s"), F.count("*").alias("_cnt")))
        whole = Window.partitionBy("_cat")
        rest = per_fold.select("_cat", "_fold", "_cnt",
                               ((F.sum("s").over(whole) - F.col("s") + smoothing * overall)
                                / (F.sum("k").over(whole) - F.col("k") + smoothing)).alias("_enc"))
        keyed = work.withColumn("_cat", c(n))
        joined = lookup_join(keyed, rest, ["_cat", "_fold"], "_cnt")
        work = replace_columns(joined, {n: F.coalesce(F.col("_enc"), F.lit(overall))}).drop("_enc", "_cat")
    return work.select(*[c(n) for n in order])


def hash_encode(df: DataFrame, columns: list[str] | None = None, n_features: int = 64,
                expand: bool = False) -> DataFrame:
    """Signed feature hashing: one slot of the vector holds +1 or -1. NULL hashes as its text."""
    names = categorical_columns(df, columns)
    if not names:
        raise ValueError("No column is fit for hash encoding.")
    if expand and n_features > MAX_EXPANDED:
        raise ValueError(f"n_features above {MAX_EXPANDED} columns: use the array form.")
    out = df
    for n in names:
        text = F.coalesce(c(n).cast("string"), F.lit("None"))
        slot = F.pmod(F.hash(text), F.lit(n_features))
        sign = F.when(F.xxhash64(text) < 0, -1.0).otherwise(1.0)
        if expand:
            new = {f"{n}_hash_{i}": F.when(slot == i, sign).otherwise(0.0) for i in range(n_features)}
        else:
            new = {f"{n}_hash": F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)),
                                            lambda i: F.when(i == slot, sign).otherwise(0.0))}
        out = replace_columns(out, new).drop(n)
    return out
