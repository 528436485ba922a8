"""Grouped aggregation, profile, roles, summaries, task inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c, datetime_columns, is_integer, is_numeric, numeric_columns, require_column
from tabloom.operators.quantiles import exact_quantiles, quantiles

# fixed values: role and balance limits, and the advice texts
IDENTIFIER_SHARE = 0.8
SAMPLES = 5
IMBALANCE_RATIO = 3.0
IMBALANCED = "One class is rare: balance the rows before a fit."
BALANCED = "The classes are of similar size."


def _aggregate(df: DataFrame, column: str, how: str, order_by: list[str] | None, approx: bool) -> Column:
    col = c(column)
    if how == "count":
        return F.count(col)
    if how == "nunique":
        return F.approx_count_distinct(col) if approx else F.count_distinct(col)
    if how == "sum":
        return F.coalesce(F.sum(col), F.lit(0))
    if how in ("first", "last"):
        if not order_by:
            raise ValueError("order_by required for first / last.")
        key = F.when(col.isNotNull(), F.struct(*[c(n) for n in order_by]))
        return (F.min_by if how == "first" else F.max_by)(col, key)
    simple = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}
    if how not in simple:
        raise ValueError(f"unknown aggregation '{how}'.")
    return simple[how](col)


def groupby_aggregate(df: DataFrame, group_by: list[str], aggregations: dict[str, str | list[str]],
                      order_by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Aggregate per group; rows with a NULL key are left out, unknown columns ignored."""
    if not group_by:
        raise ValueError("Name the columns to group by.")
    if not aggregations:
        raise ValueError("Name what to aggregate.")
    lost = [g for g in group_by if g not in df.columns]
    if lost:
        raise ValueError(f"The table has no columns {lost} to group by.")
    known = {n: how for n, how in aggregations.items() if n in df.columns}
    if not known:
        raise ValueError("The table has none of the columns to aggregate.")
    suffixed = any(isinstance(how, (list, tuple)) for how in known.values())
    aggs = []
    for n, how in known.items():
        for h in ([how] if isinstance(how, str) else how):
            aggs.append(_aggregate(df, n, h, order_by, approx).alias(f"{n}_{h}" if suffixed else n))
    return df.dropna(subset=group_by).groupBy(*[c(g) for g in group_by]).agg(*aggs)


def _role(df: DataFrame, name: str, unique: int, rows: int) -> str:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return "flag"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if name in datetime_columns(df):
        return "datetime"
    return "identifier/text" if rows and unique / rows > IDENTIFIER_SHARE else "categorical"


def _countable(df: DataFrame, name: str) -> Column:
    return F.to_json(c(name)) if isinstance(df.schema[name].dataType, T.MapType) else c(name)


def _sample_text(df: DataFrame, name: str) -> Column:
    nested = isinstance(df.schema[name].dataType, (T.MapType, T.ArrayType, T.StructType))
    return F.to_json(c(name)) if nested else c(name).cast("string")


def column_values(df: DataFrame) -> DataFrame:
    """(position, value, copies): each column's distinct known values as text with their numbers of rows; position -1 counts all rows.

    Tasks count their own values before the shuffle, so repeated values travel once per task.
    """
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    cells = [F.struct(F.lit(-1).alias("position"), F.lit("").alias("value"))]
    for i, n in enumerate(df.columns):
        text = (c(n) + F.lit(0.0)).cast("string") if n in floats else _sample_text(df, n)  # one zero
        cells.append(F.struct(F.lit(i).alias("position"), text.alias("value")))
    return df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).groupBy("position", "value").agg(F.count("*").alias("copies"))


def profile_columns(df: DataFrame, exact: bool = True, samples: bool = True) -> DataFrame:
    """One row per column: type, role, missing and distinct counts, up to five sample values by hash.

    Everything comes from one shuffle of each task's distinct values (``column_values``). With ``exact=False`` distinct counts are sketches.
    """
    names = df.columns
    values = column_values(df)
    none = [F.lit(None).cast("string").alias("value"), F.lit(0).alias("place")]
    if exact:
        found = values.groupBy("position").agg(F.count("*").alias("unique_count"), F.sum("copies").alias("known"))
    else:
        sketches = [a for i, n in enumerate(names) for a in (F.count(c(n)).alias(f"k{i}"), F.approx_count_distinct(_countable(df, n)).alias(f"u{i}"))]
        cells = [F.struct(F.lit(i).alias("position"), F.col(f"u{i}").alias("unique_count"), F.col(f"k{i}").alias("known")) for i in range(len(names))]
        cells.append(F.struct(F.lit(-1).alias("position"), F.lit(1).cast("long").alias("unique_count"), F.col("_rows").alias("known")))
        found = df.agg(F.count("*").alias("_rows"), *sketches).select(F.inline(F.array(*cells)))
    found = found.select("position", "unique_count", "known", *none)
    if samples:
        place = F.row_number().over(Window.partitionBy("position").orderBy("hash", "value"))
        chosen = values.where(F.col("position") >= 0).withColumn("hash", F.xxhash64("value")).withColumn("place", place).where(F.col("place") <= SAMPLES)
        found = found.union(chosen.select("position", F.lit(None).cast("long"), F.lit(None).cast("long"), "value", "place"))
    measured: dict[int, tuple[int, int]] = {}
    picked: dict[int, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: r["place"]):  # a row per column and sample
        if r["place"]:
            picked.setdefault(r["position"], []).append(r["value"])
        else:
            measured[r["position"]] = (r["unique_count"], r["known"])
    rows = measured.get(-1, (0, 0))[1]
    out = []
    for i, n in enumerate(names):
        unique, known = measured.get(i, (0, 0))
        entry = (i, n, df.schema[n].dataType.simpleString(), _role(df, n, unique, rows), rows - known, (rows - known) / rows * 100 if rows else 0.0, unique)
        out.append(entry + ((picked.get(i, []),) if samples else ()))
    schema = "position int, name string, dtype string, role string, missing_count long, missing_pct double, unique_count long"
    return df.sparkSession.createDataFrame(out, schema + (", sample_values array<string>" if samples else ""))


def profile(df: DataFrame) -> DataFrame:
    """Table-level profile: rows, columns, duplicate rows, missing cells and their share."""
    counted = df.groupBy(*[_countable(df, n).alias(n) for n in df.columns]).agg(F.count("*").alias("_copies"))
    gaps = sum((c(n).isNull().cast("long") for n in df.columns), F.lit(0))
    cells = F.col("row_count") * len(df.columns)
    return (counted.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
                        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
                        F.coalesce(F.sum(gaps * F.col("_copies")), F.lit(0)).alias("missing_cells"))
            .select("row_count", F.lit(len(df.columns)).alias("column_count"), "duplicate_rows", "missing_cells",
                    F.when(cells > 0, F.col("missing_cells") / cells * 100).otherwise(0.0).alias("missing_pct")))


def infer_roles(df: DataFrame, exact: bool = True) -> DataFrame:
    return profile_columns(df, exact, samples=False).select("name", "role")


def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column, rounded to 4 digits."""
    names = numeric_columns(df)
    found = quantiles(df, names, [0.25, 0.5, 0.75], exact)
    aggs, entries = [], []
    for i, n in enumerate(names):
        x = c(n).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        fields = {"mean": F.col(f"m{i}"), "std": F.col(f"s{i}"), "min": F.col(f"a{i}"),
                  "q25": F.lit(found[n][0]).cast("double"), "q50": F.lit(found[n][1]).cast("double"),
                  "q75": F.lit(found[n][2]).cast("double"), "max": F.col(f"b{i}")}
        entries.append(F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("count"),
                                *[F.round(v, 4).alias(k) for k, v in fields.items()]))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return (df.where(c(require_column(df, column)).isNotNull())
            .groupBy(c(column).alias("class")).agg(F.count("*").alias("class_count")))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """One row: classes, largest/smallest ratio, imbalance flag above 3, advice."""
    ratio = F.max("class_count") / F.min("class_count")
    return class_counts(df, column).agg(
        F.lit(column).alias("column"), F.count("*").alias("n_classes"), F.round(ratio, 3).alias("imbalance_ratio"),
        (ratio > IMBALANCE_RATIO).alias("is_imbalanced"),
        F.when(ratio > IMBALANCE_RATIO, IMBALANCED).otherwise(BALANCED).alias("recommendation"))


def outlier_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """IQR and z-score outliers per numeric column; z uses the sample deviation."""
    names = numeric_columns(df)
    if not names:
        raise ValueError("The table has no numeric column to look for outliers in.")
    found = {n: q for n, q in quantiles(df, names, [0.25, 0.75], exact).items() if q[0] is not None}
    names = list(found)
    moments = df.agg(*[a for i, n in enumerate(names)
                       for a in (F.avg(c(n)).alias(f"m{i}"), F.stddev_samp(c(n)).alias(f"s{i}"))]).first()
    aggs, entries = [], []
    for i, n in enumerate(names):
        x = c(n).cast("double")
        low, high = found[n]
        reach = 1.5 * (high - low)
        spread = moments[f"s{i}"]
        z = F.abs((x - moments[f"m{i}"]) / F.lit((spread if spread is not None else float("nan")) + 1e-12))
        aggs += [F.count_if((x < low - reach) | (x > high + reach)).alias(f"o{i}"),
                 F.count_if((z > 3) & ~F.isnan(z)).alias(f"z{i}"), F.count(x).alias(f"n{i}")]
        entries.append(F.struct(F.lit(n).alias("column"), F.col(f"o{i}").alias("iqr_outliers"),
                                F.col(f"z{i}").alias("zscore_outliers"), F.col(f"n{i}").alias("total"),
                                F.round(100 * F.col(f"o{i}") / F.col(f"n{i}"), 1).alias("iqr_pct")))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def infer_task_type(df: DataFrame, target: str) -> str:
    """Classification or regression, by the type, the distinct count and its share of the rows."""
    require_column(df, target, "target_column")
    known = df.where(c(target).isNotNull())
    few = known.select(c(target)).distinct().limit(21).count()
    if few <= 1 or not is_numeric(df, target):
        return "classification"
    if is_integer(df, target) and few <= 20:
        return "classification"
    if few <= 10 and few / max(known.count(), 1) <= 0.2:
        return "classification"
    return "regression"


def inspect_dataset(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(n) for n in df.columns]).cast("array<string>").alias("columns"))
