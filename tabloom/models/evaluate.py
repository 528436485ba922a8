"""Metrics from a table of labels, predictions and scores; confusion, residual and forecast series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.functions.columns import c, datetime_columns, string_columns
from tabloom.operators.dates import parse_timestamp, parseable_counts
from tabloom.operators.hypothesis import _rank_sums
from tabloom.operators.ordered import ROWS_PER_BUCKET, with_position
from tabloom.operators.quantiles import exact_quantiles



def roc_auc(df: DataFrame, label: str, score: str, positive=1, rows_per_bucket: int = ROWS_PER_BUCKET) -> float | None:
    """Area under the ROC curve from mid-ranks over distinct scores."""
    marked = df.select((c(label) == F.lit(positive)).cast("int").alias("y"), c(score).alias("s"))
    sums, _ = _rank_sums(marked, "s", "y", rows_per_bucket)
    by = {s["g"]: s for s in sums.collect()}  # at most two
    if len(by) != 2:
        return None
    n1, n0 = by[1]["n"], by[0]["n"]
    return float((by[1]["ranks"] - n1 * (n1 + 1) / 2) / (n1 * n0))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, count), labels as strings."""
    return (df.groupBy(c(label).cast("string").alias("actual"), c(prediction).cast("string").alias("predicted"))
            .agg(F.count("*").alias("count")).orderBy("actual", "predicted"))


def confusion_table(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The matrix as one row per actual label with a column per predicted one."""
    counts = confusion_matrix(df, label, prediction)
    return counts.groupBy("actual").pivot("predicted").agg(F.coalesce(F.sum("count"), F.lit(0))).fillna(0).orderBy("actual")


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and the support-weighted f1, precision and recall; 0 where undefined."""
    cells = df.groupBy(c(label).alias("a"), c(prediction).alias("p")).agg(F.count("*").alias("n"))
    # per class: hits, actual and predicted counts, from the (actual, predicted) cells alone
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("a").cast("string").alias("k"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("a").cast("string") == F.col("p").cast("string"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").cast("string").alias("k"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))).alias("e"))
    per = sides.groupBy("e.k").agg(F.sum("e.actual").alias("actual"), F.sum("e.predicted").alias("predicted"), F.sum("e.hit").alias("hit"))
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hit") / F.col("actual")).otherwise(0.0)
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("actual") + F.col("predicted"))).otherwise(0.0)
    weighted = lambda m: F.sum(m * F.col("actual")) / F.sum("actual")
    return per.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), weighted(f1).alias("f1_weighted"),
                   weighted(precision).alias("precision_weighted"), weighted(recall).alias("recall_weighted"))


def regression_metrics(df: DataFrame, label: str, prediction: str, median: bool = False) -> DataFrame:
    y, e = c(label).cast("double"), c(prediction).cast("double") - c(label).cast("double")
    known = df.where(y.isNotNull() & c(prediction).isNotNull())
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    r2 = F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    out = known.agg(r2.alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    if median:
        middle = exact_quantiles(known.select(F.abs(e).alias("e")), ["e"], [0.5])["e"][0]
        out = out.withColumn("median_ae", F.lit(middle).cast("double"))
    return out


def evaluate(df: DataFrame, task: str, label: str = "label", prediction: str = "prediction",
             score: str | None = None, positive=1, median: bool = False) -> dict[str, float]:
    if task == "regression":
        return regression_metrics(df, label, prediction, median).first().asDict()
    metrics = classification_metrics(df, label, prediction).first().asDict()
    if score and score in df.columns and df.select(c(label)).distinct().limit(3).count() == 2:
        area = roc_auc(df, label, score, positive)
        if area is not None:
            metrics["roc_auc"] = area
    return metrics


def time_axis(df: DataFrame, time_column: str | None = None) -> Column | None:
    """Ordering value of the first usable time axis: the given column, a timestamp, a parseable
    string, or year/month(/day) columns."""
    candidates = [time_column] if time_column else datetime_columns(df) + [
        n for n, (known, parsed) in parseable_counts(df, string_columns(df)).items() if known and known == parsed]
    for n in candidates:
        if n in datetime_columns(df):
            return c(n)
        if n in string_columns(df):
            known, parsed = parseable_counts(df, [n])[n]
            return parse_timestamp(c(n)) if parsed and parsed == known else c(n)
        return c(n)
    if {"year", "month"} <= set(df.columns):
        month = c("year").cast("long") * 12 + c("month").cast("long")
        return month * 31 + c("day").cast("long") if "day" in df.columns else month
    return None


def diagnostics_series(df: DataFrame, key: list[str], time_column: str | None = None, max_points: int | None = None,
                       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows in time order (key order without a time axis) with ``position``; with ``max_points`` every n // max_points-th."""
    axis = time_axis(df, time_column)
    work = df.withColumn("_axis", axis) if axis is not None else df
    order = (["_axis"] if axis is not None else []) + key
    placed = with_position(work, order, "position", rows_per_bucket=rows_per_bucket)
    if max_points is not None:
        placed = placed.where(F.col("position") % max(1, df.count() // max_points) == 0)
    return placed.drop("_axis")


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.withColumn("residual", c(prediction) - c(label))


def predicted_vs_actual(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Points with the ends of the identity line on every row."""
    low = F.least(F.min(c(label)), F.min(c(prediction)))
    high = F.greatest(F.max(c(label)), F.max(c(prediction)))
    ends = df.agg(low.alias("line_min"), high.alias("line_max"))
    line = ends.first()
    return df.select(c(label).alias("actual"), c(prediction).alias("predicted"),
                     F.lit(line["line_min"]).alias("line_min"), F.lit(line["line_max"]).alias("line_max"))


def forecast_series(df: DataFrame, label: str, prediction: str, key: list[str], time_column: str | None = None,
                    max_points: int | None = None) -> DataFrame:
    """(position, series, value) of actual and predicted along time."""
    placed = diagnostics_series(df, key, time_column, max_points)
    both = F.array(F.struct(F.lit("actual").alias("series"), c(label).cast("double").alias("value")),
                   F.struct(F.lit("predicted").alias("series"), c(prediction).cast("double").alias("value")))
    return placed.select("position", F.inline(both))
