"""Train/test splits, folds and samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.columns import c, require_column, string_columns
from tabloom.functions.seeded import seeded_key
from tabloom.operators.dates import parse_timestamp, parseable_counts
from tabloom.operators.describe import seeded_sample
from tabloom.operators.ordered import first_in_group, split_at

SORTED_SAMPLE = 100_000


def _time_key(df: DataFrame, time_column: str) -> tuple[DataFrame, str]:
    """A sortable time column: parsed when a string column parses, else its raw values."""
    require_column(df, time_column, "time_column")
    if time_column in string_columns(df) and parseable_counts(df, [time_column])[time_column][1]:
        return df.withColumn("_time", parse_timestamp(c(time_column))), "_time"
    return df, time_column


def chronological_split(df: DataFrame, time_column: str, test_size: float = 0.2,
                        tiebreak: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """First int(n * (1 - test_size)) rows by time train, the later ones test; NULL times come last.

    The cut key is found by counting, so the split is two filters, not a sort. ``tiebreak`` columns
    must make the order total (without them the whole row breaks ties).
    """
    work, key = _time_key(df, time_column)
    rows = df.count()
    cut = int(rows * (1.0 - test_size))
    if cut < 2 or cut >= rows:
        raise ValueError(f"A test share of {test_size} leaves {cut} rows before the cut and {rows - cut} after it.")
    order = [key] + [n for n in (tiebreak or df.columns) if n != key]
    train, test = split_at(work, order, cut)
    return train.select(*[c(n) for n in df.columns]), test.select(*[c(n) for n in df.columns])


def stratifiable(df: DataFrame, target: str, test_size: float) -> bool:
    """Every class has two rows and both sides can hold every class."""
    counts = (df.groupBy(c(target)).count()
              .agg(F.count("*").alias("k"), F.min("count").alias("least"), F.sum("count").alias("n")).first())
    if counts["k"] <= 1 or counts["least"] < 2:
        return False
    test = max(1, round(counts["n"] * test_size))
    return test >= counts["k"] and counts["n"] - test >= counts["k"]


def random_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42,
                 stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact share of rows by seeded key, per class when ``stratify`` names one.

    The cut of each class is found by counting; neither the number of classes nor the size of one is
    bounded, and no class is sorted in one task.
    """
    hashed = df.withColumn("_order", seeded_key(seed, *key))
    if stratify is None or not stratifiable(df, stratify, test_size):
        rows = df.count()
        test = max(1, round(rows * test_size))
        left, right = split_at(hashed, ["_order"] + key, test)
        return right.drop("_order"), left.drop("_order")
    wanted = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(test_size))).cast("long"))
    placed = first_in_group(hashed, stratify, "_order", key, wanted)
    return placed.where(~F.col("_first")).drop("_order", "_first"), placed.where("_first").drop("_order", "_first")


def with_fold(df: DataFrame, key: list[str], folds: int, seed: int = 42, name: str = "_fold") -> DataFrame:
    """Shuffled fold number by seeded key; no shuffle of rows."""
    digits = F.conv(F.substring(seeded_key(seed, *key), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, F.pmod(digits, F.lit(folds)).cast("int"))


def sample_rows(df: DataFrame, max_rows: int, key: list[str], seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows, uniform without replacement; the table itself when it is smaller."""
    if max_rows <= SORTED_SAMPLE:
        return seeded_sample(df, max_rows, key, seed)
    if df.count() <= max_rows:
        return df
    # a large sample is a filter at a counted cut, not a sort gathered in one task
    return split_at(df.withColumn("_order", seeded_key(seed, *key)), ["_order"] + key, max_rows)[0].drop("_order")
