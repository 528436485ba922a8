"""Lookup join, pooled union, shared columns and category union."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c

BROADCAST_ROWS = 200_000
HOT_SHARE = 1_000            # a key above 1/1000 of the rows is hot: at most 1000 such keys exist
SALTS = 997
ROWS_PER_TASK = 500_000      # rows that meet the shuffled table in one task


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], count: str | None = None,
                broadcast_rows: int = BROADCAST_ROWS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Left join of a per-key table (one row per key); NULL keys match nothing.

    A table of proven small size is broadcast. A larger one is shuffled, except for its hot keys
    (known from its ``count`` column): these are few by the pigeonhole principle, so they are
    broadcast and their rows, like rows with a NULL key, are scattered over the shuffle, whose
    tasks grow in number with the rows.
    """
    extra = [n for n in table.columns if n not in keys and n != count]
    slim = table.select(*[c(n) for n in keys + extra])
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return df.join(F.broadcast(slim), keys, "left").select(*[c(n) for n in df.columns + extra])
    hot = None
    if count:
        total = table.agg(F.sum(c(count))).first()[0] or 0
        hot = (table.where(c(count) * HOT_SHARE > F.lit(total))
               .select(*[c(n) for n in keys], *[c(n).alias(f"_hot_{n}") for n in extra], F.lit(True).alias("_hot")))
    joined = df.join(F.broadcast(hot), keys, "left") if hot is not None else df.withColumn("_hot", F.lit(None).cast("boolean"))
    scattered = F.lit(False)
    for k in keys:
        scattered = scattered | c(k).isNull()
    scattered = scattered | F.coalesce(F.col("_hot"), F.lit(False))
    joined = joined.withColumn("_salt", F.when(scattered, F.pmod(F.xxhash64(*[c(n) for n in df.columns]), F.lit(SALTS)) + 1)
                               .otherwise(F.lit(0)))
    cold = slim.withColumn("_salt", F.lit(0).cast("long"))
    joined, by = joined.withColumn("_salt", F.col("_salt").cast("long")), [*[c(n) for n in keys], F.col("_salt")]
    tasks = -(-df.count() // rows_per_task)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        joined, cold = joined.repartition(tasks, *by), cold.repartition(tasks, *by)
    joined = joined.join(cold, keys + ["_salt"], "left")
    picked = [F.when(F.coalesce(F.col("_hot"), F.lit(False)), c(f"_hot_{n}")).otherwise(c(n)).alias(n) if hot is not None
              else c(n) for n in extra]
    return joined.select(*[c(n) for n in df.columns], *picked)


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi join by name; the strategy is left to the optimizer and AQE."""
    return left.join(right, keys, "left")


def pooled_union(reference: DataFrame, current: DataFrame, side: str = "side") -> DataFrame:
    """Both samples in one table with the side each row came from."""
    return (reference.withColumn(side, F.lit("reference"))
            .unionByName(current.withColumn(side, F.lit("current"))))


def shared_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns in both tables, in the order of the reference table."""
    other = set(current.columns)
    return [n for n in reference.columns if n in other]


def category_union(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(category, ref_count, cur_count) over the categories of either side; NULLs left out."""
    counted = (pooled_union(reference.select(c(column)), current.select(c(column)))
               .where(c(column).isNotNull())
               .groupBy(c(column).alias("category"))
               .agg(F.count_if(F.col("side") == "reference").alias("ref_count"),
                    F.count_if(F.col("side") == "current").alias("cur_count")))
    return counted
