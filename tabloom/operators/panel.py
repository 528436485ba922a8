"""Long panels: one row per (group, period), lags, rolling statistics and lead targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import c, datetime_columns, is_numeric, require_column, string_columns
from tabloom.operators.dates import parse_timestamp, parseable_counts
from tabloom.operators.ordered import ROWS_PER_SERIES_TASK, over_series, with_position
from tabloom.session import cut_lineage

PERIODS_PER_CHUNK = 1_000


def period_end(stamp: Column, freq: str) -> Column:
    """Last day of the period the timestamp falls in."""
    if freq == "M":
        return F.last_day(stamp)
    if freq == "W":
        return F.date_add(F.date_trunc("week", stamp).cast("date"), 6)
    if freq == "D":
        return stamp.cast("date")
    raise ValueError("freq must be 'M', 'W' or 'D'.")


def _period_range(first: Column, last: Column, freq: str) -> Column:
    if freq == "M":
        starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
        return F.transform(starts, F.last_day)
    return F.sequence(first, last, F.expr("interval 7 days" if freq == "W" else "interval 1 day"))


def dense_panel(df: DataFrame, time_column: str, group_by: list[str], freq: str = "M", fill_value=0) -> DataFrame:
    """Every group gets every period between the first and the last one.

    Rows that exist are kept as they are (dates moved to their period end); only the cells nobody
    has are added, found by an anti join against the distinct cells, so no data row is shuffled and
    a hot cell costs nothing. Numeric NULLs become ``fill_value``.
    """
    require_column(df, time_column, "time_column")
    if not group_by:
        raise ValueError("Name the columns that tell the series apart.")
    missing = [g for g in group_by if g not in df.columns]
    if missing:
        raise ValueError(f"The table has no columns {missing} to tell series apart.")
    dated = time_column in datetime_columns(df)
    stamp = c(time_column)
    if not dated and time_column in string_columns(df):
        known, parsed = parseable_counts(df, [time_column])[time_column]
        dated = bool(known) and known == parsed
        stamp = parse_timestamp(c(time_column))
    if dated:
        work = df.withColumn(time_column, period_end(stamp.cast("timestamp"), freq))
    else:
        work = df
    # one scan gives the distinct cells; groups, range and the anti join all read that small table
    seen = cut_lineage(work.select(*[c(g).alias(f"_g{i}") for i, g in enumerate(group_by)], c(time_column).alias("_t")).distinct())
    work = work.where(c(time_column).isNotNull())
    keys = [c(g) for g in group_by]
    cells = seen.where(F.col("_t").isNotNull())
    groups = seen.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(group_by)]).distinct()
    if dated:
        first, last = cells.agg(F.min("_t"), F.max("_t")).first()
        if first is None:
            return work
        grid = groups.select(*keys, F.explode(_period_range(F.lit(first), F.lit(last), freq)).alias(time_column))
    else:
        grid = _label_grid(groups, cells.select(F.col("_t").alias(time_column)).distinct(), group_by, time_column)
    match = c(time_column) == F.col("_t")
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"_g{i}"))
    absent = grid.join(cells, match, "left_anti")
    blank = absent.select(*[c(f.name) if f.name in group_by or f.name == time_column
                            else F.lit(None).cast(f.dataType).alias(f.name) for f in work.schema])
    both = work.unionByName(blank)
    return both.select(*[F.coalesce(c(f.name), F.lit(fill_value).cast(f.dataType)).alias(f.name)
                         if isinstance(f.dataType, T.NumericType) and f.name not in group_by and f.name != time_column
                         else c(f.name) for f in both.schema])


def _label_grid(groups: DataFrame, labels: DataFrame, group_by: list[str], time_column: str) -> DataFrame:
    """Groups x labels by an equi join on chunks of at most PERIODS_PER_CHUNK labels."""
    placed = with_position(labels, [time_column], "_pos")
    chunks = (placed.groupBy(F.floor(F.col("_pos") / PERIODS_PER_CHUNK).alias("_chunk"))
              .agg(F.collect_list(c(time_column)).alias("_labels")))
    last = chunks.agg(F.max("_chunk")).first()[0]
    spread = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))))
    return (spread.join(chunks, "_chunk")
            .select(*[c(g) for g in group_by], F.explode("_labels").alias(time_column)))


def _check_series(df: DataFrame, column: str, steps: list[int], group_by, time_column, name: str) -> None:
    require_column(df, column)
    if not steps or not all(isinstance(n, int) and not isinstance(n, bool) and n > 0 for n in steps):
        raise ValueError(f"{name} takes whole numbers above zero.")
    if not group_by:
        raise ValueError("Name the columns that tell the series apart.")
    for g in group_by:
        require_column(df, g, "group_by")
    require_column(df, time_column, "time_column")


def _keyed(group_by: list[str], value: Column) -> Column:
    """NULL for rows without a complete group key."""
    known = F.lit(True)
    for g in group_by:
        known = known & c(g).isNotNull()
    return F.when(known, value)


def create_lag_features(df: DataFrame, column: str, lags: list[int], group_by: list[str], time_column: str,
                        tiebreak: list[str] | None = None, max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    _check_series(df, column, lags, group_by, time_column, "lags")
    return over_series(df, group_by, [time_column] + list(tiebreak or []), max(lags), 0,
                       lambda w: {f"{column}_lag_{n}": _keyed(group_by, F.lag(c(column), n).over(w)) for n in lags},
                       max_rows)


def create_rolling_features(df: DataFrame, column: str, windows: list[int], group_by: list[str], time_column: str,
                            agg: str = "mean", tiebreak: list[str] | None = None,
                            max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """Statistic of the previous rows only, so the current value never leaks into its own window."""
    _check_series(df, column, windows, group_by, time_column, "windows")
    functions = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if agg not in functions:
        raise ValueError(f"Unknown rolling statistic {agg!r}.")
    return over_series(df, group_by, [time_column] + list(tiebreak or []), max(windows), 0,
                       lambda w: {f"{column}_roll_{n}_{agg}":
                                  _keyed(group_by, functions[agg](c(column)).over(w.rowsBetween(-n, -1))) for n in windows},
                       max_rows)


def create_lead_target(df: DataFrame, column: str, leads: list[int], group_by: list[str], time_column: str,
                       tiebreak: list[str] | None = None, max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """Future values as targets; rows with no future value at all are dropped."""
    _check_series(df, column, leads, group_by, time_column, "leads")
    out = over_series(df, group_by, [time_column] + list(tiebreak or []), 0, max(leads),
                      lambda w: {f"{column}_lead_{n}": _keyed(group_by, F.lead(c(column), n).over(w)) for n in leads},
                      max_rows)
    return out.where(F.coalesce(*[c(f"{column}_lead_{n}") for n in leads]).isNotNull())
