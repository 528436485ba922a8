"""Timestamps out of strings, and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import c, datetime_columns, existing, replace_columns, string_columns

# fixed values: date layouts tried after the ISO forms
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy/M/d",
    "yyyy/M/d H:mm:ss",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "yyyyMMdd",
)
# fixed values: years a nanosecond timestamp can hold
FIRST_YEAR, LAST_YEAR = 1678, 2261


# what a text must look like for the ISO forms, and for each layout, to be worth a try: a failed parse costs far more than a pattern
ISO_SHAPE = r"^[+-]?\d{4,6}(-.*)?$|:"
SHAPES = {
    "M/d/yyyy": r"^\d+/\d+/\d+$",
    "M/d/yyyy H:mm": r"^\d+/\d+/\d+ \d+:\d+$",
    "M/d/yyyy H:mm:ss": r"^\d+/\d+/\d+ \d+:\d+:\d+$",
    "yyyy/M/d": r"^\d{4,}/\d+/\d+$",
    "yyyy/M/d H:mm:ss": r"^\d{4,}/\d+/\d+ \d+:\d+:\d+$",
    "d-MMM-yyyy": r"^\d+-[^\d-]+-\d+$",
    "MMM d, yyyy": r"^[^\d]+ \d+, \d+$",
    "yyyyMMdd": r"^\d{8,}$",
}


def parse_timestamp(text: Column) -> Column:
    """First layout that fits, NULL when none does. A layout is tried only on texts of its shape."""
    trimmed = F.trim(text)
    tries = [F.when(trimmed.rlike(ISO_SHAPE), F.try_to_timestamp(trimmed))]
    tries += [F.when(trimmed.rlike(SHAPES[f]), F.try_to_timestamp(trimmed, F.lit(f))) for f in DATE_FORMATS]
    stamp = F.coalesce(*tries)
    return F.when(F.year(stamp).between(FIRST_YEAR, LAST_YEAR), stamp)


def parsed_timestamp(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_timestamp(c(name))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c(name).cast("timestamp")
    return F.lit(None).cast("timestamp")


def parseable_counts(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """{string column: (non-NULL values, values that parse)} in one pass."""
    if not names:
        return {}
    row = df.agg(*[a for i, n in enumerate(names)
                   for a in (F.count(c(n)).alias(f"n{i}"), F.count(parse_timestamp(c(n))).alias(f"p{i}"))]).first()
    return {n: (row[f"n{i}"], row[f"p{i}"]) for i, n in enumerate(names)}


def datetime_parse(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse the named columns; a column where nothing parses stays as it is."""
    if not [n for n in (columns or []) if n in df.columns]:
        raise ValueError("Name the columns to read as dates.")
    names = existing(df, columns)
    counts = parseable_counts(df, [n for n in names if n in string_columns(df)])
    already = [n for n in names if n in datetime_columns(df)]
    good = [n for n, (_, parsed) in counts.items() if parsed]
    if not good and not already:
        raise ValueError(f"No value of {names} reads as a date.")
    return replace_columns(df, {n: parse_timestamp(c(n)) for n in good})


def encode_dates(df: DataFrame) -> DataFrame:
    """Year, month, day, weekday (Monday = 0) and quarter of every date column; sources dropped.

    String columns whose every value parses count as dates.
    """
    counts = parseable_counts(df, string_columns(df))
    texts = [n for n, (known, parsed) in counts.items() if known and known == parsed]
    names = [n for n in df.columns if n in texts or n in datetime_columns(df)]
    new = {}
    for n in names:
        stamp = parsed_timestamp(df, n)
        new.update({f"{n}_year": F.year(stamp), f"{n}_month": F.month(stamp), f"{n}_day": F.dayofmonth(stamp),
                    f"{n}_dayofweek": F.weekday(stamp), f"{n}_quarter": F.quarter(stamp)})
    return replace_columns(df, new).drop(*names)
