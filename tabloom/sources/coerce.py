"""Type coercion of string columns by parse rates over all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c, replace_columns, string_columns
from tabloom.operators.dates import parse_timestamp

# fixed values: column names that suggest a date, and the accepted rates
DATE_NAME = re.compile(
    r"(^|[_\s\-\.])(date|time|timestamp|datetime|dt|created|updated|modified|start|end|opened|closed|birth|expir|arrival|departure|scheduled|"
    r"posted|submitted|recorded|logged|at)([_\s\-\.]|$)", re.IGNORECASE)
PARSED_WITH_NAME = 0.80
PARSED_WITHOUT_NAME = 0.95
NEW_NULLS_DATE = 0.05
NEW_NULLS_NUMBER = 0.02


def name_suggests_date(name: str) -> bool:
    return DATE_NAME.search(name) is not None


def _number(name: str) -> Column:
    return F.trim(c(name)).try_cast("double")


def _whole(name: str) -> Column:
    """The value as a long when the text is a plain integer."""
    return F.when(F.trim(c(name)).rlike(r"^[+-]?\d+$"), F.trim(c(name)).try_cast("bigint"))


def coerce_dtypes(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Strings to timestamps first, then to numbers, where enough of the values parse.

    One aggregation over all rows decides for every string column.
    """
    names = string_columns(df)
    if not names:
        return df, {}
    aggs = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        aggs += [F.count(c(n)).alias(f"k{i}"), F.count(parse_timestamp(c(n))).alias(f"d{i}"),
                 F.count(_number(n)).alias(f"n{i}"), F.count(_whole(n)).alias(f"w{i}")]
    row = df.agg(*aggs).first()
    new, changes = {}, {}
    for i, n in enumerate(names):
        known, dates, numbers, whole = (row[f"{p}{i}"] for p in "kdnw")
        if not known:
            continue
        floor = PARSED_WITH_NAME if name_suggests_date(n) else PARSED_WITHOUT_NAME
        if dates / known >= floor and (known - dates) / row["rows"] <= NEW_NULLS_DATE:
            new[n], changes[n] = parse_timestamp(c(n)), "string -> timestamp"
        elif (known - numbers) / known <= NEW_NULLS_NUMBER:
            integral = whole == known
            new[n] = _whole(n) if integral else F.when(~F.isnan(_number(n)), _number(n))
            changes[n] = "string -> bigint" if integral else "string -> double"
    return replace_columns(df, new), changes


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Columns whose every value is a number become numbers."""
    names = string_columns(df)
    if not names:
        return df
    row = df.agg(*[a for i, n in enumerate(names) for a in (
        F.count(c(n)).alias(f"k{i}"), F.count(_number(n)).alias(f"n{i}"), F.count(_whole(n)).alias(f"w{i}"))]).first()
    new = {n: _whole(n) if row[f"w{i}"] == row[f"k{i}"] else _number(n) for i, n in enumerate(names)
           if row[f"k{i}"] and row[f"n{i}"] == row[f"k{i}"]}
    return replace_columns(df, new)
