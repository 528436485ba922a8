"""Schema inspection: which columns an operator acts on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def c(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None,
                    exclude: Iterable[str] | None = None,
                    exclude_columns: Iterable[str] | None = None) -> list[str]:
    """Numeric columns, those asked for or all of them, less the excluded ones."""
    skip = set(exclude or ()) | set(exclude_columns or ())
    wanted = list(columns) if columns else df.columns
    return [n for n in wanted if n in df.columns and is_numeric(df, n) and n not in skip]


def categorical_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """The columns asked for, or every string and boolean column."""
    if columns:
        return [n for n in columns if n in df.columns]
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def require_column(df: DataFrame, name: str | None, param: str = "column") -> str:
    if not name or name not in df.columns:
        raise ValueError(f"The table has no column {name!r} ({param}).")
    return name


def require_numeric(df: DataFrame, name: str | None, param: str = "column") -> str:
    require_column(df, name, param)
    if not is_numeric(df, name):
        raise ValueError(f"Column {name!r} is not numeric.")
    return name


def existing(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    found = [n for n in (columns or ()) if n in df.columns]
    if not found:
        raise ValueError("The table has none of these columns.")
    return found


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing-value notion: float NaN becomes NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(c(n)), c(n)).alias(n) if n in floats else c(n) for n in df.columns])


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that replaces columns in place and appends the new names."""
    kept = [new[n].alias(n) if n in new else c(n) for n in df.columns]
    added = [col.alias(n) for n, col in new.items() if n not in df.columns]
    return df.select(*kept, *added)


def unused_name(df: DataFrame, base: str) -> str:
    name = base
    while name in df.columns:
        name = "_" + name
    return name
