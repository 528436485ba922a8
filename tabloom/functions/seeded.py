"""Repeatable randomness: a key that depends on the seed and the row, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabloom.functions.columns import c


def _text(key: str | Column) -> Column:
    col = c(key) if isinstance(key, str) else key
    return F.coalesce(col.cast("string"), F.lit(""))


def seeded_key(seed: int, *keys: str | Column) -> Column:
    """md5 of ``seed|key|...``: a uniform order over rows that any engine with md5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]))


def seeded_fraction(seed: int, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 8 hexadecimal digits of the seeded key."""
    return F.conv(F.substring(seeded_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
