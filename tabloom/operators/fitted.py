"""Fit once, apply anywhere: the small statistics an operator learned and how to apply them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Fitted:
    apply: Callable[[DataFrame], DataFrame]
    state: dict[str, Any] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)
