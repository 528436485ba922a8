"""Ids of texts that are made of independent chunks: each distinct chunk is encoded once for as long as it is kept."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np

CHUNKS_KEPT = 250_000  # distinct chunks whose ids a task keeps


class Numbered(dict):
    """Numbers keys in the order they come; ``new`` lists those that came since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def settle(self, most: int) -> None:
        """Forgets the new keys beyond ``most``."""
        for key in self.new[max(0, most - (len(self) - len(self.new))):]:
            del self[key]
        self.new = []


class ChunkTable:
    """Base of the tables; ``encoded`` gives the ids of some distinct chunks, one after another, and how many each has."""

    def __init__(self):
        self.rows, self.values, self.ends = Numbered(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encoded(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def ids(self, parts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Ids of texts given as lists of chunks."""
        index = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        values, ends = self.values, self.ends
        if self.rows.new:
            more, sizes = self.encoded(self.rows.new)
            values, ends = np.append(values, more), np.append(ends, ends[-1] + np.cumsum(sizes))
            self.rows.settle(CHUNKS_KEPT)
            self.values, self.ends = values[:ends[len(self.rows)]], ends[:len(self.rows) + 1]
        sizes = ends[index + 1] - ends[index]
        stops = np.cumsum(sizes)
        out = values[np.repeat(ends[index] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        bounds = np.append(0, stops)[np.cumsum([0, *map(len, parts)])]
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]
