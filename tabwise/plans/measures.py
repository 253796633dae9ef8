"""What one pass over a table measures."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class NumericStats:
    count: int
    total: float
    mean: float
    std: float
    low: float
    high: float
    skewness: float


@dataclass(frozen=True)
class TableProfile:
    rows: int
    nulls: dict[str, int]
    numeric: dict[str, NumericStats]

    @property
    def limits(self) -> dict[str, tuple[float, float]]:
        return {c: (s.low, s.high) for c, s in self.numeric.items()}
