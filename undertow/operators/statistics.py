"""Per-column numbers every detector shares, measured in one or two scans.

Detectors put these few numbers into their plans as literals, so their own scans need no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.cells import long_numbers, number, numeric_columns
from undertow.operators.quantiles import DIRECT_ROWS, exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class ColumnStats:
    name: str
    non_null: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    q25: float | None = None
    median: float | None = None
    q75: float | None = None

    @property
    def spread(self) -> float | None:
        """Sample deviation when it can be divided by, else None."""
        usable = self.std is not None and math.isfinite(self.std) and self.std > 0
        return self.std if usable else None


    def filled(self, rows: int) -> tuple[float, float]:
        """Mean and population deviation once the gaps hold the median."""
        gaps = rows - self.non_null
        mean = (self.non_null * self.mean + gaps * self.median) / rows
        squares = (
            (self.non_null - 1) * (self.std or 0.0) ** 2
            + self.non_null * (self.mean - mean) ** 2
            + gaps * (self.median - mean) ** 2
        )
        return mean, math.sqrt(squares / rows)


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: dict[str, ColumnStats]

    def __getitem__(self, name: str) -> ColumnStats:
        return self.columns[name]

    @property
    def numeric(self) -> list[str]:
        """Number columns holding at least one value."""
        return [c.name for c in self.columns.values() if c.non_null > 0]


def measure(
    df: DataFrame,
    columns: list[str] | None = None,
    quartiles: bool = True,
    direct_rows: int = DIRECT_ROWS,
) -> TableStats:
    names = numeric_columns(df) if columns is None else list(columns)
    if not names:
        return TableStats(df.count(), {})
    moments = long_numbers(df, names).groupBy("slot").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("non_null"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    by_slot = {row["slot"]: row for row in moments.collect()}
    rows = by_slot[0]["rows"] if by_slot else 0
    measured: dict[str, ColumnStats] = {}
    for slot, name in enumerate(names):
        got = by_slot.get(slot)
        parts = ("mean", "std", "low", "high")
        values = [got[p] for p in parts] if got else [None] * len(parts)
        measured[name] = ColumnStats(name, got["non_null"] if got else 0, *values)
    if quartiles:
        counts = {name: measured[name].non_null for name in names}
        cuts = exact_quantiles(df, counts, QUARTILES, direct_rows)
        for name in names:
            q25, median, q75 = cuts[name]
            measured[name] = ColumnStats(
                **{**measured[name].__dict__, "q25": q25, "median": median, "q75": q75}
            )
    return TableStats(rows, measured)


def imputed(stats: TableStats, columns: list[str]) -> list[Column]:
    """Numbers with gaps filled by the column's median."""
    return [F.coalesce(number(n), F.lit(stats[n].median)) for n in columns]


def standardised(stats: TableStats, columns: list[str]) -> list[Column]:
    """Median-filled columns with mean 0 and deviation 1; constant columns become 0."""
    scaled = []
    for name, filled in zip(columns, imputed(stats, columns)):
        mean, deviation = stats[name].filled(stats.rows)
        scaled.append((filled - F.lit(mean)) / F.lit(deviation or 1.0))
    return scaled
