"""Exact linear-interpolated quantiles that never hold a whole column in one task.

A column of a few hundred thousand values is grouped, sorted and read off. Above that, sorting whole
columns would be too much for one task, so each wanted rank is searched for: an approximate
sketch proposes two values that should enclose it, one scan counts the rows at each proposed value
and between them, and the search goes on in the zone that really holds the rank. The counts are
exact, so the answer is exact whatever the sketch says. The proposed values leave the zone, so a
heavily repeated value cannot stall the search. A zone shrinks by about the sketch's accuracy per
round; once it is small its values are grouped and ranked. All ranks of all columns share each scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.cells import long_numbers, number
from undertow.session import small_frame

DIRECT_ROWS = 500_000
SKETCH_ACCURACY = 10_000
ZONE_ROWS = 500_000


@dataclass
class Rank:
    """A 0-based rank of a column and the open interval (after, before) known to hold it."""

    column: str
    rank: int
    inside: int
    below: int = 0
    after: float | None = None
    before: float | None = None
    value: float | None = None

    @property
    def zone(self) -> tuple:
        return self.column, self.after, self.before

    def mask(self) -> Column:
        c = number(self.column)
        mask = c.isNotNull()
        if self.after is not None:
            mask = mask & (c > F.lit(self.after))
        if self.before is not None:
            mask = mask & (c < F.lit(self.before))
        return mask

    def shares(self, accuracy: int) -> list[float]:
        """Where in the zone to cut, with room for the sketch being off by inside / accuracy."""
        slack = 2 * self.inside / accuracy + 1
        place = self.rank - self.below
        return [
            min(1.0, max(0.0, (place - slack) / self.inside)),
            min(1.0, max(0.0, (place + 1 + slack) / self.inside)),
        ]

    def settle(self, cuts: list[float], counts: dict[int, int]) -> None:
        """Move to the zone holding the rank. Zone 2j + 1 is the value cuts[j], 2j lies below it."""
        passed = 0
        for zone in range(2 * len(cuts) + 1):
            held = counts.get(zone, 0)
            if self.rank < passed + held:
                break
            passed += held
        place, on_cut = divmod(zone, 2)
        if on_cut:
            self.value = cuts[place]
            return
        self.below, self.inside = passed, held
        self.after = cuts[place - 1] if place else None
        self.before = cuts[place] if place < len(cuts) else None


def interpolate(position: float, lower: float, upper: float) -> float:
    if lower == upper:
        return lower
    return lower + (upper - lower) * (position - math.floor(position))


def exact_quantiles(
    df: DataFrame,
    counts: dict[str, int],
    fractions: tuple[float, ...],
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
    zone_rows: int = ZONE_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles per column. `counts` gives each column's number of non-null values."""
    found: dict[str, list[float | None]] = {c: [None] * len(fractions) for c in counts}
    filled = [c for c, count in counts.items() if count > 0]
    if not filled:
        return found
    positions = {(c, p): p * (counts[c] - 1) for c in filled for p in fractions}
    ranks: dict[tuple[str, int], Rank] = {}
    for (c, _), position in positions.items():
        for rank in (math.floor(position), math.ceil(position)):
            ranks[c, rank] = Rank(c, rank, counts[c])
    if max(counts.values()) <= direct_rows:
        slots = {c: i for i, c in enumerate(filled)}
        values = long_numbers(df, filled).withColumnRenamed("slot", "zone")
        known = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
        _read_off(known, [(slots[r.column], r) for r in ranks.values()])
    else:
        _search(df, list(ranks.values()), accuracy, zone_rows)
    for c in filled:
        for slot, p in enumerate(fractions):
            position = positions[c, p]
            lower, upper = (ranks[c, r].value for r in (math.floor(position), math.ceil(position)))
            found[c][slot] = interpolate(position, lower, upper)
    return found


def _search(df: DataFrame, ranks: list[Rank], accuracy: int, zone_rows: int) -> None:
    while True:
        wide = [r for r in ranks if r.value is None and r.inside > zone_rows]
        if not wide:
            break
        zones: dict[tuple, list[Rank]] = {}
        for r in wide:
            zones.setdefault(r.zone, []).append(r)
        sketches = []
        for i, members in enumerate(zones.values()):
            cuts = [F.lit(share) for r in members for share in r.shares(accuracy)]
            value = F.when(members[0].mask(), number(members[0].column))
            sketches.append(F.percentile_approx(value, F.array(*cuts), accuracy).alias(f"z{i}"))
        got = df.agg(*sketches).first()
        cuts: dict[str, set[float]] = {r.column: set() for r in wide}
        for i, members in enumerate(zones.values()):
            known = {members[0].after, members[0].before} - {None}
            cuts[members[0].column] |= known | set(got[f"z{i}"])
        sorted_cuts = {name: sorted(values) for name, values in cuts.items()}
        counts = _zone_counts(df, sorted_cuts)
        for r in wide:
            r.settle(sorted_cuts[r.column], counts[r.column])
    _rank_small_zones(df, [r for r in ranks if r.value is None])


def _doubles(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[number(n).alias(f"c{i}") for i, n in enumerate(names)])


def _present(cells: pa.Array) -> np.ndarray:
    values = cells.to_numpy(zero_copy_only=False)
    return values[~np.isnan(values)]


def _zone_counts(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, int]]:
    """Rows per zone of each column: a task passes on one number per zone.

    Each value is placed among the cuts by binary search, batch by batch.
    """
    names = list(cuts)
    ends = [np.array(cuts[name]) for name in names]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(2 * len(e) + 1, dtype=np.int64) for e in ends]
        for batch in batches:
            for slot, (edges, cells) in enumerate(zip(ends, batch.columns)):
                values = _present(cells)
                zone = np.searchsorted(edges, values, "left") + np.searchsorted(
                    edges, values, "right"
                )
                held[slot] += np.bincount(zone, minlength=len(held[slot]))
        slots = np.repeat(np.arange(len(held)), [len(h) for h in held])
        zones = np.concatenate([np.arange(len(h)) for h in held])
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(zones), pa.array(np.concatenate(held))],
            names=["slot", "zone", "rows"],
        )

    counted = (
        _doubles(df, names)
        .mapInArrow(place, "slot bigint, zone bigint, rows bigint")
        .groupBy("slot", "zone")
        .agg(F.sum("rows").alias("rows"))
    )
    found: dict[str, dict[int, int]] = {name: {} for name in names}
    for row in counted.collect():
        found[names[row["slot"]]][row["zone"]] = row["rows"]
    return found


def _rank_small_zones(df: DataFrame, ranks: list[Rank]) -> None:
    """Group the values of each remaining zone and read the wanted ranks off the running count."""
    if not ranks:
        return
    zones = list(dict.fromkeys(r.zone for r in ranks))
    names = list(dict.fromkeys(name for name, _, _ in zones))
    bounds = [
        (names.index(name), -np.inf if a is None else a, np.inf if b is None else b, a, b)
        for name, a, b in zones
    ]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_present(cells) for cells in batch.columns]
            for zone, (slot, low, high, after, before) in enumerate(bounds):
                values = columns[slot]
                inside = (values > low) & (values < high)
                # An open end also takes in an infinite value.
                if after is None:
                    inside |= values == -np.inf
                if before is None:
                    inside |= values == np.inf
                picked = values[inside]
                if len(picked):
                    number_of = np.full(len(picked), zone, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number_of), pa.array(picked)], names=["zone", "value"]
                    )

    picked = _doubles(df, names).mapInArrow(pick, "zone int, value double")
    _read_off(picked, [(zones.index(r.zone), r) for r in ranks])


def _read_off(values: DataFrame, ranks: list[tuple[int, Rank]]) -> None:
    """Group the (zone, value) rows and read each wanted rank off its zone's running count."""
    through = F.sum("freq").over(
        Window.partitionBy("zone").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    running = (
        values.groupBy("zone", "value")
        .agg(F.count(F.lit(1)).alias("freq"))
        .withColumn("through", through)
    )
    wanted = [(zone, i, r.rank - r.below) for i, (zone, r) in enumerate(ranks)]
    places = small_frame(values.sparkSession, wanted, "zone int, wanted int, place bigint")
    found = (
        running.join(F.broadcast(places), "zone")
        .where(F.col("through") > F.col("place"))
        .groupBy("wanted")
        .agg(F.min("value").alias("value"))
    )
    for row in found.collect():
        ranks[row["wanted"]][1].value = row["value"]
