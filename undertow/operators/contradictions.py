"""Row groups that break a positive correlation: high in one column, low in the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.cells import listed, quoted, sql_double, sql_text
from undertow.operators.statistics import TableStats
from undertow.session import small_frame

PAIRS_PER_SCAN = 120
SUMS_PER_SCAN = 40
TILE = 256
CELLS = 1 << 20


@dataclass(frozen=True)
class Contradiction:
    col_a: str
    col_b: str
    r: float
    direction: str
    count: int
    pct: float
    predicate: str


def correlations(df: DataFrame, stats: TableStats, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of each column pair over the rows holding both: (pair, col_a, col_b, r).

    Values are centred and scaled by the measured mean and deviation, so one scan is enough. A few
    columns without gaps need a single sum per pair. Otherwise each task multiplies its batches as
    matrices and passes on one row per pair: hundreds of sums in one aggregate would be slower by
    far. Pairs with a constant side give NULL.
    """
    names = stats.numeric if columns is None else columns
    varying = [n for n in names if stats[n].spread]
    pairs = _pairs(df, names)
    if len(varying) < 2:
        return pairs.withColumn("r", F.lit(None).cast("double"))
    scaled = df.selectExpr(
        *[
            f"(CAST({quoted(n)} AS DOUBLE) - {sql_double(stats[n].mean)})"
            f" / {sql_double(stats[n].spread)} AS z{i}"
            for i, n in enumerate(varying)
        ]
    )
    complete = all(stats[n].non_null == stats.rows for n in varying)
    width = len(varying)
    if complete and width * (width - 1) // 2 <= SUMS_PER_SCAN:
        slots = list(combinations(range(width), 2))
        totals = scaled.agg(*[F.expr(f"sum(z{a} * z{b}) AS xy_{a}_{b}") for a, b in slots])
        rows = [[str(a), str(b), f"xy_{a}_{b} / {stats.rows - 1}D"] for a, b in slots]
        found = listed(totals, ["a", "b", "r"], rows)
    else:
        found = _matrix_correlations(scaled, width)
    place = {name: i for i, name in enumerate(names)}
    places = F.array(*[F.lit(place[n]) for n in varying])
    at = [F.element_at(places, F.col(side) + 1) for side in ("a", "b")]
    known = found.select(_pair_number(*at, len(names)).alias("pair"), "r")
    return pairs.join(F.broadcast(known), "pair", "left")


def _pair_number(a: Column, b: Column, n: int) -> Column:
    """Place of (a, b), a < b, among all pairs of n in order."""
    rows_before = F.floor(a * (F.lit(2 * n - 1) - a) / 2)
    return (rows_before + b - a - 1).cast("int")


def _pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(pair, col_a, col_b) of all pairs in order, listed by tasks."""
    n = len(names)
    if n < 2:
        return small_frame(df.sparkSession, [], "pair int, col_a string, col_b string")
    labels = F.array(*[F.lit(name) for name in names])
    rows = df.sparkSession.range(n - 1, numPartitions=1 + n // TILE).select(F.col("id").cast("int").alias("a"))
    rows = rows.select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(n - 1))).alias("b"))
    return rows.select(
        _pair_number(F.col("a"), F.col("b"), n).alias("pair"),
        F.element_at(labels, F.col("a") + 1).alias("col_a"),
        F.element_at(labels, F.col("b") + 1).alias("col_b"),
    )


def _tile_sums(scaled: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """Sums over shared rows of columns low..high-1 with all later ones, a row per pair and task.

    A task holds six matrices of at most `TILE` rows, and multiplies some `CELLS` cells at a time.
    """
    first, second = np.nonzero(np.arange(low, high)[:, None] < np.arange(low, width))
    step = max(1, CELLS // (width - low))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, y, xx, yy, xy = (np.zeros((high - low, width - low)) for _ in range(6))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                held = ~np.isnan(cells)
                cells[~held] = 0.0
                held = held.astype(float)
                left, there = cells[:, : high - low].T, held[:, : high - low].T
                n += there @ held
                x += left @ held
                y += there @ cells
                xy += left @ cells
                xx += (left * left) @ held
                np.multiply(cells, cells, out=cells)
                yy += there @ cells
        sums = [part[first, second] for part in (n, x, y, xx, yy, xy)]
        pair = [pa.array((side + low).astype(np.int32)) for side in (first, second)]
        names = ["a", "b", "n", "x", "y", "xx", "yy", "xy"]
        yield pa.RecordBatch.from_arrays([*pair, *map(pa.array, sums)], names=names)

    schema = "a int, b int, n double, x double, y double, xx double, yy double, xy double"
    return scaled.select(*[f"z{i}" for i in range(low, width)]).mapInArrow(add_up, schema)


def _matrix_correlations(scaled: DataFrame, width: int) -> DataFrame:
    """(a, b, r) from the sums over shared rows, added up by matrix products within each task.

    Wide tables are cut into bands of `TILE` columns, each met with the columns from it on; all bands
    run as one job, so memory of a task grows with the width and not with its square.
    """
    bands = [
        _tile_sums(scaled, low, min(low + TILE, width), width) for low in range(0, width - 1, TILE)
    ]
    sums = reduce(DataFrame.unionByName, bands).groupBy("a", "b").agg(
        *[F.sum(s).alias(s) for s in ("n", "x", "y", "xx", "yy", "xy")]
    )
    # What rounding leaves of a constant is no variance.
    return sums.selectExpr(
        "a", "b", "xy - x * y / nullif(n, 0D) AS shared", "xx - x * x / nullif(n, 0D) AS var_x",
        "yy - y * y / nullif(n, 0D) AS var_y", "xx", "yy",
    ).selectExpr(
        "a", "b",
        "CASE WHEN var_x > xx * 1e-14D AND var_y > yy * 1e-14D"
        " THEN shared / sqrt(var_x * var_y) END AS r",
    )


def predicate(stats: TableStats, a: str, b: str, direction: str) -> str:
    """The rows of one contradiction as a SQL condition."""
    qa, qb = quoted(a), quoted(b)
    if direction == "high":
        return f"{qa} >= {sql_double(stats[a].q75)} AND {qb} <= {sql_double(stats[b].q25)}"
    return f"{qa} <= {sql_double(stats[a].q25)} AND {qb} >= {sql_double(stats[b].q75)}"


def contradiction_counts(
    df: DataFrame,
    stats: TableStats,
    columns: list[str] | None = None,
    least_r: float = 0.35,
    least_share: float = 0.03,
) -> DataFrame:
    """Every large enough contradiction, both directions, before any ranking.

    (pair, col_a, col_b, r, direction, matches, pct). The correlations come first, so row masks
    are counted only for the few pairs that move together.
    """
    names = stats.numeric if columns is None else columns
    schema = (
        "pair int, col_a string, col_b string, r double, direction string, matches bigint,"
        " pct double"
    )
    spark = df.sparkSession
    if len(names) < 2 or stats.rows < 10:
        return small_frame(spark, [], schema)
    strong = (
        correlations(df, stats, names)
        .where((F.col("r") >= least_r) & ~F.isnan("r"))
        .orderBy("pair")
        .collect()
    )
    floor = max(3, int(stats.rows * least_share))
    frames = []
    for start in range(0, len(strong), PAIRS_PER_SCAN):
        masks, rows = [], []
        for row in strong[start : start + PAIRS_PER_SCAN]:
            pair, a, b = row["pair"], row["col_a"], row["col_b"]
            for direction in ("high", "low"):
                label = f"m{pair}_{direction}"
                masks.append(f"count_if({predicate(stats, a, b, direction)}) AS {label}")
                names = [str(pair), sql_text(a), sql_text(b)]
                rows.append([*names, sql_double(row["r"]), f"'{direction}'", label])
        counted = df.agg(*[F.expr(mask) for mask in masks])
        fields = ["pair", "col_a", "col_b", "r", "direction", "matches"]
        frames.append(listed(counted, fields, rows))
    if not frames:
        return small_frame(spark, [], schema)
    counted = reduce(DataFrame.unionByName, frames)
    return counted.where(F.col("matches") >= floor).withColumn(
        "pct", F.round(F.col("matches") / F.lit(stats.rows) * 100, 1)
    )


def top_contradictions(counts: DataFrame, most: int | None = 4) -> DataFrame:
    """The larger direction of each pair, largest first; ties keep pair order, "high" first."""
    larger = Window.partitionBy("pair").orderBy(F.desc("matches"), "direction")
    ordered = (
        counts.withColumn("place", F.row_number().over(larger))
        .where("place = 1")
        .drop("place")
        .orderBy(F.desc("matches"), "pair")
    )
    return ordered if most is None else ordered.limit(most)


def contradictions(
    df: DataFrame, stats: TableStats, most: int | None = 4, **settings
) -> list[Contradiction]:
    """The top contradictions as plain values with the predicate of their rows."""
    found = top_contradictions(contradiction_counts(df, stats, **settings), most).collect()
    return [
        Contradiction(
            f["col_a"],
            f["col_b"],
            f["r"],
            f["direction"],
            f["matches"],
            f["pct"],
            predicate(stats, f["col_a"], f["col_b"], f["direction"]),
        )
        for f in sorted(found, key=lambda f: (-f["matches"], f["pair"]))
    ]
