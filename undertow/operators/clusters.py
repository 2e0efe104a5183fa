"""Hidden subgroups: k-means over the scaled number columns, profiled against the whole table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.cells import number, percent_change, quoted
from undertow.operators.statistics import TableStats, standardised
from undertow.session import written

RESTARTS = 10
SEED = 42
# Centres have settled once they move by less than this, in deviations.
TOLERANCE = 0.01
MOST_ROUNDS = 100
BLOCK_BYTES, BLOCKS = 2048, 256  # in a packed row, and rows that are unpacked at once


@dataclass(frozen=True)
class Clustering:
    """Centres in scaled units, in a fixed order, and the label they give each row.

    `settled` says whether the centres stopped moving before the last round.
    """

    centres: list[list[float]]
    features: list[Column]
    settled: bool = True

    @property
    def label(self) -> Column:
        return nearest(self.features, self.centres)


def nearest(features: list[Column], centres: list[list[float]]) -> Column:
    """The index of the closest centre; ties go to the first."""
    distances = [
        sum(((f - F.lit(v)) * (f - F.lit(v)) for f, v in zip(features, centre)), F.lit(0.0))
        for centre in centres
    ]
    packed = F.array(*distances)
    return (F.array_position(packed, F.array_min(packed)) - 1).cast("int")


def fit_clusters(
    df: DataFrame,
    stats: TableStats,
    columns: list[str],
    k: int | None = None,
    restarts: int = RESTARTS,
    seed: int = SEED,
    most_rounds: int = MOST_ROUNDS,
    tolerance: float = TOLERANCE,
    row_id: str | None = None,
) -> Clustering | None:
    """Best of several k-means runs, all of them over every row.

    The scaled columns are written once, and once more packed in blocks of a few rows, since the many
    rounds would spend most of their time on handing single rows to Python. Each round is one scan of
    the blocks that moves the centres of all restarts together: a task passes on a row of sums per
    restart and cluster. Starting centres are drawn from every row too, by the hash of `row_id`, or of
    a number given when writing.
    """
    if len(columns) < 2 or stats.rows < 12:
        return None
    k = k or (3 if stats.rows >= 30 else 2)
    features = standardised(stats, columns)
    names = [f"f{i}" for i in range(len(columns))]
    row = F.monotonically_increasing_id() if row_id is None else F.col(quoted(row_id))
    scaled = df.select(*[f.alias(n) for f, n in zip(features, names)], F.xxhash64(F.lit(seed), row).alias("row"))
    drawn = written(scaled, "scaled")
    centres, cells = spread_out(drawn, k, restarts), written(packed(drawn.drop("row")), "blocks")
    moving, costs = np.ones(restarts, dtype=bool), np.zeros(restarts)
    for _ in range(most_rounds):
        moved, costs[moving] = one_round(cells, centres[moving])
        step = ((moved - centres[moving]) ** 2).sum((1, 2))
        centres[moving] = moved
        moving[moving] = step > tolerance**2
        if not moving.any():
            break
    best = int(costs.argmin())
    return Clustering(sorted(centres[best].tolist()), features, not moving[best])


def spread_out(drawn: DataFrame, k: int, restarts: int) -> np.ndarray:
    """Starting centres (k-means++): each next one is likelier the further it is from the others.

    `drawn` has the scaled columns and a hash of each row. A scan draws the next centre of every
    restart: rows race by -log(u) over their squared distance, with a u of their own, so each wins
    as often as its share of all squared distances. Once all rows are on a centre, the first repeats.
    """
    names = [n for n in drawn.columns if n != "row"]
    centres = np.empty((restarts, 0, len(names)))
    schema = "restart int, time double, row long, " + ", ".join(f"{n} double" for n in names)
    for turn in range(k):

        def race(batches: Iterator[pa.RecordBatch], centres=centres, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                row = batch.column("row").to_numpy(zero_copy_only=False)
                points = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
                first, times = [], []
                for r in range(restarts):
                    apart = np.ones(len(row))
                    if turn:
                        apart = np.min([((points - c) ** 2).sum(1) for c in centres[r]], axis=0)
                    time = np.full(len(row), np.inf)
                    np.divide(-np.log(units(row, turn * restarts + r)), apart, out=time, where=apart > 0)
                    first.append(int(time.argmin()))
                    times.append(time[first[-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(restarts, dtype=np.int32)), pa.array(times), pa.array(row[first]),
                        *(pa.array(points[first, f]) for f in range(len(names))),
                    ],
                    names=["restart", "time", "row", *names],
                )

        won = drawn.mapInArrow(race, schema).groupBy("restart").agg(
            F.min(F.struct("time", "row", *names)).alias("first")
        )
        chosen = np.empty((restarts, 1, len(names)))
        for r, first in won.collect():
            alone = turn and np.isinf(first["time"])
            chosen[r, 0] = centres[r, 0] if alone else [first[n] for n in names]
        centres = np.concatenate([centres, chosen], axis=1)
    return centres


def units(row: np.ndarray, draw: int) -> np.ndarray:
    """A number between 0 and 1 for each row hash and draw (the mixing steps of SplitMix64)."""
    mixed = row.view(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % 2**64)
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ mixed >> np.uint64(31)) >> np.uint64(11)) / 2.0**53 + 2.0**-54


def packed(cells: DataFrame) -> DataFrame:
    """(points): blocks of rows, the numbers of each one after another; 10,000 blocks, a batch, hold some 20 MB."""
    step = max(1, BLOCK_BYTES // (8 * len(cells.columns)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            blocks = [rows[at : at + step].tobytes() for at in range(0, len(rows), step)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["points"])

    return cells.mapInArrow(pack, "points binary")


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of some blocks at a time, a column for each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCKS):
            blocks = batch.column(0).slice(at, BLOCKS).to_pylist()
            yield np.frombuffer(b"".join(blocks)).reshape(-1, width).T


def first_of(near: np.ndarray) -> np.ndarray:
    """Of the centres that are nearest to a row (restart, centre, row), only the first; if none, centre 0."""
    taken = near[:, 0].copy()
    for c in range(1, near.shape[1]):
        near[:, c] &= ~taken
        taken |= near[:, c]
    near[:, 0] |= ~taken
    return near


def one_round(cells: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each centre's packed rows, and the cost of each restart's present centres."""
    restarts, k, width = centres.shape
    names = [f"f{i}" for i in range(width)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members, costs = (np.zeros((restarts * k, n)) for n in (width, 1, 1))
        for points in unpacked(batches, width):
            # Squared distances less the square of the row itself, to all centres at once.
            apart = (centres**2).sum(2).reshape(-1, 1) - 2 * centres.reshape(-1, width) @ points
            apart = apart.reshape(restarts, k, -1)
            least = apart.min(1)
            own = first_of(apart == least[:, None]).reshape(restarts * k, -1).astype(float)
            sums += own @ points.T
            members += own.sum(1, keepdims=True)
            paid = (least + (points**2).sum(0)).repeat(k, 0)
            costs += (own * paid).sum(1, keepdims=True)
        place = np.arange(restarts * k, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(place), pa.array(members.ravel().astype(np.int64)), pa.array(costs.ravel()),
                *(pa.array(sums[:, f]) for f in range(width)),
            ],
            names=["place", "members", "cost", *names],
        )

    schema = "place int, members long, cost double, " + ", ".join(f"{n} double" for n in names)
    totals = cells.mapInArrow(add_up, schema).groupBy("place").agg(
        F.sum("members").alias("members"),
        F.sum("cost").alias("cost"),
        *[F.sum(n).alias(n) for n in names],
    )
    moved, costs = centres.copy(), np.zeros(restarts)
    for row in totals.collect():
        r, cluster = divmod(row["place"], k)
        costs[r] += row["cost"]
        if row["members"]:
            moved[r, cluster] = [row[n] / row["members"] for n in names]
    return moved, costs


def cluster_profile(df: DataFrame, label: Column, columns: list[str], rows: int) -> DataFrame:
    """(cluster, members, pct, ordinal, variable, mean): means of the columns as they are."""
    grouped = df.groupBy(label.alias("cluster")).agg(
        F.count(F.lit(1)).alias("members"),
        *[F.avg(number(n)).alias(f"m{i}") for i, n in enumerate(columns)],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(n).alias("variable"), F.col(f"m{i}").alias("mean")
            )
            for i, n in enumerate(columns)
        ]
    )
    return grouped.select(
        "cluster",
        "members",
        F.round(F.col("members") / F.lit(rows) * 100, 1).alias("pct"),
        F.inline(per_column),
    ).withColumn("mean", F.round("mean", 2))


def hidden_subgroup(
    profile: DataFrame, stats: TableStats, least_deviation: float = 12.0
) -> DataFrame:
    """The mid-sized cluster that differs most: (cluster, members, pct, deviation), at most one row.

    Only clusters holding 5 to 45 % of the rows count; the deviation is the mean size of the
    percent difference from the overall mean over all columns.
    """
    names = stats.numeric
    overall = F.element_at(
        F.create_map(*[x for n in names for x in (F.lit(n), F.lit(stats[n].mean))]),
        F.col("variable"),
    )
    change = F.abs(percent_change(F.col("mean"), overall))
    return (
        profile.groupBy("cluster", "members", "pct")
        .agg(F.avg(F.coalesce(change, F.lit(0.0))).alias("deviation"))
        .where(F.col("pct").between(5, 45) & (F.col("deviation") > least_deviation))
        .orderBy(F.desc("deviation"), "cluster")
        .limit(1)
    )
