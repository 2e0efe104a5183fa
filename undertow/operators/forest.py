"""Isolation forest: Spark draws the samples, grows the trees in parallel and scores the rows.

Each tree sees at most 256 rows, so training never depends on the size of the table: the sampled
rows are chosen by a hash of the row id and only they are shuffled, one group per tree. The
finished forest is at most 100 trees of 511 nodes and travels with the scoring function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.cells import column
from undertow.operators.statistics import TableStats, imputed

TREES = 100
SAMPLE_ROWS = 256
BUCKETS = 1 << 40
TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, depth array<double>"


@dataclass(frozen=True)
class Forest:
    """All trees as complete binary trees: the children of node i are 2i + 1 and 2i + 2.

    A branch that ends early goes left down to the last level, where `depth` holds the expected
    path length. One row per tree.
    """

    feature: np.ndarray
    threshold: np.ndarray
    depth: np.ndarray
    levels: int
    sample_rows: int


def contamination(rows: int) -> float:
    """The share of rows to flag: about 20 rows, within 3 % and 15 %."""
    return min(0.15, max(0.03, 20 / max(rows, 1)))


def average_path(rows: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of this many rows."""
    if rows <= 1:
        return 0.0
    if rows <= 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + np.euler_gamma) - 2.0 * (rows - 1) / rows


def _unit(seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(BUCKETS))


def tree_samples(df: DataFrame, features: list[Column], row_id: str, rows: int, seed: int):
    """(tree, place, features): up to 256 rows for each tree, the same rows on every run.

    Every tree draws on its own, so a row may serve several. A row's first hash says how many trees
    it joins, as if each tree had asked it in turn, and further hashes which; rows that join none,
    nearly all of a large table, go no further. About 512 rows per tree pass on.
    """
    wanted = 2 * SAMPLE_ROWS
    key = column(row_id)
    chance = min(1.0, wanted / max(rows, 1))
    # How likely it is that at most n trees draw a row, in parts of BUCKETS.
    joins = np.cumsum([math.comb(TREES, n) * chance**n * (1 - chance) ** (TREES - n) for n in range(TREES)])
    limits = F.array(*[F.lit(int(BUCKETS * min(1.0, x))) for x in joins])
    first = _unit(seed, F.col("row_key"))
    turns = F.when(first < F.get(limits, F.lit(0)), 0).otherwise(
        F.size(F.filter(limits, lambda limit: limit <= first))
    )
    trees = F.slice(
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda tree: F.struct(
                    _unit(seed + 1, F.col("row_key"), tree).alias("turn"), tree.alias("tree")
                ),
            )
        ),
        F.lit(1),
        F.col("turns"),
    )
    cells = df.select(key.alias("row_key"), F.array(*features).alias("features"))
    drawn = (
        cells.withColumn("turns", turns)
        .where("turns > 0")
        .select("row_key", "features", F.explode(trees).alias("drawn"))
        .select(
            "row_key", "features", F.col("drawn.tree").alias("tree"),
            _unit(seed + 2, F.col("row_key"), F.col("drawn.tree")).alias("draw"),
        )
    )
    # An explicit number of partitions keeps small samples from being merged into one slow task.
    spread = min(TREES, df.sparkSession.sparkContext.defaultParallelism)
    order = Window.partitionBy("tree").orderBy("draw", "row_key")
    return (
        drawn.repartition(spread, "tree")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE_ROWS)
        .select(F.col("tree").cast("int").alias("tree"), "place", "features")
    )


def grow_tree(points: np.ndarray, rng: np.random.Generator, levels: int) -> tuple:
    """Split at random until a node holds one row, equal rows, or the last level is reached."""
    feature = np.zeros(2**levels - 1, dtype=np.int32)
    threshold = np.full(2**levels - 1, np.inf)
    depth = np.zeros(2**levels)
    pending = [(0, 0, points)]
    while pending:
        node, level, block = pending.pop()
        low, high = block.min(axis=0), block.max(axis=0)
        usable = np.flatnonzero(high > low)
        if level == levels or not len(usable):
            leaf = ((node + 1) << (levels - level)) - 2**levels
            depth[leaf] = level + average_path(len(block))
            continue
        chosen = rng.choice(usable)
        cut = rng.uniform(low[chosen], high[chosen])
        feature[node], threshold[node] = chosen, cut
        goes_left = block[:, chosen] <= cut
        pending.append((2 * node + 2, level + 1, block[~goes_left]))
        pending.append((2 * node + 1, level + 1, block[goes_left]))
    return feature, threshold, depth


def grow_forest(
    df: DataFrame, stats: TableStats, columns: list[str], row_id: str, seed: int = 42
) -> Forest:
    # Splits depend only on the order of values within a column, so no scaling is needed.
    sample_rows = min(SAMPLE_ROWS, stats.rows)
    levels = max(1, math.ceil(math.log2(max(sample_rows, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("place")
        points = np.array(ordered["features"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        arrays = [part.tolist() for part in grow_tree(points, rng, levels)]
        return pd.DataFrame([(tree, *arrays)], columns=["tree", "feature", "threshold", "depth"])

    samples = tree_samples(df, imputed(stats, columns), row_id, stats.rows, seed)
    grown = samples.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).collect()
    trees = sorted(grown, key=lambda row: row["tree"])
    return Forest(
        np.array([t["feature"] for t in trees], dtype=np.int32),
        np.array([t["threshold"] for t in trees]),
        np.array([t["depth"] for t in trees]),
        levels,
        sample_rows,
    )


def path_lengths(forest: Forest, points: np.ndarray) -> np.ndarray:
    """Mean path length of each point over all trees."""
    total = np.zeros(len(points))
    cells = np.ascontiguousarray(points).ravel()
    start = np.arange(len(points), dtype=np.int32) * points.shape[1]
    for feature, threshold, depth in zip(forest.feature, forest.threshold, forest.depth):
        node = np.zeros(len(points), dtype=np.int32)
        for _ in range(forest.levels):
            value = cells.take(start + feature.take(node))
            right = value > threshold.take(node)
            node = 2 * node + 1 + right
        total += depth.take(node - len(feature))
    return total / len(forest.feature)


def isolation_score(forest: Forest, features: list[Column]) -> Column:
    """0..1 per row: 1 for rows cut off after few splits. Batches go through Arrow."""
    scale = average_path(forest.sample_rows) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            points = np.column_stack([part.to_numpy(dtype=float) for part in batch])
            yield pd.Series(np.exp2(-path_lengths(forest, points) / scale))

    return score(*features)
