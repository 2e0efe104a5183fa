"""Categories whose groups differ widely in the mean of a number column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions import vocabulary as words
from undertow.functions.cells import column, number
from undertow.operators.statistics import TableStats
from undertow.session import small_frame


def judged_columns(stats: TableStats, skip: tuple[str, ...] = words.SEGMENT_SKIP) -> list[str]:
    """Number columns with a clear good direction and an overall mean to compare with."""
    return [n for n in stats.numeric if not words.has_word(n, skip) and stats[n].mean]


def group_means(
    df: DataFrame,
    numbers: list[str],
    categories: list[str],
    most_groups: int = 8,
    least_rows: int = 3,
) -> DataFrame:
    """Mean of every number per group of every usable category, from one scan and one shuffle.

    (category, cat_ordinal, grp, size, number, num_ordinal, mean). A category is usable with 2 to
    `most_groups` groups of at least `least_rows` rows. Each task adds up its rows in a table of its own
    for all categories and numbers together, and shuffles one row per group, however uneven the groups
    are; a category that shows more groups than allowed within a task is given up there.
    """
    schema = (
        "category string, cat_ordinal int, grp string, size bigint, number string,"
        " num_ordinal int, mean double"
    )
    if not numbers or not categories:
        return small_frame(df.sparkSession, [], schema)
    cells = df.select(
        *[number(n).alias(f"n{i}") for i, n in enumerate(numbers)],
        *[column(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)],
    )
    numeric = [f"n{i}" for i in range(len(numbers))]
    added = [f"{kind}{i}" for kind in ("sum", "held") for i in range(len(numbers))]
    kinds = ["double"] * len(numbers) + ["long"] * len(numbers)
    totals = cells.mapInArrow(
        _group_totals(len(numbers), len(categories), most_groups),
        "slot string, grp string, size long, " + ", ".join(f"{n} {k}" for n, k in zip(added, kinds)),
    )
    grouped = totals.groupBy("slot", "grp").agg(F.sum("size").alias("size"), *[F.sum(n).alias(n) for n in added])
    means = [
        F.when(F.col(f"held{i}") > 0, F.col(f"sum{i}") / F.col(f"held{i}")).alias(n) for i, n in enumerate(numeric)
    ]
    whole = Window.partitionBy("slot")
    usable = (
        grouped.select("slot", "grp", "size", *means)
        .withColumn("groups", F.count(F.lit(1)).over(whole))
        .withColumn("smallest", F.min("size").over(whole))
        .withColumn("given_up", F.max(F.col("grp").isNull()).over(whole))
        .where(
            F.col("groups").between(2, most_groups) & (F.col("smallest") >= least_rows) & ~F.col("given_up")
        )
    )
    cat_ordinal = F.substring("slot", 2, 9).cast("int")
    per_number = F.array(
        *[
            F.struct(
                F.lit(n).alias("number"), F.lit(i).alias("num_ordinal"), F.col(f"n{i}").alias("mean")
            )
            for i, n in enumerate(numbers)
        ]
    )
    return usable.select(
        F.array(*[F.lit(c) for c in categories])[cat_ordinal].alias("category"),
        cat_ordinal.alias("cat_ordinal"),
        "grp",
        "size",
        F.inline(per_number),
    )


def _group_totals(
    numbers: int, categories: int, most_groups: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sizes, sums and counts of each group; a row without a group marks a category that is given up."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[dict[str, np.ndarray] | None] = [{} for _ in range(categories)]
        for batch in batches:
            values = np.array(
                [batch.column(i).to_numpy(zero_copy_only=False) for i in range(numbers)], dtype=float
            ).reshape(numbers, batch.num_rows)
            held = ~np.isnan(values)
            values = np.where(held, values, 0.0)
            for at, table in enumerate(tables):
                if table is None:
                    continue
                coded = batch.column(numbers + at).dictionary_encode()
                groups = coded.dictionary.to_pylist()
                if len(table.keys() | set(groups)) > most_groups:
                    tables[at] = None
                    continue
                rows = coded.indices.is_valid().to_numpy(zero_copy_only=False)
                code, n = coded.indices.drop_null().to_numpy(), len(groups)
                totals = [np.bincount(code, minlength=n)]
                totals += [np.bincount(code, weights, n) for weights in (*values[:, rows], *held[:, rows])]
                for group, row in zip(groups, np.stack(totals, 1).astype(float)):
                    table[group] = table.get(group, 0.0) + row
        rows = [
            (f"c{at}", group, *found)
            for at, table in enumerate(tables)
            for group, found in ({None: np.zeros(1 + 2 * numbers)} if table is None else table).items()
        ]
        names = ["slot", "grp", "size", *(f"{k}{i}" for k in ("sum", "held") for i in range(numbers))]
        kinds = [pa.string()] * 2 + [pa.int64()] + [pa.float64()] * numbers + [pa.int64()] * numbers
        cells = list(zip(*rows)) or [()] * len(names)
        columns = [
            pa.array([int(x) for x in column] if kind == pa.int64() else column, kind)
            for column, kind in zip(cells, kinds)
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return add_up


def segment_gaps(
    means: DataFrame,
    stats: TableStats,
    least_spread: float = 0.12,
    worse_high: tuple[str, ...] = words.HIGHER_IS_WORSE,
) -> DataFrame:
    """Category and number pairs whose best and worst groups lie far apart.

    (category, number, cat_ordinal, num_ordinal, spread_pct, overall, worst, worst_mean, groups).
    Ties for the worst group go to the first in sort order. `groups` lists (grp, mean, size).
    """
    numbers = [n for n in stats.numeric if stats[n].mean]
    schema = (
        "category string, number string, cat_ordinal int, num_ordinal int, spread_pct double,"
        " overall double, worst string, worst_mean double, worst_size bigint,"
        " groups array<struct<grp:string,mean:double,size:bigint>>"
    )
    if not numbers:
        return small_frame(means.sparkSession, [], schema)
    overall = F.element_at(
        F.create_map(*[x for n in numbers for x in (F.lit(n), F.lit(stats[n].mean))]), F.col("number")
    )
    high = [n for n in numbers if words.has_word(n, worse_high)]
    badness = F.when(F.col("number").isin(high), -F.col("mean")).otherwise(F.col("mean"))
    summary = (
        means.where("mean IS NOT NULL")
        .groupBy("category", "cat_ordinal", "number", "num_ordinal")
        .agg(
            F.max("mean").alias("top"),
            F.min("mean").alias("bottom"),
            F.min(F.struct(badness.alias("badness"), "grp", "mean", "size")).alias("w"),
            F.sort_array(F.collect_list(F.struct("grp", "mean", "size"))).alias("groups"),
        )
        .withColumn("overall", overall)
        .withColumn("spread", (F.col("top") - F.col("bottom")) / F.abs("overall"))
    )
    return summary.where(F.col("spread") > least_spread).select(
        "category",
        "number",
        "cat_ordinal",
        "num_ordinal",
        F.round(F.col("spread") * 100, 1).alias("spread_pct"),
        F.round("overall", 2).alias("overall"),
        F.col("w.grp").alias("worst"),
        F.round("w.mean", 2).alias("worst_mean"),
        F.col("w.size").alias("worst_size"),
        "groups",
    )


def top_segments(gaps: DataFrame, most: int | None = 4) -> DataFrame:
    ordered = gaps.orderBy(F.desc("spread_pct"), "cat_ordinal", "num_ordinal")
    return ordered if most is None else ordered.limit(most)
