"""Column profile: missing cells, distinct values, roles, number statistics and top values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.cells import column, flat_columns, role_of
from undertow.operators.frequencies import column_counts, common, hashed_counts
from undertow.operators.statistics import TableStats
from undertow.session import small_frame


def column_names(df: DataFrame, names: list[str]) -> DataFrame:
    """(ordinal, column, dtype) of the named columns: as many rows as the schema is wide."""
    position = {name: i for i, name in enumerate(df.columns)}
    rows = [(position[n], n, df.schema[n].dataType.simpleString()) for n in names]
    return small_frame(df.sparkSession, rows, "ordinal int, column string, dtype string")


def column_profile(
    df: DataFrame, columns: list[str] | None = None, per_column: DataFrame | None = None
) -> DataFrame:
    """One row per flat column: rows, missing, missing_pct, distinct_values, role.

    `per_column` may bring `column_counts` measured before.
    """
    names = flat_columns(df) if columns is None else columns
    measured = column_counts(hashed_counts(df, names)) if per_column is None else per_column
    rows = F.coalesce(F.col("rows"), F.lit(0))
    missing = F.coalesce(F.col("missing"), F.lit(0))
    return (
        column_names(df, names)
        .join(F.broadcast(measured), "ordinal", "left")
        .select(
            "ordinal",
            "column",
            "dtype",
            rows.alias("rows"),
            missing.alias("missing"),
            F.round(missing / F.greatest(rows, F.lit(1)) * 100, 1).alias("missing_pct"),
            F.coalesce(F.col("distinct_values"), F.lit(0)).alias("distinct_values"),
            role_of(F.col("column")).alias("role"),
        )
    )


def missing_columns(df: DataFrame, least_pct: float = 5.0) -> DataFrame:
    """Columns with at least `least_pct` percent missing: (ordinal, column, missing, pct)."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(column(n)).alias(f"c{i}") for i, n in enumerate(names)],
    )
    share = (F.col("rows") - F.col("filled")) / F.greatest(F.col("rows"), F.lit(1)) * 100
    per_column = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(n).alias("column"), F.col(f"c{i}").alias("filled")
            )
            for i, n in enumerate(names)
        ]
    )
    return (
        counted.select("rows", F.inline(per_column))
        .where(share >= least_pct)
        .select(
            "ordinal",
            "column",
            (F.col("rows") - F.col("filled")).alias("missing"),
            F.round(share, 1).alias("pct"),
        )
    )


def columns_with_gaps(profiled: DataFrame, least_pct: float = 5.0) -> DataFrame:
    """The same from a column profile measured before."""
    share = F.col("missing") / F.greatest(F.col("rows"), F.lit(1)) * 100
    return profiled.where(share >= least_pct).select(
        "ordinal", "column", "missing", F.round(share, 1).alias("pct")
    )


def number_profile(df: DataFrame, stats: TableStats, decimals: int = 2) -> DataFrame:
    """Mean, median, sample deviation, extremes and quartiles per number column."""
    rows = []
    for i, name in enumerate(df.columns):
        if name not in stats.columns or not stats[name].non_null:
            continue
        c = stats[name]
        std = c.std if c.non_null > 1 else 0.0
        rows.append((i, name, c.mean, c.median, std, c.low, c.high, c.q25, c.q75))
    labels = ("mean", "median", "std", "low", "high", "q25", "q75")
    schema = "ordinal int, column string, " + ", ".join(f"{n} double" for n in labels)
    frame = small_frame(df.sparkSession, rows, schema)
    return frame.select("ordinal", "column", *[F.round(n, decimals).alias(n) for n in labels])


def common_values(df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """Top values of the named columns: (column, place, value, freq)."""
    labels = F.broadcast(column_names(df, names).select("ordinal", "column"))
    return common(df, names, k).join(labels, "ordinal").select(
        "column", "place", "value", "freq"
    )
