"""Rows beyond the first of each group of identical rows (missing equals missing)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.cells import column, flat_columns


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: `duplicate_rows`.

    Rows are told apart by 128 bits of hash over their values and gaps, so 16 bytes a row are
    shuffled at most, and copies are combined before that. Two different rows of a table of 10**12
    share a hash with a probability below 10**-14.
    """
    names = flat_columns(df) if columns is None else list(columns)
    # A hash skips what is missing, so it also covers which values are.
    cells = [part for n in names for part in (column(n).isNull(), column(n))]
    copies = (
        df.groupBy(F.xxhash64(F.lit(0), *cells).alias("h0"), F.xxhash64(F.lit(1), *cells).alias("h1"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return copies.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows")
    )
