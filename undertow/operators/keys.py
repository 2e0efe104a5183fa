"""Columns that look like keys but repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import vocabulary as words
from undertow.functions.cells import flat_columns
from undertow.operators.frequencies import column_counts, common, hashed_counts
from undertow.operators.profile import column_names
from undertow.session import small_frame


def key_columns(
    df: DataFrame,
    per_column: DataFrame | None = None,
    most: int | None = 3,
    hints: tuple[str, ...] = words.KEY_WORDS,
) -> DataFrame:
    """(ordinal, column, repeated_rows, pct, distinct_ratio) of repeating key columns.

    A near-unique column is a key when its name says so, or when almost nothing repeats. The count
    covers every row that shares its value. `per_column` may bring `column_counts` measured before.
    """
    names = flat_columns(df)
    if per_column is None:
        per_column = column_counts(hashed_counts(df, names))
    present = F.col("rows") - F.col("missing")
    ratio = F.col("distinct_values") / F.nullif(present, F.lit(0))
    named = F.lit(False)
    for hint in hints:
        named = named | F.lower("column").contains(hint)
    keys = (
        per_column.join(F.broadcast(column_names(df, names)), "ordinal")
        .withColumn("distinct_ratio", ratio)
        .where((present >= 5) & (F.col("repeated_rows") > 0) & (F.col("distinct_ratio") >= 0.7))
        .where(named | ((F.col("distinct_ratio") > 0.95) & (F.col("repeated_rows") <= 5)))
        .select(
            "ordinal",
            "column",
            "repeated_rows",
            F.round(F.col("repeated_rows") / F.col("rows") * 100, 1).alias("pct"),
            F.round("distinct_ratio", 4).alias("distinct_ratio"),
        )
    )
    return keys if most is None else keys.orderBy("ordinal").limit(most)


def key_examples(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The most repeated values of the chosen columns: (column, place, value, freq, example)."""
    if not columns:
        schema = "column string, place int, value string, freq bigint, example string"
        return small_frame(df.sparkSession, [], schema)
    labels = F.broadcast(column_names(df, columns).select("ordinal", "column"))
    example = F.concat(F.col("value"), F.lit(" ×"), F.col("freq").cast("string"))
    return (
        common(df, columns, k, least=2)
        .join(labels, "ordinal")
        .select("column", "place", "value", "freq", example.alias("example"))
    )
