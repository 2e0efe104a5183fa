"""How often each value of each column occurs: one grouped pass per data type.

Columns of one type share an unpivoted scan and shuffle, so values keep their native type in the
shuffle. Repeated values are combined before it, so a value holding a third of the rows costs one
record per task. Distinct counts, top values and duplicate keys need no whole text: long texts are
counted by their first characters and 128 bits of hash, so a column of unique documents shuffles some
40 bytes a row instead of itself. Only the few texts that are shown are fetched, in a second scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions.cells import column, flat_columns
from undertow.session import written

WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
APPROXIMATE_CUT = 100
#: Texts of fewer characters are counted as they are.
HEAD = 24
TEXT = "string"


def families(df: DataFrame, names: list[str]) -> Iterator[tuple[str, DataFrame]]:
    """Type and (slot, value) of all cells of the columns of that type; a slot is an ordinal."""
    position = {name: i for i, name in enumerate(df.columns)}
    members: dict[str, list[str]] = {}
    for name in names:
        simple = df.schema[name].dataType.simpleString()
        members.setdefault(WIDER.get(simple, simple), []).append(name)
    for kind, columns in members.items():
        cells = df.select([column(m).cast(kind).alias(str(position[m])) for m in columns])
        long = cells.unpivot([], list(cells.columns), "slot", "value")
        yield kind, long.withColumn("slot", F.col("slot").cast("int"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, value as text, freq); a NULL value carries the number of missing cells."""
    names = flat_columns(df) if columns is None else list(columns)
    parts = [
        cells.groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("freq"))
        .select(F.col("slot").alias("ordinal"), F.col("value").cast("string").alias("value"), "freq")
        for _, cells in families(df, names)
    ]
    return reduce(DataFrame.unionByName, parts)


def hashes(text: Column) -> list[Column]:
    """128 bits of hash of a long text; NULL for the others."""
    cut = F.char_length(text) >= HEAD
    return [F.when(cut, F.xxhash64(F.lit(seed), text)).alias(f"h{seed}") for seed in (0, 1)]


def hashed_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, value, freq, h0, h1): a long text is given by its first `HEAD` characters and hash.

    Otherwise as `value_counts`. Two of 10**12 different texts of a column with the same beginning
    share a hash with a probability below 10**-14.
    """
    names = flat_columns(df) if columns is None else list(columns)
    parts = []
    for kind, cells in families(df, names):
        none = [F.lit(None).cast("long").alias(h) for h in ("h0", "h1")]
        if kind == TEXT:
            head = F.substring("value", 1, HEAD).alias("value")
            cells = cells.select("slot", head, *hashes(F.col("value")))
            keys, none = ("slot", "value", "h0", "h1"), ["h0", "h1"]
        else:
            keys = ("slot", "value")
        parts.append(
            cells.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("freq"))
            .select(
                F.col("slot").alias("ordinal"), F.col("value").cast("string").alias("value"), "freq", *none
            )
        )
    return reduce(DataFrame.unionByName, parts)


def column_counts(counts: DataFrame) -> DataFrame:
    """(ordinal, rows, missing, distinct_values, repeated_rows, repeated_values)."""
    present = F.col("value").isNotNull()
    repeated = present & (F.col("freq") > 1)
    return counts.groupBy("ordinal").agg(
        F.sum("freq").alias("rows"),
        F.sum(F.when(~present, F.col("freq")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
        F.sum(F.when(repeated, F.col("freq")).otherwise(0)).alias("repeated_rows"),
        F.count_if(repeated).alias("repeated_values"),
    )


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller text.

    Spark keeps only k rows per column and task before the shuffle (window group limit).
    """
    order = Window.partitionBy("ordinal").orderBy(F.desc("freq"), "value")
    return (
        counts.where("value IS NOT NULL")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )


def common(df: DataFrame, names: list[str], k: int = 5, least: int = 1) -> DataFrame:
    """(ordinal, value, freq, place) of the k most frequent values that occur `least` times or more.

    As `top_values`, without a shuffle of whole texts. Ranked by frequency and first characters, the
    true top values are among the ranks up to k, for a text that begins smaller is smaller. Where
    long ones are among these, a second scan fetches their texts and settles the order. However many
    texts begin alike and tie, all of them are fetched: Spark picks the join by their size, and splits
    a text that fills many rows.
    """
    order = Window.partitionBy("ordinal").orderBy(F.desc("freq"), "value")
    likely = written(
        hashed_counts(df, names)
        .where(F.col("value").isNotNull() & (F.col("freq") >= least))
        .withColumn("at", F.rank().over(order))
        .where(F.col("at") <= k)
        .drop("at"),
        "likely-values",
    )
    cut = F.col("h0").isNotNull()
    slots = [r["ordinal"] for r in likely.where(cut).select("ordinal").distinct().collect()]
    if not slots:
        return top_values(likely.drop("h0", "h1"), k)
    _, cells = next(families(df.select([column(df.columns[i]).alias(f"c{i}") for i in slots]), [f"c{i}" for i in slots]))
    place = F.element_at(F.array(*[F.lit(i) for i in slots]), F.col("slot") + 1)
    texts = cells.select(place.alias("ordinal"), "value", *hashes(F.col("value")))
    long = likely.where(cut).select("ordinal", "h0", "h1", "freq")
    fetched = texts.join(long, ["ordinal", "h0", "h1"]).select("ordinal", "value", "freq").distinct()
    short = likely.where(~cut).select("ordinal", "value", "freq")
    return top_values(short.unionByName(fetched), k)


def categorical_columns(df: DataFrame, most: int = 20, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns that are no numbers and hold at most `most` distinct values.

    A sketch rules out the columns that are clearly too varied, without a shuffle of their values;
    the rest are counted exactly.
    """
    names = [
        n
        for n in flat_columns(df, leave_out)
        if not isinstance(df.schema[n].dataType, T.NumericType)
    ]
    if not names:
        return []
    cut = max(APPROXIMATE_CUT, 2 * most)
    rough = df.agg(*[F.approx_count_distinct(column(n)).alias(f"c{i}") for i, n in enumerate(names)])
    got = rough.first()
    likely = [n for i, n in enumerate(names) if got[f"c{i}"] <= cut]
    if not likely:
        return []
    exact = column_counts(hashed_counts(df, likely)).where(F.col("distinct_values") <= most)
    kept = {row["ordinal"] for row in exact.select("ordinal").collect()}
    return [n for i, n in enumerate(df.columns) if i in kept]
