"""Chart data as small DataFrames; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions import vocabulary as words
from undertow.functions.cells import column, number
from undertow.operators.statistics import TableStats
from undertow.plans.findings import severity_rank
from undertow.session import small_frame

SCATTER_ROWS = 600
TREND_POINTS = 24
LEAST_TREND_POINTS = 3
# Widths in seconds, up to a week, and calendar grains with their shortest length in days.
WIDTHS = (
    1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1_800, 3_600, 7_200, 10_800, 21_600, 43_200, 86_400,
    172_800, 604_800,
)
GRAINS = (("month", 28), ("quarter", 90), ("year", 365))


def scatter_points(
    df: DataFrame, x: str, y: str, predicate: str, row_id: str, most: int | None = SCATTER_ROWS
) -> DataFrame:
    """(row_id, x, y, flagged) of the first rows in row order that have both values."""
    return _points(df if most is None else df.orderBy(column(row_id)).limit(most), x, y, predicate, row_id)


def scatter_sample(
    df: DataFrame, x: str, y: str, predicate: str, row_id: str, most: int | None = SCATTER_ROWS
) -> DataFrame:
    """(row_id, x, y, flagged) of up to `most` / 2 flagged rows and as many others with both values.

    Rows are taken in the order of the MD5 of their id (as text, then the id), so the points are the
    same however the table is cut into files and tasks, and flagged ones show however rare they are. A
    task passes on no more rows of each kind than are shown; what two tables give can be cut again.
    """
    points = _points(df, x, y, predicate, row_id)
    if most is None:
        return points
    drawn = Window.partitionBy("flagged").orderBy(F.md5(F.col("row_id").cast("string").cast("binary")), "row_id")
    return points.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= most // 2).drop("place")


def _points(df: DataFrame, x: str, y: str, predicate: str, row_id: str) -> DataFrame:
    return df.where(number(x).isNotNull() & number(y).isNotNull()).select(
        column(row_id).alias("row_id"),
        number(x).alias("x"),
        number(y).alias("y"),
        F.coalesce(F.expr(predicate), F.lit(False)).alias("flagged"),
    )


def segment_bars(gaps: DataFrame) -> DataFrame:
    """(category, number, label, value, overall, highlighted) per group of each segment gap."""
    return gaps.select(
        "category", "number", "overall", "worst", F.inline("groups")
    ).select(
        "category",
        "number",
        F.col("grp").alias("label"),
        F.round("mean", 2).alias("value"),
        "overall",
        (F.col("grp") == F.col("worst")).alias("highlighted"),
    )


def formula_pairs(examples: DataFrame) -> DataFrame:
    """(rule_no, place, label, recorded, expected) for the rows shown of each broken rule."""
    return examples.select(
        "rule_no",
        "place",
        F.substring("label", 1, 18).alias("label"),
        F.round("recorded", 2).alias("recorded"),
        F.round("expected", 2).alias("expected"),
    )


def cluster_bars(profile: DataFrame, stats: TableStats, cluster: int, most: int = 5) -> DataFrame:
    """(ordinal, variable, cluster_mean, overall_mean) of the first columns."""
    names = stats.numeric
    overall = F.element_at(
        F.create_map(*[x for n in names for x in (F.lit(n), F.lit(stats[n].mean))]),
        F.col("variable"),
    )
    return profile.where((F.col("cluster") == cluster) & (F.col("ordinal") < most)).select(
        "ordinal",
        "variable",
        F.col("mean").alias("cluster_mean"),
        F.round(overall, 1).alias("overall_mean"),
    )


def missing_bars(missing: DataFrame) -> DataFrame:
    return missing.select(F.col("column").alias("label"), F.col("pct").alias("value"))


def most_cited(findings: DataFrame, numbers: list[str]) -> str | None:
    """The number column most findings name; ties go to the one that ranks first.

    The findings are a few rows, numbered here by rank.
    """
    rank = Window.orderBy(severity_rank(), F.desc("confidence"), "ordinal")
    cited = (
        findings.withColumn("rank", F.row_number().over(rank))
        .select("rank", F.posexplode("columns").alias("place", "column"))
        .where(F.col("column").isin(numbers))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "place")).alias("at"))
        .orderBy(F.desc("n"), "at")
        .first()
    )
    return cited["column"] if cited else None


def histogram(df: DataFrame, name: str, stats: TableStats) -> DataFrame:
    """(bin, label, rows) over equal-width bins; the last bin includes the maximum."""
    c = stats[name]
    schema = "bin int, label double, rows bigint"
    if c.non_null < 10:
        return small_frame(df.sparkSession, [], schema)
    bins = min(20, max(8, c.non_null // 10))
    low, high = (c.low, c.high) if c.low < c.high else (c.low - 0.5, c.high + 0.5)
    place = F.floor((number(name) - F.lit(low)) / F.lit(high - low) * bins)
    counted = (
        df.where(number(name).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    width = (high - low) / bins
    label = F.round(F.lit(low) + (F.col("bin") + 0.5) * F.lit(width), 1)
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", label.alias("label"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def time_column(df: DataFrame) -> str | None:
    return next((n for n in df.columns if words.has_word(n, words.TIME_WORDS)), None)


def fitting_grain(df: DataFrame, time: str, most: int) -> Column:
    """The column rounded down to the finest grain whose whole span has at most `most` points."""
    at = column(time)
    ends = df.agg(F.min(at).cast("timestamp_ntz").alias("low"), F.max(at).cast("timestamp_ntz").alias("high")).first()
    if ends["low"] is None:
        return at
    seconds = (ends["high"] - ends["low"]).total_seconds()
    for width in WIDTHS:
        if seconds / width < most - 1:
            start = F.floor(F.unix_seconds(at.cast("timestamp")) / width) * width
            return F.timestamp_seconds(start).cast("timestamp_ntz")
    for grain, days in GRAINS:
        if seconds / (86_400 * days) < most - 1:
            return F.date_trunc(grain, at)
    years = -(-(ends["high"].year - ends["low"].year + 1) // most)
    return F.make_date(F.floor(F.year(at) / years) * years, F.lit(1), F.lit(1))


def trend(
    df: DataFrame, time: str, metric: str, grain: str | None = None, most: int = TREND_POINTS
) -> DataFrame:
    """(label, value): the metric's mean per point in time, earliest first.

    `grain` (such as "month") rounds timestamps down; without one, the finest grain is taken that
    covers the whole span. Month names follow the calendar.
    """
    at = column(time)
    if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = F.date_trunc(grain, at) if grain else fitting_grain(df, time, most)
    means = df.groupBy(at.alias("at")).agg(F.avg(number(metric)).alias("mean"))
    means = means.where("at IS NOT NULL")
    order = [F.col("at")]
    if isinstance(df.schema[time].dataType, T.StringType):
        months = F.array(*[F.lit(m) for m in words.MONTH_NAMES])
        order.insert(0, F.array_position(months, F.lower("at")))
    return (
        means.orderBy(*order)
        .limit(most)
        .select(F.col("at").cast("string").alias("label"), F.round("mean", 2).alias("value"))
    )
