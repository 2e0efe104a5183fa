"""A flagged group against the rest of the table, for many groups and columns in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.cells import long_numbers, percent_change
from undertow.session import small_frame


def compare_groups(df: DataFrame, groups: dict[str, str], columns: list[str]) -> DataFrame:
    """Group mean and rest mean of every column, for every predicate.

    (group, ordinal, variable, group_size, group_mean, rest_mean, diff_pct). A row whose
    predicate is unknown belongs to the rest.
    """
    spark = df.sparkSession
    if not groups or not columns:
        schema = (
            "group string, ordinal int, variable string, group_size bigint, group_mean double,"
            " rest_mean double, diff_pct double"
        )
        return small_frame(spark, [], schema)
    flags = {f"_in_{g}": F.coalesce(F.expr(rule), F.lit(False)) for g, rule in enumerate(groups.values())}
    flagged = df.withColumns(flags)
    measured = long_numbers(flagged, columns, tuple(flags)).groupBy("slot").agg(
        *[
            expression
            for flag in flags
            for expression in (
                F.count_if(flag).alias(f"size{flag}"),
                F.avg(F.when(F.col(flag), F.col("value"))).alias(f"group{flag}"),
                F.avg(F.when(~F.col(flag), F.col("value"))).alias(f"rest{flag}"),
            )
        ]
    )
    per_group = F.array(
        *[
            F.struct(
                F.lit(label).alias("group"),
                F.col(f"size{flag}").alias("group_size"),
                F.coalesce(f"group{flag}", F.lit(0.0)).alias("group_mean"),
                F.coalesce(f"rest{flag}", F.lit(0.0)).alias("rest_mean"),
            )
            for label, flag in zip(groups, flags)
        ]
    )
    names = F.array(*[F.lit(n) for n in columns])
    compared = measured.select(F.col("slot").alias("ordinal"), F.inline(per_group))
    return compared.select(
        "group",
        "ordinal",
        names[F.col("ordinal")].alias("variable"),
        "group_size",
        "group_mean",
        "rest_mean",
        percent_change(F.col("group_mean"), F.col("rest_mean")).alias("diff_pct"),
    )


def evidence(compared: DataFrame, pairs: dict[str, tuple[str, str]], extra: int = 3) -> DataFrame:
    """The lines shown for each contradiction: its two columns, then the next few number columns.

    (group, place, variable, group_mean, rest_mean, diff_pct, line)
    """
    spark = compared.sparkSession
    own = small_frame(spark,
        [(group, i, name) for group, pair in pairs.items() for i, name in enumerate(pair)],
        "group string, own int, variable string",
    )
    # A pair's own columns sort first; the others follow in column order.
    order = Window.partitionBy("group").orderBy(F.col("own").asc_nulls_last(), "ordinal")
    line = F.format_string(
        "%s: group %.1f vs rest %.1f (%+.1f%%)",
        "variable",
        "group_mean",
        "rest_mean",
        "diff_pct",
    )
    return (
        compared.join(F.broadcast(own), ["group", "variable"], "left")
        .withColumn("place", F.row_number().over(order) - 1)
        .where(F.col("place") < 2 + extra)
        .withColumn("line", line)
        .select("group", "place", "variable", "group_mean", "rest_mean", "diff_pct", "line")
    )


def contributing_factor(
    compared: DataFrame, pairs: dict[str, tuple[str, str]], least_pct: float = 12.0
) -> DataFrame:
    """The other column that sets each group apart most: (group, variable, diff_pct).

    `diff_pct` is the size of the difference; groups where it is below `least_pct` give no row.
    """
    spark = compared.sparkSession
    own = small_frame(spark,
        [(group, name) for group, pair in pairs.items() for name in pair],
        "group string, variable string",
    )
    size = F.abs("diff_pct")
    return (
        compared.join(F.broadcast(own), ["group", "variable"], "left_anti")
        .groupBy("group")
        .agg(F.min(F.struct((-size).alias("key"), "ordinal", "variable")).alias("best"))
        .where(-F.col("best.key") >= least_pct)
        .select(
            "group",
            F.col("best.variable").alias("variable"),
            F.round(-F.col("best.key"), 1).alias("diff_pct"),
        )
    )
