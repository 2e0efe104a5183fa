"""Column profiles: P1 to P4, I11, M1, D1, D2, Q5."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import COLUMNS, NUMBERS, load, on_planted, planted, register, union_all
from undertow.operators.duplicates import duplicate_rows
from undertow.operators.frequencies import categorical_columns
from undertow.operators.keys import key_columns, key_examples
from undertow.operators.profile import (
    column_profile,
    common_values,
    missing_columns,
    number_profile,
)
from undertow.operators.quantiles import exact_quantiles
from undertow.operators.statistics import measure
from undertow.session import small_frame

ROLES = {
    "order_id": "meta", "segment_priority": "segment", "status": "metric",
    "spend_plan": "driver", "final_result": "outcome", "attendance_pct": "driver",
    "delivery_time": "metric", "units": "metric", "unit_value": "metric",
    "line_total": "metric", "ref_code": "metric", "amount_text": "metric",
    "order_date": "meta",
}


@register(
    "profile_columns",
    on_planted(
        union_all(
            [
                f"""SELECT {i} AS ordinal, '{c}' AS "column", count(*) AS "rows",
                count(*) - count({c}) AS missing,
                round((count(*) - count({c})) / greatest(count(*), 1) * 100, 1) AS missing_pct,
                count(DISTINCT {c}) AS distinct_values, '{ROLES[c]}' AS role FROM planted"""
                for i, c in enumerate(COLUMNS)
            ]
        )
    ),
)
def profile_columns(spark, folder):
    return column_profile(planted(spark, folder)).drop("dtype")


# Quartiles of values with two decimals have up to four; fewer would compare how ties are rounded.
NUMBER_SQL = """SELECT {i} AS ordinal, '{c}' AS "column", round(avg({c}), 4) AS mean,
    round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
    round(min({c})::DOUBLE, 4) AS low, round(max({c})::DOUBLE, 4) AS high,
    round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75
    FROM {t}"""


@register(
    "profile_numbers",
    on_planted(
        union_all(
            [NUMBER_SQL.format(i=COLUMNS.index(c), c=c, t="planted") for c in NUMBERS]
        )
    ),
)
def profile_numbers(spark, folder):
    table = planted(spark, folder)
    return number_profile(table, measure(table), decimals=4)


PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "profile_numbers_large_table",
    union_all(
        [NUMBER_SQL.format(i=i, c=c, t="lineitem") for i, c in enumerate(PRICED)]
    ),
)
def profile_numbers_large_table(spark, folder):
    """The path a large table takes: quantiles searched for, never one column in one task."""
    table = load(spark, folder, "lineitem").select(*PRICED)
    return number_profile(table, measure(table, direct_rows=0), decimals=4)


SHARES = (0.01, 0.5, 0.99)


@register(
    "quantiles_with_heavy_repeats",
    union_all(
        [
            f"""SELECT '{c}' AS "column", {p}::DOUBLE AS share,
            round(quantile_cont({c}, {p}), 4) AS value FROM documents"""
            for c in ("n_chars",)
            for p in SHARES
        ]
        + [
            f"""SELECT 'capped' AS "column", {p}::DOUBLE AS share,
            round(quantile_cont(least(n_chars, 300), {p}), 4) AS value FROM documents"""
            for p in SHARES
        ]
    ),
)
def quantiles_with_heavy_repeats(spark, folder):
    """Most rows of `capped` hold one value; the search must step over it."""
    table = load(spark, folder, "documents").select(
        "n_chars", F.least("n_chars", F.lit(300)).alias("capped")
    )
    rows = table.count()
    names = ("n_chars", "capped")
    found = exact_quantiles(
        table, {n: rows for n in names}, SHARES, direct_rows=0, accuracy=50, zone_rows=10
    )
    values = [(n, p, v) for n in names for p, v in zip(SHARES, found[n])]
    frame = small_frame(spark, values, "column string, share double, value double")
    return frame.withColumn("value", F.round("value", 4))


TEXTS = ["segment_priority", "status", "amount_text", "order_date"]


@register(
    "profile_top_values",
    on_planted(
        union_all(
            [
                f"""SELECT * FROM (SELECT '{c}' AS "column",
                row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place,
                CAST({c} AS VARCHAR) AS value, count(*) AS freq
                FROM planted WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 5"""
                for c in TEXTS
            ]
        )
    ),
)
def profile_top_values(spark, folder):
    return common_values(planted(spark, folder), TEXTS)


@register(
    "duplicate_rows",
    """SELECT CAST(count(*) - (SELECT count(*) FROM
    (SELECT DISTINCT event_type, user_id FROM events)) AS BIGINT) AS duplicate_rows FROM events""",
)
def duplicates(spark, folder):
    return duplicate_rows(load(spark, folder, "events"), ["event_type", "user_id"])


@register(
    "duplicate_rows_large_table",
    """SELECT CAST(count(*) - (SELECT count(*) FROM
    (SELECT DISTINCT l_partkey, l_quantity, l_discount FROM lineitem)) AS BIGINT)
    AS duplicate_rows FROM lineitem""",
)
def duplicates_large_table(spark, folder):
    return duplicate_rows(load(spark, folder, "lineitem"), ["l_partkey", "l_quantity", "l_discount"])


@register(
    "column_kinds",
    on_planted(
        "SELECT * FROM ("
        + union_all(
            [f"""SELECT '{c}' AS "column", 'number' AS kind FROM planted
            HAVING count({c}) > 0""" for c in NUMBERS]
            + [
                f"""SELECT '{c}' AS "column", 'category' AS kind FROM planted
                HAVING count(DISTINCT {c}) <= 20"""
                for c in TEXTS
            ]
        )
        + ")"
    ),
)
def column_kinds(spark, folder):
    table = planted(spark, folder)
    kinds = [(n, "number") for n in measure(table, quartiles=False).numeric]
    kinds += [(n, "category") for n in categorical_columns(table)]
    return small_frame(spark, kinds, "column string, kind string")


@register(
    "missing_columns",
    on_planted(
        'SELECT ordinal, "column", missing, round(share, 1) AS pct FROM ('
        + union_all(
            [
                f"""SELECT {i} AS ordinal, '{c}' AS "column", count(*) - count({c}) AS missing,
                (count(*) - count({c})) / greatest(count(*), 1) * 100 AS share FROM planted"""
                for i, c in enumerate(COLUMNS)
            ]
        )
        + ") WHERE share >= 5"
    ),
)
def missing(spark, folder):
    return missing_columns(planted(spark, folder))


HINTED = {"order_id", "ref_code"}
KEY_SQL = (
    'SELECT ordinal, "column", repeated_rows, round(repeated_rows / total * 100, 1) AS pct,'
    " round(uniq / filled, 4) AS distinct_ratio FROM ("
    + union_all(
        [
            f"""SELECT {i} AS ordinal, '{c}' AS "column",
            coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS repeated_rows,
            count(*) AS uniq, sum(n)::BIGINT AS filled, (SELECT count(*) FROM planted) AS total,
            {str(c in HINTED).lower()} AS hinted
            FROM (SELECT {c} AS v, count(*) AS n FROM planted WHERE {c} IS NOT NULL GROUP BY 1)"""
            for i, c in enumerate(COLUMNS)
        ]
    )
    + """) WHERE filled >= 5 AND repeated_rows > 0 AND uniq / filled >= 0.7
    AND (hinted OR (uniq / filled > 0.95 AND repeated_rows <= 5)) ORDER BY ordinal LIMIT 3"""
)


@register("duplicate_keys", on_planted(KEY_SQL))
def duplicate_keys(spark, folder):
    return key_columns(planted(spark, folder))


@register(
    "duplicate_key_examples",
    on_planted(
        """SELECT * FROM (SELECT 'ref_code' AS "column",
        row_number() OVER (ORDER BY count(*) DESC, CAST(ref_code AS VARCHAR)) AS place,
        CAST(ref_code AS VARCHAR) AS value, count(*) AS freq,
        concat(CAST(ref_code AS VARCHAR), ' ×', CAST(count(*) AS VARCHAR)) AS example
        FROM planted GROUP BY ref_code HAVING count(*) > 1) WHERE place <= 5"""
    ),
)
def duplicate_key_examples(spark, folder):
    return key_examples(planted(spark, folder), ["ref_code"])
