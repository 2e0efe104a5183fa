"""How queries are registered, and the derived table most of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Orders with known patterns in them: a broken correlation, gaps, range errors, a slow segment,
# a broken product, repeated references and amounts kept as text. Runs unchanged in both engines.
PLANTED = """
SELECT o_orderkey AS order_id,
       o_orderpriority AS segment_priority,
       o_orderstatus AS status,
       o_totalprice AS spend_plan,
       CASE WHEN o_orderkey % 5 = 0 THEN 500000 - o_totalprice
            ELSE CAST(0.9 AS DOUBLE) * o_totalprice + 100 * (o_orderkey % 101) END AS final_result,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE CAST((o_orderkey * 37) % 9001 AS DOUBLE) / 100
                 + CASE WHEN o_orderkey % 250 = 7 THEN 120 ELSE 0 END END AS attendance_pct,
       CAST(2 + (o_orderkey % 7)
            + CASE WHEN o_orderpriority = '5-LOW' THEN 3 ELSE 0 END AS DOUBLE) AS delivery_time,
       CAST(1 + (o_orderkey * 13) % 40 AS DOUBLE) AS units,
       CAST(5 + (o_orderkey * 29) % 300 AS DOUBLE) AS unit_value,
       CAST(1 + (o_orderkey * 13) % 40 AS DOUBLE) * CAST(5 + (o_orderkey * 29) % 300 AS DOUBLE)
         + CASE WHEN o_orderkey % 500 = 3 THEN 7777 ELSE 0 END AS line_total,
       CAST(o_orderkey - CASE WHEN o_orderkey % 200 = 1 THEN 1 ELSE 0 END AS BIGINT) AS ref_code,
       CASE WHEN o_orderkey % 17 = 0 THEN ' N/A ' WHEN o_orderkey % 19 = 0 THEN '-'
            ELSE concat('$', CAST(o_orderkey * 3 AS VARCHAR(20)), '.50') END AS amount_text,
       o_orderdate AS order_date
FROM orders
"""

NUMBERS = [
    "order_id", "spend_plan", "final_result", "attendance_pct", "delivery_time", "units",
    "unit_value", "line_total", "ref_code",
]
COLUMNS = [
    "order_id", "segment_priority", "status", "spend_plan", "final_result", "attendance_pct",
    "delivery_time", "units", "unit_value", "line_total", "ref_code", "amount_text", "order_date",
]


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, sql: str, *tables: str) -> DataFrame:
    """A table Spark derives from the given ones with the same SQL the check runs."""
    for table in tables:
        sql = sql.replace(f" {table}\n", f" {{{table}}}\n")
    return spark.sql(sql, **{t: load(spark, folder, t) for t in tables})


def planted(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, PLANTED, "orders")


def with_planted(sql: str) -> str:
    return f"WITH planted AS ({PLANTED}),\n{sql}"


def on_planted(sql: str) -> str:
    return f"WITH planted AS ({PLANTED})\n{sql}"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
