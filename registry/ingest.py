"""Repairs: I1 to I11 and the header search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry.base import derived, load, on_planted, planted, register, union_all
from undertow.functions.cells import role_of
from undertow.operators.ingest import best_header, header_score, normalised, repair

TOKENS = "('', '-', 'NA', 'N/A', 'n/a', 'null', 'NULL')"


@register(
    "missing_words",
    on_planted(
        f"""SELECT order_id, CASE WHEN trim(amount_text) NOT IN {TOKENS}
        THEN trim(amount_text) END AS amount FROM planted"""
    ),
)
def missing_words(spark, folder):
    table = planted(spark, folder)
    return normalised(table.select("order_id", F.col("amount_text").alias("amount")))


PADDED = """SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS " order_id ",
CASE WHEN o_orderkey % 9 <> 0 THEN concat('  ', o_orderpriority, ' ') ELSE ' - ' END AS priority,
CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0 THEN o_totalprice END AS price,
' n/a ' AS filler, CAST(NULL AS DOUBLE) AS empty
FROM orders
"""


@register(
    "padding_removed",
    """SELECT o_orderkey AS order_id, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS price FROM orders
    WHERE o_orderkey % 9 <> 0""",
)
def padding_removed(spark, folder):
    """Empty columns and rows go; a row of missing words is an empty row; names are trimmed."""
    sql = PADDED.replace('" order_id "', "` order_id `")
    return repair(derived(spark, folder, sql, "orders")).table


MESSY = """SELECT o_orderkey AS order_id,
CASE WHEN o_orderkey % 17 = 0 THEN ' N/A ' WHEN o_orderkey % 2 = 0
  THEN concat('$', CAST(o_orderkey * 3 AS VARCHAR(20)), '.50 ')
  ELSE concat('(', CAST(o_orderkey AS VARCHAR(20)), ')') END AS amount,
concat(CAST(o_orderkey % 101 AS VARCHAR(20)), '%') AS rate,
CASE WHEN o_orderkey % 2 = 0 THEN '12d' ELSE '7' END AS mixed,
concat(CAST(1 + o_orderkey % 900 AS VARCHAR(20)), ',250') AS thousands,
o_orderpriority AS priority
FROM orders
"""


@register(
    "numbers_from_text",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL
      WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 + 0.5::DOUBLE ELSE -o_orderkey::DOUBLE END
      AS amount, (o_orderkey % 101)::DOUBLE AS rate,
    CASE WHEN o_orderkey % 2 = 0 THEN '12d' ELSE '7' END AS mixed,
    ((1 + o_orderkey % 900) * 1000 + 250)::DOUBLE AS thousands, o_orderpriority AS priority
    FROM orders""",
)
def numbers_from_text(spark, folder):
    """Money, percent and bracketed negatives become numbers; half-numeric text stays text."""
    return repair(derived(spark, folder, MESSY, "orders")).table


DATED = [
    ("iso", "yyyy-MM-dd"), ("american", "MM/dd/yyyy"), ("named", "MMM d, yyyy"),
    ("stamped", "yyyy-MM-dd HH:mm:ss"),
]


@register(
    "dates_from_text",
    "SELECT o_orderkey AS order_id, "
    + ", ".join(f"CAST(o_orderdate AS VARCHAR) AS {n}" for n, _ in DATED[:1])
    + """, CASE WHEN o_orderkey % 40 <> 39 THEN CAST(o_orderdate AS VARCHAR) END AS american,
    CAST(o_orderdate AS VARCHAR) AS named, CAST(o_orderdate AS VARCHAR) AS stamped,
    o_orderpriority AS priority FROM orders""",
)
def dates_from_text(spark, folder):
    orders = load(spark, folder, "orders")
    texts = {name: F.date_format("o_orderdate", layout) for name, layout in DATED}
    late = F.col("o_orderkey") % 40 == 39
    texts["american"] = F.when(late, "unknown").otherwise(texts["american"])
    table = orders.select(
        F.col("o_orderkey").alias("order_id"),
        *[c.alias(n) for n, c in texts.items()],
        F.col("o_orderpriority").alias("priority"),
    )
    fixed = repair(table).table
    return fixed.select(
        *[
            F.col(n).cast("string").alias(n) if n in texts else F.col(n)
            for n in fixed.columns
        ]
    )


@register(
    "repair_log",
    union_all(
        [
            """SELECT 0 AS seq, 'number' AS step, 'amount' AS "column" FROM orders
            HAVING count(*) FILTER (WHERE o_orderkey % 17 <> 0) / count(*) >= 0.6""",
            """SELECT 1 AS seq, 'number' AS step, 'rate' AS "column" FROM orders
            HAVING count(*) >= 5""",
            """SELECT 2 AS seq, 'number' AS step, 'thousands' AS "column" FROM orders
            HAVING count(*) >= 5""",
        ]
    ),
)
def repair_log(spark, folder):
    return repair(derived(spark, folder, MESSY, "orders")).log_frame().drop("detail")


WORD = "unnest(regexp_extract_all(text, '[^ \\n]+'))"
ROLE_CASE = """CASE
WHEN regexp_matches(w, 'final|result|score_final|exam_final') THEN 'outcome'
WHEN regexp_matches(w, 'internal|assign|attend|lab|study|traffic|spend|discount') THEN 'driver'
WHEN regexp_matches(w, 'section|region|product|faculty|category|segment|group') THEN 'segment'
WHEN regexp_matches(w, 'id|name|date|month') THEN 'meta' ELSE 'metric' END"""


@register(
    "roles_of_words",
    f"""SELECT role, count(*) AS words, count(DISTINCT w) AS distinct_words FROM
    (SELECT w, {ROLE_CASE} AS role FROM (SELECT lower({WORD}) AS w FROM
      (SELECT text FROM documents UNION ALL SELECT text FROM benchmark
       UNION ALL SELECT text FROM conversations))) GROUP BY role""",
)
def roles_of_words(spark, folder):
    """Every word of every text, read as if it were a column name."""
    texts = load(spark, folder, "documents").select("text")
    for other in ("benchmark", "conversations"):
        texts = texts.unionByName(load(spark, folder, other).select("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"([^ \n]+)"))).alias("w"))
    counted = words.groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(role_of(F.col("w")).alias("role")).agg(
        F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words")
    )


GRID = """SELECT o_custkey AS file, o_orderkey,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '$1,200' END AS c0,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '  ' END AS c1,
CASE WHEN o_orderkey % 5 < 3 THEN 'Total' ELSE '(12%)' END AS c2,
CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 7 < 4 THEN concat('q', o_orderstatus) END AS c3
FROM orders
"""


def header_sql() -> str:
    def worded(c: str) -> str:
        bare = f"lower(trim(regexp_replace(trim({c}), '[,$€₹]', '', 'g'), '()% '))"
        reads = (
            f"coalesce({bare} NOT IN ('', '-', 'na', 'n/a', 'null', 'none') AND regexp_full_match("
            f"{bare}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?'), false)"
        )
        return f"CASE WHEN length(trim({c})) > 0 AND NOT {reads} THEN 1 ELSE 0 END"

    def filled(c: str) -> str:
        return f"CASE WHEN length(trim({c})) > 0 THEN 1 ELSE 0 END"

    cells = ["c0", "c1", "c2", "c3"]
    strings = " + ".join(worded(c) for c in cells)
    nonnull = " + ".join(filled(c) for c in cells)
    return f"""WITH grid AS ({GRID}),
    counted AS (SELECT *, {strings} AS strings, {nonnull} AS nonnull,
      row_number() OVER (PARTITION BY file ORDER BY o_orderkey) - 1 AS line FROM grid),
    scored AS (SELECT *, strings * 2 + nonnull * 0.5::DOUBLE AS score FROM counted
      WHERE strings >= 2 AND nonnull >= 2)"""


@register(
    "header_scores",
    header_sql() + " SELECT o_orderkey, round(score, 1) AS score FROM scored",
)
def header_scores(spark, folder):
    """Every order read as a line of a file: how much does it look like a header?"""
    grid = derived(spark, folder, GRID, "orders")
    score = header_score(grid, ["c0", "c1", "c2", "c3"])
    scored = grid.select("o_orderkey", F.round(score, 1).alias("score"))
    return scored.where("score IS NOT NULL")


@register(
    "header_lines",
    header_sql()
    + """ SELECT file, CAST(arg_min(line, line - 1000 * score) AS INTEGER) AS header_line
    FROM scored WHERE line < 12 GROUP BY file""",
)
def header_lines(spark, folder):
    """Each customer's orders read as one file: which of the first twelve lines is the header?"""
    order = Window.partitionBy("file").orderBy("o_orderkey")
    grid = derived(spark, folder, GRID, "orders")
    early = grid.withColumn("nth", F.row_number().over(order)).where("nth <= 12")
    early = early.withColumn("line", F.col("nth") - 1)
    return best_header(early, "file", "line", ["c0", "c1", "c2", "c3"]).drop("header")


@register(
    "dates_late_layout",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS VARCHAR) END
    AS ordered, count(*) FILTER (WHERE o_orderkey % 50 = 0) OVER () AS emptied FROM orders""",
)
def dates_late_layout(spark, folder):
    """The layout that most cells follow decides, wherever they stand; the log counts the others."""
    orders = load(spark, folder, "orders")
    other = F.col("o_orderkey") % 50 == 0
    text = F.when(other, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "M/d/yyyy H:m:s")
    )
    table = orders.select(F.col("o_orderkey").alias("order_id"), text.alias("ordered"))
    fixed = repair(table)
    emptied = F.regexp_extract("detail", "([0-9]+) emptied", 1).cast("bigint").alias("emptied")
    lost = fixed.log_frame().where("step = 'date'").select(emptied).first()
    return fixed.table.select(
        "order_id", F.col("ordered").cast("string").alias("ordered"),
        F.lit(lost["emptied"] if lost else 0).cast("bigint").alias("emptied"),
    )
