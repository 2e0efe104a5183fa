"""Findings, scores, drill-down, chart data and outputs: U1, U2, N1 to N9, V1, V2, H1 to H7, O1 to O4."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (
    COLUMNS,
    NUMBERS,
    load,
    on_planted,
    planted,
    register,
    union_all,
    with_planted,
)
from registry.patterns import COUNTS, GAPS, JUDGED, TOP, fixed_profile
from registry.profile import KEY_SQL
from undertow.functions.cells import confidence, mean_or_zero, number_from_text, percent_change
from undertow.operators import compare, contradictions, formulas, segments
from undertow.operators.anomalies import ZSCORE, score_rows
from undertow.operators.profile import missing_columns
from undertow.operators.statistics import measure
from undertow.plans import charts, investigate, report
from undertow.plans.audit import audit
from undertow.plans.findings import ranked
from undertow.session import new_path

# --- numbers --------------------------------------------------------------------------------


@register(
    "percent_change",
    """WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey),
    o AS (SELECT avg(o_totalprice) AS overall FROM orders)
    SELECT o_custkey, coalesce(round((mean - overall) / nullif(abs(overall), 0) * 100, 1), 0)
      AS diff_pct, coalesce(round((mean - c_acctbal) / nullif(abs(c_acctbal), 0) * 100, 1), 0)
      AS balance_pct
    FROM m, o JOIN customer ON o_custkey = c_custkey""",
)
def percent_changes(spark, folder):
    orders = load(spark, folder, "orders")
    overall = measure(orders, ["o_totalprice"], quartiles=False)["o_totalprice"].mean
    means = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    customers = load(spark, folder, "customer")
    return means.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_custkey",
        percent_change(F.col("mean"), F.lit(overall)).alias("diff_pct"),
        percent_change(F.col("mean"), F.col("c_acctbal")).alias("balance_pct"),
    )


@register(
    "mean_of_readable_numbers",
    on_planted(
        """SELECT segment_priority, round(coalesce(avg(TRY_CAST(replace(replace(trim(amount_text),
        '$', ''), ',', '') AS DOUBLE)), 0), 4) AS mean_amount,
        round(coalesce(avg(TRY_CAST(status AS DOUBLE)), 0), 4) AS mean_status
        FROM planted GROUP BY segment_priority"""
    ),
)
def mean_of_readable_numbers(spark, folder):
    return planted(spark, folder).groupBy("segment_priority").agg(
        F.round(mean_or_zero(number_from_text(F.col("amount_text"))), 4).alias("mean_amount"),
        F.round(mean_or_zero(F.col("status")), 4).alias("mean_status"),
    )


@register(
    "confidence",
    """WITH m AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders
      GROUP BY o_custkey), o AS (SELECT avg(o_totalprice) AS overall FROM orders),
    e AS (SELECT o_custkey, n, round((mean - overall) / overall * 100, 1) AS effect FROM m, o)
    SELECT o_custkey, n, effect, CAST(floor(least(94, greatest(55, 70 + least(12, n)
      + least(10, abs(effect) / 3)))) AS INTEGER) AS confidence FROM e""",
)
def confidences(spark, folder):
    orders = load(spark, folder, "orders")
    overall = measure(orders, ["o_totalprice"], quartiles=False)["o_totalprice"].mean
    grouped = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        percent_change(F.avg("o_totalprice"), F.lit(overall)).alias("effect"),
    )
    return grouped.withColumn("confidence", confidence(F.col("n"), F.col("effect")))


# --- group against rest ---------------------------------------------------------------------

HIGH = "q AS (SELECT quantile_cont(spend_plan, 0.75) AS hi, quantile_cont(final_result, 0.25) AS lo FROM planted),\ng AS (SELECT planted.*, coalesce(spend_plan >= hi AND final_result <= lo, false) AS inside FROM planted, q)"


def compared_sql(names: list[str]) -> str:
    return union_all(
        [
            f"""SELECT {i} AS ordinal, '{n}' AS variable,
            count(*) FILTER (WHERE inside) AS group_size,
            coalesce(avg({n}) FILTER (WHERE inside), 0) AS group_mean,
            coalesce(avg({n}) FILTER (WHERE NOT inside), 0) AS rest_mean FROM g"""
            for i, n in enumerate(names)
        ]
    )


DIFF = "coalesce(round((group_mean - rest_mean) / nullif(abs(rest_mean), 0) * 100, 1), 0)"


def high_group(spark, folder):
    table = planted(spark, folder)
    stats = measure(table)
    rule = contradictions.predicate(stats, "spend_plan", "final_result", "high")
    return table, stats, {"high": rule}, {"high": ("spend_plan", "final_result")}


@register(
    "contradiction_evidence",
    with_planted(
        f"""{HIGH}, c AS ({compared_sql(NUMBERS)}), d AS (SELECT *, {DIFF} AS diff_pct,
        row_number() OVER (ORDER BY coalesce(list_position(['spend_plan', 'final_result'],
        variable), 99), ordinal) - 1 AS place FROM c)
        SELECT place, variable, round(group_mean, 4) AS group_mean, round(rest_mean, 4)
        AS rest_mean, diff_pct FROM d WHERE place < 5"""
    ),
)
def contradiction_evidence(spark, folder):
    """Which records break the spend and result pattern, and how they differ from the rest."""
    table, stats, groups, pairs = high_group(spark, folder)
    compared = compare.compare_groups(table, groups, stats.numeric)
    return compare.evidence(compared, pairs).select(
        "place",
        "variable",
        F.round("group_mean", 4).alias("group_mean"),
        F.round("rest_mean", 4).alias("rest_mean"),
        "diff_pct",
    )


@register(
    "contributing_factor",
    with_planted(
        f"""{HIGH}, c AS ({compared_sql(NUMBERS)}), d AS (SELECT *, abs({DIFF}) AS diff_pct FROM c)
        SELECT variable, round(diff_pct, 1) AS diff_pct FROM d
        WHERE variable NOT IN ('spend_plan', 'final_result') AND diff_pct >= 1
        ORDER BY diff_pct DESC, ordinal LIMIT 1"""
    ),
)
def contributing_factor(spark, folder):
    table, stats, groups, pairs = high_group(spark, folder)
    compared = compare.compare_groups(table, groups, stats.numeric)
    return compare.contributing_factor(compared, pairs, least_pct=1.0).drop("group")


VERDICT = f"""SELECT variable, round(group_mean, 2) AS group_mean, round(rest_mean, 2) AS rest_mean,
{DIFF} AS diff_pct, CASE WHEN abs({DIFF}) >= 15 THEN 'significant' WHEN abs({DIFF}) >= 7
THEN 'moderate' ELSE 'no significant difference' END AS verdict FROM c"""


@register(
    "investigate_contradiction", with_planted(f"{HIGH}, c AS ({compared_sql(NUMBERS)}) {VERDICT}")
)
def investigate_contradiction(spark, folder):
    table, stats, groups, _ = high_group(spark, folder)
    return investigate.investigate(table, groups["high"], stats.numeric).rows


@register(
    "investigate_segment",
    with_planted(
        f"g AS (SELECT *, segment_priority = '5-LOW' AS inside FROM planted),"
        f" c AS ({compared_sql(JUDGED)}) {VERDICT}"
    ),
)
def investigate_segment(spark, folder):
    table = planted(spark, folder)
    return investigate.investigate(table, "segment_priority = '5-LOW'", JUDGED).rows


@register(
    "investigate_falls_back_to_anomalies",
    with_planted(
        """s AS (SELECT avg(line_total) AS m, stddev_samp(line_total) AS sd FROM planted),
        g AS (SELECT planted.*, abs((line_total - m) / sd) > 3 AS inside FROM planted, s),
        c AS ("""
        + compared_sql(JUDGED)
        + f") {VERDICT}"
    ),
)
def investigate_falls_back(spark, folder):
    """No order costs less than nothing, so the flagged rows are compared instead."""
    table = planted(spark, folder)
    stats = measure(table, ["line_total"])
    scored = score_rows(table, stats, "order_id", ["line_total"], ZSCORE)
    return investigate.investigate(scored, "line_total < 0", JUDGED).rows


# --- findings of the planted table ----------------------------------------------------------

ZED = "greatest(" + ", ".join(f"coalesce(abs(({n} - m{i}) / s{i}), 0)" for i, n in enumerate(NUMBERS)) + ")"
MOMENTS = ", ".join(f"avg({n}) AS m{i}, stddev_samp({n}) AS s{i}" for i, n in enumerate(NUMBERS))
# Mean of a contradiction's second column inside its group and overall, by direction.
GROUP_B = f"""group_b AS (SELECT t.*, CASE WHEN direction = 'high' THEN
    (SELECT avg(final_result) FROM planted, q WHERE spend_plan >= spend_plan_hi
     AND final_result <= final_result_lo)
  ELSE (SELECT avg(final_result) FROM planted, q WHERE spend_plan <= spend_plan_lo
     AND final_result >= final_result_hi) END AS in_group,
  (SELECT avg(final_result) FROM planted) AS overall_b FROM top t),
effects AS (SELECT *, round((in_group - overall_b) / abs(overall_b) * 100, 1) AS effect
  FROM group_b)"""
FORMULA = """rule AS (SELECT count(*) AS valid, count(*) FILTER (WHERE NOT
  (abs(line_total - units * unit_value) / greatest(abs(line_total), 1) <= 0.02
   OR abs(line_total - units * unit_value) <= 0.05)) AS broken FROM planted)"""
FOUND = f"""{COUNTS},\n{TOP},\n{GROUP_B},\n{GAPS},
{FORMULA},
best_gaps AS (SELECT * FROM gaps ORDER BY spread_pct DESC, cat_ordinal, num_ordinal LIMIT 4),
n_rows AS (SELECT count(*) AS total FROM planted),
moments AS (SELECT {MOMENTS} FROM planted),
unusual AS (SELECT count(*) FILTER (WHERE {ZED} > 3) AS flagged FROM planted, moments),
first_two AS (
  SELECT 'contradiction' AS kind, CASE WHEN pct >= 5 AND abs(effect) >= 20 THEN 'critical'
    ELSE 'moderate' END AS severity, matches, pct, CAST(floor(least(94, greatest(55, 70
    + least(12, matches) + least(10, abs(effect) / 3)))) AS INTEGER) AS confidence,
    concat(col_a, ',', col_b) AS about,
    row_number() OVER (ORDER BY matches DESC, pair) AS seq FROM effects
  UNION ALL
  SELECT 'segment', CASE WHEN spread_pct >= 25 THEN 'critical' ELSE 'moderate' END, worst_size,
    round(worst_size / total * 100, 1), CAST(floor(least(94, greatest(55, 80
    + least(10, abs(spread_pct) / 3)))) AS INTEGER), concat(category, ',', number),
    10 + row_number() OVER (ORDER BY spread_pct DESC, cat_ordinal, num_ordinal)
    FROM best_gaps, n_rows),
found AS (SELECT * FROM first_two
  UNION ALL
  SELECT 'outliers', 'moderate', flagged, round(flagged / total * 100, 1), 78,
    '{",".join(NUMBERS[:4])}', 20 FROM unusual, n_rows
    WHERE flagged >= 3 AND (SELECT count(*) FROM first_two) < 6
  UNION ALL
  SELECT 'missing', 'info', count(*) - count(attendance_pct),
    round((count(*) - count(attendance_pct)) / count(*) * 100, 1), 99, 'attendance_pct', 30
    FROM planted HAVING (count(*) - count(attendance_pct)) / count(*) * 100 >= 5
  UNION ALL
  SELECT 'quality', 'info', bad, round(bad / total * 100, 1), 95, 'attendance_pct', 40 FROM
    (SELECT count(*) FILTER (WHERE attendance_pct < 0 OR attendance_pct > 100) AS bad
     FROM planted), n_rows WHERE bad > 0
  UNION ALL
  SELECT 'quality', 'info', bad, round(bad / total * 100, 1), 95, 'line_total', 41 FROM
    (SELECT count(*) FILTER (WHERE abs((line_total - m7) / s7) > 4) AS bad FROM planted, moments),
    n_rows WHERE bad > 0
  UNION ALL
  SELECT 'formula', 'critical', broken, round(broken / total * 100, 1), 93,
    'units,unit_value,line_total', 50 FROM rule, n_rows WHERE broken > 0
  UNION ALL
  SELECT 'duplicates', 'moderate', repeated_rows, pct, 97, "column", 60 + ordinal
    FROM ({KEY_SQL})),
placed AS (SELECT *, row_number() OVER (ORDER BY seq) AS nth FROM found)"""


def planted_audit(spark, folder):
    return audit(
        planted(spark, folder), "order_id", "planted", method=ZSCORE, with_clusters=False,
        repaired=True,
    )


@register(
    "findings",
    with_planted(
        f"""{FOUND}
        SELECT concat('F', CAST(nth AS VARCHAR)) AS id, kind, severity, matches, pct, confidence,
        about, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0
        WHEN 'moderate' THEN 1 ELSE 2 END, confidence DESC, nth) AS place FROM placed"""
    ),
)
def findings(spark, folder):
    found = planted_audit(spark, folder).findings
    order = [r["ordinal"] for r in ranked(found).select("ordinal").collect()]
    places = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("ordinal"))
    return found.select(
        "id", "kind", "severity", "matches", "pct", "confidence",
        F.array_join("columns", ",").alias("about"),
        places.alias("place"),
    )


SCORED = f"""{FOUND},
tally AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'moderate') AS moderate,
  count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total_findings,
  CAST(coalesce(round_even(avg(confidence), 0), 60) AS INTEGER) AS insight_confidence,
  coalesce(sum(pct) FILTER (WHERE kind = 'missing'), 0) AS gap_pct,
  count(*) FILTER (WHERE kind = 'quality') AS issues FROM found),
share AS (SELECT round(flagged / total * 100, 1) AS unusual_pct FROM unusual, n_rows)"""


@register(
    "table_scores",
    with_planted(
        f"""{SCORED}
        SELECT critical, moderate, info, total_findings AS total,
        CAST(floor(greatest(35, 100 - least(30, gap_pct / 2 + 3 * issues) - least(25, unusual_pct)
          - 2 * issues)) AS INTEGER) AS data_health, insight_confidence,
        CASE WHEN critical >= 2 OR (unusual_pct > 12 AND critical >= 1) THEN 'HIGH'
          WHEN critical >= 1 OR moderate >= 2 OR unusual_pct > 12 THEN 'MEDIUM'
          ELSE 'LOW' END AS hidden_risk FROM tally, share"""
    ),
)
def table_scores(spark, folder):
    return planted_audit(spark, folder).scores


@register(
    "audit_overview",
    with_planted(
        f"""{FOUND}
        SELECT kind, count(*) AS findings, CAST(max(matches) AS BIGINT) AS largest,
        (SELECT total FROM n_rows) AS "rows", {len(COLUMNS)} AS "columns",
        {len(NUMBERS)} AS numbers, 2 AS categories FROM found GROUP BY kind"""
    ),
)
def audit_overview(spark, folder):
    done = planted_audit(spark, folder)
    return done.findings.groupBy("kind").agg(
        F.count(F.lit(1)).alias("findings"),
        F.max("matches").alias("largest"),
        F.lit(done.stats.rows).cast("bigint").alias("rows"),
        F.lit(len(done.columns)).alias("columns"),
        F.lit(len(done.numbers)).alias("numbers"),
        F.lit(len(done.categories)).alias("categories"),
    )


@register("audit_with_forest_and_clusters")
def audit_with_forest_and_clusters(spark, folder):
    """The full audit with its seeded parts: only the shape is checked here."""
    done = audit(planted(spark, folder), "order_id", "planted", repaired=True)
    return done.findings.select("id", "kind", "severity", "title", "matches", "pct", "confidence")


# --- chart data -----------------------------------------------------------------------------


@register(
    "chart_scatter",
    with_planted(
        f"""{HIGH}, f AS (SELECT * FROM g ORDER BY order_id LIMIT 600)
        SELECT order_id AS row_id, spend_plan AS x, round(final_result, 4) AS y, inside AS flagged
        FROM f WHERE spend_plan IS NOT NULL AND final_result IS NOT NULL"""
    ),
)
def chart_scatter(spark, folder):
    table, _, groups, pairs = high_group(spark, folder)
    points = charts.scatter_points(table, *pairs["high"], groups["high"], "order_id")
    return points.withColumn("y", F.round("y", 4))


@register(
    "chart_scatter_sample",
    with_planted(
        f"""{HIGH} SELECT order_id AS row_id, spend_plan AS x, round(final_result, 4) AS y, inside AS flagged
        FROM g WHERE spend_plan IS NOT NULL AND final_result IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY inside ORDER BY md5(order_id::VARCHAR), order_id) <= 300"""
    ),
)
def chart_scatter_sample(spark, folder):
    table, _, groups, pairs = high_group(spark, folder)
    points = charts.scatter_sample(table, *pairs["high"], groups["high"], "order_id")
    return points.withColumn("y", F.round("y", 4))


@register(
    "chart_segment_bars",
    on_planted(
        """SELECT 'segment_priority' AS category, 'delivery_time' AS number,
        segment_priority AS label, round(avg(delivery_time), 2) AS value,
        (SELECT round(avg(delivery_time), 2) FROM planted) AS overall,
        rank() OVER (ORDER BY avg(delivery_time) DESC) = 1 AS highlighted
        FROM planted GROUP BY segment_priority"""
    ),
)
def chart_segment_bars(spark, folder):
    table = planted(spark, folder)
    stats = measure(table, ["delivery_time"], quartiles=False)
    means = segments.group_means(table, ["delivery_time"], ["segment_priority"])
    return charts.segment_bars(segments.segment_gaps(means, stats))


@register(
    "chart_formula_pairs",
    on_planted(
        """SELECT * FROM (SELECT row_number() OVER (ORDER BY order_id) AS place,
        left(concat('segment_priority=', segment_priority), 18) AS label,
        round(line_total, 2) AS recorded, round(units * unit_value, 2) AS expected FROM planted
        WHERE NOT (abs(line_total - units * unit_value) / greatest(abs(line_total), 1) <= 0.02
        OR abs(line_total - units * unit_value) <= 0.05)) WHERE place <= 5"""
    ),
)
def chart_formula_pairs(spark, folder):
    names = ["units", "unit_value", "line_total"]
    table = planted(spark, folder)
    rule = [r for r in formulas.candidates(names) if r.text == "line_total ≈ units × unit_value"]
    broken = formulas.violating_rows(table, rule, names, "order_id")
    return charts.formula_pairs(formulas.violation_examples(broken)).drop("rule_no")


@register(
    "chart_cluster_bars",
    on_planted(
        union_all(
            [
                f"""SELECT {i} AS ordinal, '{m}' AS variable,
                round(avg({m}) FILTER (WHERE order_id % 3 = 1), 2) AS cluster_mean,
                round(avg({m}), 1) AS overall_mean FROM planted"""
                for i, m in enumerate(["final_result", "attendance_pct", "delivery_time", "line_total"])
            ]
        )
    ),
)
def chart_cluster_bars(spark, folder):
    return charts.cluster_bars(*fixed_profile(spark, folder), cluster=1)


@register(
    "chart_missing_bars",
    on_planted(
        """SELECT 'attendance_pct' AS label,
        round((count(*) - count(attendance_pct)) / count(*) * 100, 1) AS value FROM planted"""
    ),
)
def chart_missing_bars(spark, folder):
    return charts.missing_bars(missing_columns(planted(spark, folder)))


@register(
    "chart_histogram",
    with_planted(
        """e AS (SELECT count(line_total) AS n, min(line_total) AS lo, max(line_total) AS hi
          FROM planted),
        b AS (SELECT *, CAST(least(20, greatest(8, n // 10)) AS INTEGER) AS bins FROM e),
        c AS (SELECT least(CAST(floor((line_total - lo) / (hi - lo) * bins) AS INTEGER), bins - 1)
          AS bin, count(*) AS n_rows FROM planted, b WHERE line_total IS NOT NULL GROUP BY ALL)
        SELECT CAST(r.bin AS INTEGER) AS bin,
          round(lo + (r.bin + 0.5::DOUBLE) * ((hi - lo) / bins), 1) AS label,
          coalesce(n_rows, 0) AS "rows"
        FROM b, range(20) r(bin) LEFT JOIN c ON c.bin = r.bin WHERE r.bin < bins"""
    ),
)
def chart_histogram(spark, folder):
    table = planted(spark, folder)
    return charts.histogram(table, "line_total", measure(table, ["line_total"], quartiles=False))


@register(
    "chart_trend",
    """SELECT CAST(date_trunc('month', o_orderdate)::TIMESTAMP AS VARCHAR) AS label,
    round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24""",
)
def chart_trend(spark, folder):
    return charts.trend(load(spark, folder, "orders"), "o_orderdate", "o_totalprice", "month")


@register(
    "chart_trend_month_names",
    """SELECT monthname(o_orderdate) AS label, round(avg(o_totalprice), 2) AS value FROM orders
    GROUP BY 1""",
)
def chart_trend_month_names(spark, folder):
    named = load(spark, folder, "orders").select(
        F.date_format("o_orderdate", "MMMM").alias("month"), "o_totalprice"
    )
    return charts.trend(named, "month", "o_totalprice")


# --- outputs --------------------------------------------------------------------------------


@register(
    "report_blocks",
    with_planted(f"{FOUND}\nSELECT 'planted' AS dataset, count(*) AS blocks FROM found"),
)
def report_blocks(spark, folder):
    """Written as text by dataset and read back: one heading line per finding."""
    done = planted_audit(spark, folder)
    path = new_path(spark, "report")
    report.write_blocks(report.finding_blocks(done.findings, "planted"), path)
    lines = spark.read.text(path)
    return lines.where("value LIKE '### [%'").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("blocks")
    )


@register(
    "json_output",
    on_planted(
        """SELECT order_id, CASE WHEN order_id % 7 <> 0 THEN round(attendance_pct, 2) END AS rate,
        strftime(order_date, '%Y-%m-%dT%H:%M:%S') AS order_day FROM planted"""
    ),
)
def json_output(spark, folder):
    """NaN becomes a missing value, times become ISO text; the file is read back."""
    table = planted(spark, folder).select(
        "order_id",
        F.expr("CASE WHEN order_id % 7 = 0 THEN double('NaN') ELSE round(attendance_pct, 2) END")
        .alias("rate"),
        F.col("order_date").alias("order_day"),
    )
    path = new_path(spark, "json")
    report.write_json(table, path)
    back = spark.read.schema("order_id bigint, rate double, order_day string").json(path)
    return back.withColumn("order_day", F.substring("order_day", 1, 19))


PREVIEWED = ["order_id", "segment_priority", "status", "ref_code", "amount_text", "order_date"]


@register(
    "preview",
    on_planted(
        "SELECT "
        + ", ".join(
            f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in PREVIEWED
        )
        + " FROM (SELECT * FROM planted ORDER BY order_id LIMIT 8)"
    ),
)
def preview(spark, folder):
    return report.preview(planted(spark, folder).select(*PREVIEWED), "order_id")
