"""Row scores: A1 to A9."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import load, planted, register, with_planted
from undertow.operators.anomalies import (
    ZSCORE,
    anomaly_summary,
    score_rows,
    top_rows,
)
from undertow.operators.forest import contamination
from undertow.operators.statistics import imputed, measure, standardised


@register(
    "impute_median",
    with_planted(
        "m AS (SELECT quantile_cont(attendance_pct, 0.5) AS median FROM planted)\n"
        "SELECT order_id, round(coalesce(attendance_pct, median), 4) AS filled FROM planted, m"
    ),
)
def impute_median(spark, folder):
    table = planted(spark, folder)
    stats = measure(table, ["attendance_pct"])
    filled = imputed(stats, ["attendance_pct"])[0]
    return table.select("order_id", F.round(filled, 4).alias("filled"))


@register(
    "standardise",
    with_planted(
        """m AS (SELECT quantile_cont(attendance_pct, 0.5) AS median FROM planted),
        f AS (SELECT order_id, coalesce(attendance_pct, median) AS a, delivery_time AS d
              FROM planted, m),
        s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(d) AS md, stddev_pop(d) AS sd FROM f)
        SELECT order_id, round((a - ma) / sa, 5) AS attendance,
               round((d - md) / sd, 5) AS delivery FROM f, s"""
    ),
)
def standardise(spark, folder):
    table = planted(spark, folder)
    names = ["attendance_pct", "delivery_time"]
    attendance, delivery = standardised(measure(table, names), names)
    return table.select(
        "order_id",
        F.round(attendance, 5).alias("attendance"),
        F.round(delivery, 5).alias("delivery"),
    )


EVENT_SCORES = """s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events),
z AS (SELECT event_id, coalesce(abs((value - mu) / sd), 0) AS zmax FROM events, s),
scored AS (SELECT event_id, zmax, least(greatest(zmax / 4, 0), 1) AS score,
           zmax > 3 AS is_anomaly FROM z)
"""


def event_scores(spark, folder):
    events = load(spark, folder, "events").select("event_id", "value")
    return score_rows(events, measure(events, ["value"]), "event_id", ["value"], ZSCORE)


@register(
    "zscore_scores",
    f"WITH {EVENT_SCORES} SELECT event_id, round(zmax, 4) AS zmax, round(score, 4) AS score,"
    " is_anomaly FROM scored",
)
def zscore_scores(spark, folder):
    return event_scores(spark, folder).select(
        "event_id", F.round("anomaly_zmax", 4).alias("zmax"), F.round("anomaly_score", 4).alias("score"),
        "is_anomaly",
    )


@register(
    "zscore_many_columns",
    with_planted(
        """s AS (SELECT avg(spend_plan) AS m1, stddev_samp(spend_plan) AS s1,
                 avg(attendance_pct) AS m2, stddev_samp(attendance_pct) AS s2,
                 avg(line_total) AS m3, stddev_samp(line_total) AS s3 FROM planted),
        z AS (SELECT order_id, greatest(coalesce(abs((spend_plan - m1) / s1), 0),
              coalesce(abs((attendance_pct - m2) / s2), 0),
              coalesce(abs((line_total - m3) / s3), 0)) AS zmax FROM planted, s)
        SELECT order_id, round(zmax, 4) AS zmax, zmax > 3 AS is_anomaly FROM z"""
    ),
)
def zscore_many_columns(spark, folder):
    table = planted(spark, folder)
    names = ["spend_plan", "attendance_pct", "line_total"]
    scored = score_rows(table, measure(table, names), "order_id", names, ZSCORE)
    return scored.select("order_id", F.round("anomaly_zmax", 4).alias("zmax"), "is_anomaly")


# No label lies three deviations out, so the few highest scores are flagged instead.
@register(
    "anomaly_rescue",
    """WITH s AS (SELECT avg(quality) AS m1, stddev_samp(quality) AS s1, avg(toxic) AS m2,
         stddev_samp(toxic) AS s2, count(*) AS n FROM labels),
    z AS (SELECT doc_id, n, greatest(abs((quality - m1) / s1), abs((toxic - m2) / s2)) AS zmax
          FROM labels, s),
    scored AS (SELECT doc_id, n, zmax, least(zmax / 4, 1) AS score FROM z),
    placed AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place,
               max(score) OVER () AS best, sum(CASE WHEN zmax > 3 THEN 1 ELSE 0 END) OVER () AS hits
               FROM scored)
    SELECT doc_id, round(score, 4) AS score,
      CASE WHEN hits = 0 AND best > 0.55 THEN place <= greatest(1, least(5, n // 20))
           ELSE zmax > 3 END AS is_anomaly FROM placed""",
)
def anomaly_rescue(spark, folder):
    labels = load(spark, folder, "labels")
    names = ["quality", "toxic"]
    scored = score_rows(labels, measure(labels, names), "doc_id", names, ZSCORE)
    return scored.select("doc_id", F.round("anomaly_score", 4).alias("score"), "is_anomaly")


@register(
    "anomaly_top_rows",
    f"""WITH {EVENT_SCORES} SELECT s.event_id, round(score, 3) AS score, round(zmax, 2) AS zmax,
    is_anomaly, value FROM (SELECT * FROM scored ORDER BY round(score, 9) DESC, event_id LIMIT 25) s
    JOIN events e ON e.event_id = s.event_id WHERE score >= 0.45 OR is_anomaly""",
)
def anomaly_top_rows(spark, folder):
    top = top_rows(event_scores(spark, folder), "event_id")
    return top.withColumnsRenamed({"anomaly_score": "score", "anomaly_zmax": "zmax"})


@register(
    "anomaly_summary",
    f"""WITH {EVENT_SCORES} SELECT '{ZSCORE}' AS method,
    count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
    round(count(*) FILTER (WHERE is_anomaly) / greatest(count(*), 1) * 100, 1) AS anomaly_pct
    FROM scored""",
)
def summary(spark, folder):
    return anomaly_summary(event_scores(spark, folder), ZSCORE)


@register("isolation_forest")
def isolation_forest(spark, folder):
    """Seeded random trees: nothing SQL could repeat, so only the shape is checked here."""
    table = planted(spark, folder)
    names = ["spend_plan", "final_result", "attendance_pct", "delivery_time", "line_total"]
    scored = score_rows(table, measure(table, names), "order_id", names)
    return scored.select(
        "order_id", F.round("anomaly_score", 3).alias("score"), F.round("anomaly_zmax", 2).alias("zmax"),
        "is_anomaly",
    )


@register("isolation_forest_summary")
def isolation_forest_summary(spark, folder):
    events = load(spark, folder, "events").select("event_id", "user_id", "value")
    names = ["user_id", "value"]
    scored = score_rows(events, measure(events, names), "event_id", names)
    return anomaly_summary(scored, "isolation-forest")


@register(
    "isolation_forest_checks",
    """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differences, true AS share_as_asked,
    true AS outliers_high FROM orders""",
)
def isolation_forest_checks(spark, folder):
    """Whatever the trees: two runs agree, the asked share is flagged, planted outliers score high."""
    table = planted(spark, folder)
    names = ["spend_plan", "final_result", "attendance_pct", "delivery_time", "line_total"]
    stats = measure(table, names)
    runs = [
        score_rows(table, stats, "order_id", names).select(
            "order_id", F.round("anomaly_score", 9).alias(f"score{run}"), F.col("is_anomaly").alias(f"flag{run}")
        )
        for run in (0, 1)
    ]
    both = runs[0].join(runs[1], "order_id")
    spread = stats["line_total"]
    outlier = F.abs(F.col("line_total") - F.lit(spread.mean)) > 4 * spread.std
    both = both.join(table.select("order_id", outlier.alias("outlier")), "order_id")
    counted = both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((F.col("score0") != F.col("score1")) | (F.col("flag0") != F.col("flag1"))).alias("differences"),
        (F.abs(F.count_if("flag0") - F.lit(contamination(stats.rows)) * F.count(F.lit(1))) <= 2).alias("share_as_asked"),
        F.percentile("score0", 0.9).alias("high"),
        F.min(F.when(F.col("outlier"), F.col("score0"))).alias("least"),
    )
    return counted.select(
        "n_rows", "differences", "share_as_asked",
        (F.col("least").isNull() | (F.col("least") >= F.col("high"))).alias("outliers_high"),
    )
