"""Pattern detectors: C1 to C3, G1 to G3, Q1 to Q6, K1 to K3, F1 to F3."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from registry.base import (
    NUMBERS,
    load,
    on_planted,
    planted,
    register,
    union_all,
    with_planted,
)
from undertow.operators import contradictions as c
from undertow.operators import formulas, quality, segments
from undertow.operators.clusters import cluster_profile, fit_clusters, hidden_subgroup
from undertow.operators.frequencies import categorical_columns
from undertow.operators.statistics import measure
from undertow.session import small_frame

# --- contradictions -------------------------------------------------------------------------

CORR = ",\n".join(
    f"corr({a}, {b}) AS r_{i}" for i, (a, b) in enumerate(combinations(NUMBERS, 2))
)
CORRELATIONS = f"r AS (SELECT {CORR} FROM planted),\npairs AS (" + union_all(
    [
        f"SELECT {i} AS pair, '{a}' AS col_a, '{b}' AS col_b, r_{i} AS r FROM r"
        for i, (a, b) in enumerate(combinations(NUMBERS, 2))
    ]
) + ")"


@register(
    "correlations",
    with_planted(f"{CORRELATIONS}\nSELECT pair, col_a, col_b, round(r, 6) AS r FROM pairs"),
)
def correlations(spark, folder):
    table = planted(spark, folder)
    found = c.correlations(table, measure(table, quartiles=False))
    return found.withColumn("r", F.round("r", 6))


PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "correlations_without_gaps",
    union_all(
        [
            f"SELECT {i} AS pair, '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r"
            " FROM lineitem"
            for i, (a, b) in enumerate(combinations(PRICES, 2))
        ]
    ),
)
def correlations_without_gaps(spark, folder):
    table = load(spark, folder, "lineitem").select(*PRICES)
    found = c.correlations(table, measure(table, quartiles=False))
    return found.withColumn("r", F.round("r", 6))


QUARTILES = "q AS (SELECT count(*) AS n, " + ", ".join(
    f"quantile_cont({x}, {p}) AS {x}_{s}" for x in NUMBERS for p, s in ((0.25, "lo"), (0.75, "hi"))
) + " FROM planted)"
MASKS = "masks AS (SELECT n, " + ", ".join(
    f"""count(*) FILTER (WHERE {a} >= {a}_hi AND {b} <= {b}_lo) AS high_{i},
    count(*) FILTER (WHERE {a} <= {a}_lo AND {b} >= {b}_hi) AS low_{i}"""
    for i, (a, b) in enumerate(combinations(NUMBERS, 2))
) + " FROM planted, q GROUP BY n)"
COUNTS = (
    f"{CORRELATIONS},\n{QUARTILES},\n{MASKS},\nmatched AS ("
    + union_all(
        [
            f"SELECT {i} AS pair, '{d}' AS direction, {d}_{i} AS matches, n FROM masks"
            for i in range(len(list(combinations(NUMBERS, 2))))
            for d in ("high", "low")
        ]
    )
    + """),
counts AS (SELECT p.pair, col_a, col_b, r, direction, matches,
  round(matches / n * 100, 1) AS pct
  FROM pairs p JOIN matched m ON p.pair = m.pair
  WHERE r >= 0.35 AND NOT isnan(r) AND matches >= greatest(3, CAST(floor(0.03 * n) AS BIGINT)))"""
)
TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair
  ORDER BY matches DESC, direction) AS place FROM counts) WHERE place = 1
  ORDER BY matches DESC, pair LIMIT 4)"""


@register(
    "contradiction_counts",
    with_planted(
        f"""{COUNTS}
        SELECT pair, col_a, col_b, round(r, 6) AS r, direction, matches, pct FROM counts"""
    ),
)
def contradiction_counts(spark, folder):
    table = planted(spark, folder)
    found = c.contradiction_counts(table, measure(table))
    return found.withColumn("r", F.round("r", 6))


@register(
    "contradictions",
    with_planted(
        f"""{COUNTS},\n{TOP}
        SELECT pair, col_a, col_b, round(r, 6) AS r, direction, matches, pct FROM top"""
    ),
)
def contradictions(spark, folder):
    table = planted(spark, folder)
    found = c.top_contradictions(c.contradiction_counts(table, measure(table)))
    return found.withColumn("r", F.round("r", 6))


# --- segments -------------------------------------------------------------------------------

CATEGORIES = ["segment_priority", "status"]
JUDGED = [
    "final_result", "attendance_pct", "delivery_time", "units", "unit_value", "line_total", "ref_code",
]
MEANS = "means AS (" + union_all(
    [
        f"""SELECT '{cat}' AS category, {i} AS cat_ordinal, {cat} AS grp, count(*) AS size,
        '{num}' AS number, {j} AS num_ordinal, avg({num}) AS mean,
        count(*) OVER () AS grps, min(count(*)) OVER () AS smallest
        FROM planted WHERE {cat} IS NOT NULL GROUP BY {cat}"""
        for i, cat in enumerate(CATEGORIES)
        for j, num in enumerate(JUDGED)
    ]
) + "),\nusable AS (SELECT * FROM means WHERE grps BETWEEN 2 AND 8 AND smallest >= 3)"
OVERALL = "overall AS (" + union_all(
    [f"SELECT '{num}' AS number, avg({num}) AS overall FROM planted" for num in JUDGED]
) + ")"
GAPS = f"""{MEANS},\n{OVERALL},
badness AS (SELECT u.*, overall, CASE WHEN u.number = 'delivery_time' THEN -mean ELSE mean END AS bad
  FROM usable u JOIN overall o ON u.number = o.number),
spreads AS (SELECT category, number, cat_ordinal, num_ordinal, overall,
  (max(mean) - min(mean)) / abs(overall) AS spread FROM badness
  GROUP BY category, number, cat_ordinal, num_ordinal, overall),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, number
  ORDER BY bad, grp) AS place FROM badness) WHERE place = 1),
gaps AS (SELECT s.category, s.number, s.cat_ordinal, s.num_ordinal,
  round(spread * 100, 1) AS spread_pct, round(s.overall, 2) AS overall, w.grp AS worst,
  round(w.mean, 2) AS worst_mean, w.size AS worst_size
  FROM spreads s JOIN worst w ON s.category = w.category AND s.number = w.number
  WHERE spread > 0.12)"""


def planted_means(spark, folder):
    table = planted(spark, folder)
    stats = measure(table, quartiles=False)
    means = segments.group_means(
        table, segments.judged_columns(stats), categorical_columns(table)
    )
    return means, stats


@register(
    "segment_means",
    with_planted(
        f"""{MEANS}
        SELECT category, cat_ordinal, grp, size, number, num_ordinal, round(mean, 4) AS mean
        FROM usable"""
    ),
)
def segment_means(spark, folder):
    means, _ = planted_means(spark, folder)
    return means.withColumn("mean", F.round("mean", 4))


@register("segment_gaps", with_planted(f"{GAPS} SELECT * FROM gaps"))
def segment_gaps(spark, folder):
    return segments.segment_gaps(*planted_means(spark, folder)).drop("groups")


@register(
    "segment_top",
    with_planted(
        f"{GAPS} SELECT * FROM gaps ORDER BY spread_pct DESC, cat_ordinal, num_ordinal LIMIT 4"
    ),
)
def segment_top(spark, folder):
    return segments.top_segments(segments.segment_gaps(*planted_means(spark, folder))).drop(
        "groups"
    )


@register(
    "segment_gaps_conversations",
    """WITH g AS (SELECT role AS grp, count(*) AS size, avg(turn) AS mean FROM conversations
      GROUP BY role),
    o AS (SELECT avg(turn) AS overall FROM conversations)
    SELECT 'role' AS category, 'turn' AS number, round((max(mean) - min(mean)) / overall * 100, 1)
      AS spread_pct, round(overall, 2) AS overall, arg_min(grp, mean) AS worst,
      round(min(mean), 2) AS worst_mean, arg_min(size, mean) AS worst_size
    FROM g, o GROUP BY overall
    HAVING (max(mean) - min(mean)) / overall > 0.12 AND count(*) BETWEEN 2 AND 8
      AND min(size) >= 3""",
)
def segment_gaps_conversations(spark, folder):
    table = load(spark, folder, "conversations").select("role", "turn")
    stats = measure(table, ["turn"], quartiles=False)
    means = segments.group_means(table, ["turn"], ["role"])
    return segments.segment_gaps(means, stats).drop("groups", "cat_ordinal", "num_ordinal")


# --- entry errors ---------------------------------------------------------------------------

RANGES = """SELECT order_id, attendance_pct,
CASE WHEN attendance_pct IS NULL THEN NULL
     ELSE 1 + attendance_pct / CAST(25 AS DOUBLE) END AS star_rating,
attendance_pct + 40 AS customer_age, line_total
FROM planted
"""
RANGED = f"r AS ({RANGES})"


def ranged_table(spark, folder):
    table = planted(spark, folder)
    return spark.sql(RANGES.replace("FROM planted", "FROM {planted}"), planted=table)


@register(
    "quality_rule_counts",
    with_planted(
        f"""{RANGED},
        s AS (SELECT avg(order_id) AS m0, stddev_samp(order_id) AS s0, avg(attendance_pct) AS m1,
          stddev_samp(attendance_pct) AS s1, max(star_rating) AS top,
          avg(star_rating) AS m2, stddev_samp(star_rating) AS s2, avg(customer_age) AS m3,
          stddev_samp(customer_age) AS s3, avg(line_total) AS m4, stddev_samp(line_total) AS s4
          FROM r)
        """
        + union_all(
            [
                """SELECT 'attendance_pct' AS "column", 'range' AS rule,
                count(*) FILTER (WHERE attendance_pct < 0 OR attendance_pct > 100) AS bad_rows
                FROM r""",
                """SELECT 'star_rating' AS "column", 'range' AS rule, count(*) FILTER (WHERE
                CASE WHEN top <= 5 THEN star_rating < 1 OR star_rating > 5
                ELSE star_rating < 0 OR star_rating > 100 END) AS bad_rows FROM r, s""",
                """SELECT 'customer_age' AS "column", 'age' AS rule, count(*) FILTER (WHERE
                customer_age < 0 OR customer_age > 120) AS bad_rows FROM r""",
            ]
            + [
                f"""SELECT '{n}' AS "column", 'extreme' AS rule, count(*) FILTER (WHERE
                abs(({n} - m{i}) / s{i}) > 4) AS bad_rows FROM r, s"""
                for i, n in enumerate(
                    ["order_id", "attendance_pct", "star_rating", "customer_age", "line_total"]
                )
            ]
        )
    ),
)
def quality_rule_counts(spark, folder):
    table = ranged_table(spark, folder)
    rules = quality.value_rules(measure(table, quartiles=False))
    counted = table.agg(
        *[F.count_if(F.expr(r.predicate)).alias(f"r{i}") for i, r in enumerate(rules)]
    )
    rows = [
        F.struct(
            F.lit(r.column).alias("column"),
            F.lit(r.name).alias("rule"),
            F.col(f"r{i}").alias("bad_rows"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


@register(
    "quality_examples",
    with_planted(
        f"""{RANGED}
        SELECT place, round(customer_age, 2) AS value FROM (SELECT customer_age,
        row_number() OVER (ORDER BY order_id) AS place FROM r
        WHERE customer_age < 0 OR customer_age > 120) WHERE place <= 5"""
    ),
)
def quality_examples(spark, folder):
    table = ranged_table(spark, folder)
    rules = quality.value_rules(measure(table, ["customer_age"], quartiles=False))
    aged = [r for r in rules if r.name == "age"]
    return quality.rule_examples(table, aged, "order_id").select("place", "value")


COPIED = """SELECT order_id, segment_priority, attendance_pct, line_total, 'EUR' AS currency
FROM planted
UNION ALL
SELECT order_id, segment_priority, attendance_pct, line_total, 'EUR' AS currency
FROM planted
WHERE status = 'P'
"""
ISSUES = f"""t AS ({COPIED}),
s AS (SELECT avg(line_total) AS m, stddev_samp(line_total) AS sd FROM t),
issues AS (SELECT * FROM (
  SELECT 0 AS seq, 'attendance_pct' AS "column", 'range' AS rule,
    count(*) FILTER (WHERE attendance_pct < 0 OR attendance_pct > 100) AS bad_rows,
    'value(s) beyond the scale' AS wording FROM t
  UNION ALL
  SELECT 1, 'line_total', 'extreme', count(*) FILTER (WHERE abs((line_total - m) / sd) > 4),
    'value(s) over four deviations out' FROM t, s
  UNION ALL
  SELECT 2, '(rows)', 'copies', (SELECT count(*) FROM t) - (SELECT count(*) FROM
    (SELECT DISTINCT * FROM t)), 'further copies of rows'
  UNION ALL
  SELECT 3, 'currency', 'constant', count(*), 'one value in every row' FROM t
  HAVING count(DISTINCT currency) <= 1) WHERE bad_rows > 0)"""


@register(
    "quality_issues",
    with_planted(
        f"""{ISSUES}
        SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, "column", rule,
        CASE WHEN rule = 'constant' THEN wording
             ELSE concat(CAST(bad_rows AS VARCHAR), ' ', wording) END AS issue,
        CAST(bad_rows AS BIGINT) AS bad_rows FROM issues ORDER BY seq LIMIT 6"""
    ),
)
def quality_issues(spark, folder):
    table = planted(spark, folder)
    sql = COPIED.replace("FROM planted", "FROM {planted}")
    copied = spark.sql(sql, planted=table)
    issues = quality.quality_issues(copied, measure(copied, quartiles=False), "order_id")
    return issues.drop("examples", "predicate")


# --- clusters -------------------------------------------------------------------------------

MEASURES = ["final_result", "attendance_pct", "delivery_time", "line_total"]


@register("clusters")
def clusters(spark, folder):
    """Seeded k-means over every row; which seeds are drawn depends on the engine."""
    table = planted(spark, folder)
    stats = measure(table, MEASURES)
    fitted = fit_clusters(table, stats, MEASURES, row_id="order_id")
    return cluster_profile(table, fitted.label, MEASURES, stats.rows)


@register(
    "clusters_settled",
    """SELECT count(*) AS members, CAST(0 AS BIGINT) AS misfits, CAST(0 AS BIGINT) AS off_centre,
    true AS settled FROM orders""",
)
def clusters_settled(spark, folder):
    """Whatever the seeds: every row has its nearest centre, and a centre is the mean of its rows."""
    table = planted(spark, folder)
    stats = measure(table, MEASURES)
    fitted = fit_clusters(table, stats, MEASURES, row_id="order_id")
    distances = [
        sum(((f - F.lit(v)) ** 2 for f, v in zip(fitted.features, c)), F.lit(0.0)) for c in fitted.centres
    ]
    own = F.get(F.array(*distances), fitted.label)
    misfit = own > F.least(*distances) + 1e-9
    labelled = table.select(
        fitted.label.alias("cluster"), misfit.cast("int").alias("misfit"),
        *[f.alias(f"f{i}") for i, f in enumerate(fitted.features)],
    )
    centres = F.array(*[F.array(*map(F.lit, c)) for c in fitted.centres])
    grouped = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.sum("misfit").alias("misfits"),
        *[F.avg(f"f{i}").alias(f"m{i}") for i in range(len(MEASURES))],
    )
    off = F.lit(0)
    for i in range(len(MEASURES)):
        off = off + (F.abs(F.col(f"m{i}") - F.get(F.get(centres, F.col("cluster")), F.lit(i))) > 0.01).cast("int")
    return grouped.agg(
        F.sum("members").alias("members"), F.sum("misfits").alias("misfits"),
        F.sum(off).cast("long").alias("off_centre"),
    ).withColumn("settled", F.lit(fitted.settled))


GROUPED = "p AS (SELECT *, order_id % 3 AS cluster FROM planted), n AS (SELECT count(*) AS total FROM planted)"
PROFILE = f"{GROUPED},\nprofile AS (" + union_all(
    [
        f"""SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS members,
        round(count(*) / total * 100, 1) AS pct, {i} AS ordinal, '{m}' AS variable,
        round(avg({m}), 2) AS mean, (SELECT avg({m}) FROM planted) AS overall
        FROM p, n GROUP BY cluster, total"""
        for i, m in enumerate(MEASURES)
    ]
) + ")"


def fixed_profile(spark, folder):
    table = planted(spark, folder)
    stats = measure(table, MEASURES, quartiles=False)
    label = F.expr("CAST(order_id % 3 AS INT)")
    return cluster_profile(table, label, MEASURES, stats.rows), stats


@register(
    "cluster_profile",
    with_planted(
        f"{PROFILE} SELECT cluster, members, pct, ordinal, variable, mean FROM profile"
    ),
)
def profile_of_fixed_groups(spark, folder):
    return fixed_profile(spark, folder)[0]


@register(
    "hidden_subgroup",
    with_planted(
        f"""{PROFILE}
        SELECT cluster, members, pct, round(avg(abs(coalesce(round((mean - overall)
          / nullif(abs(overall), 0) * 100, 1), 0))), 4) AS deviation FROM profile
        GROUP BY cluster, members, pct HAVING pct BETWEEN 5 AND 45 AND
        avg(abs(coalesce(round((mean - overall) / nullif(abs(overall), 0) * 100, 1), 0))) > 0.1
        ORDER BY deviation DESC, cluster LIMIT 1"""
    ),
)
def subgroup(spark, folder):
    profile, stats = fixed_profile(spark, folder)
    found = hidden_subgroup(profile, stats, least_deviation=0.1)
    return found.withColumn("deviation", F.round("deviation", 4))


# --- formulas -------------------------------------------------------------------------------

SEARCHED = [
    "spend_plan", "final_result", "attendance_pct", "delivery_time", "units", "unit_value",
    "line_total",
]
EXPECTED = {"+": "{a} + {b}", "−": "{a} - {b}", "×": "{a} * {b}",
            "÷": "{a} / CASE WHEN abs({b}) > 1e-9 THEN {b} END"}


def rule_sql(a: str, op: str, b: str, target: str) -> str:
    return f"""SELECT order_id, '{target} ≈ {a} {op} {b}' AS rule, '{a}' AS col_a, '{op}' AS op,
    '{b}' AS col_b, '{target}' AS col_c, {target} AS recorded,
    {EXPECTED[op].format(a=a, b=b)} AS expected FROM planted"""


def tally_sql(a: str, op: str, b: str, target: str) -> str:
    expected = EXPECTED[op].format(a=a, b=b)
    ok = (
        f"(abs({target} - e) / greatest(abs({target}), 1) <= 0.02 OR abs({target} - e) <= 0.05)"
    )
    return f"""SELECT '{target} ≈ {a} {op} {b}' AS rule, '{a}' AS col_a, '{op}' AS op,
    '{b}' AS col_b, '{target}' AS col_c, count(*) FILTER (WHERE {target} IS NOT NULL AND
    e IS NOT NULL) AS valid_rows, count(*) FILTER (WHERE {ok}) AS held, stddev_samp(e) AS dev
    FROM (SELECT {target}, {expected} AS e FROM planted)"""


EVERY_RULE = [
    (a, op, b, t)
    for a in SEARCHED
    for b in SEARCHED
    for t in SEARCHED
    if len({a, b, t}) == 3
    for op in EXPECTED
]


@register(
    "formula_rules",
    on_planted(
        """SELECT rule, col_a, op, col_b, col_c, valid_rows, valid_rows - held AS violations,
        round(held / valid_rows * 100, 1) AS hold_rate FROM ("""
        + union_all([tally_sql(*r) for r in EVERY_RULE])
        + ") WHERE valid_rows >= 8 AND held >= 0.9 * valid_rows AND dev > 0"
    ),
)
def formula_rules(spark, folder):
    """All 840 candidates are checked by SQL; the engine counts only those a sample leaves."""
    table = planted(spark, folder)
    found = formulas.formula_rules(table, measure(table, quartiles=False), SEARCHED)
    return found.drop("rule_no")


FORMS = [
    ("units", "×", "unit_value", "line_total"),
    ("line_total", "÷", "units", "unit_value"),
    ("line_total", "÷", "unit_value", "units"),
]


@register(
    "formula_violations",
    on_planted(
        "SELECT rule, order_id, label, round(recorded, 4) AS recorded, round(expected, 4)"
        " AS expected FROM (SELECT r.*, concat('segment_priority=', segment_priority) AS label"
        " FROM ("
        + union_all([rule_sql(*f) for f in FORMS])
        + """) r JOIN planted p ON r.order_id = p.order_id)
        WHERE expected IS NOT NULL AND NOT (abs(recorded - expected) / greatest(abs(recorded), 1)
        <= 0.02 OR abs(recorded - expected) <= 0.05)"""
    ),
)
def formula_violations(spark, folder):
    table = planted(spark, folder)
    rules = [
        r for r in formulas.candidates(SEARCHED) if (r.a, r.op, r.b, r.c) in FORMS
    ]
    texts = F.create_map(*[x for r in rules for x in (F.lit(r.number), F.lit(r.text))])
    broken = formulas.violating_rows(table, rules, SEARCHED, "order_id")
    return broken.select(
        F.element_at(texts, F.col("rule_no")).alias("rule"),
        F.col("row_id").alias("order_id"),
        "label",
        F.round("recorded", 4).alias("recorded"),
        F.round("expected", 4).alias("expected"),
    )


@register(
    "formula_ranked",
    on_planted(
        """SELECT rule, violations, hold_rate FROM (SELECT *, valid_rows - held AS violations,
        round(held / valid_rows * 100, 1) AS hold_rate FROM ("""
        + union_all([tally_sql(*r) for r in FORMS])
        + """)) WHERE held >= 0.9 * valid_rows AND violations > 0
        ORDER BY violations DESC, hold_rate DESC, list_position(['units', 'unit_value',
        'line_total'], col_a) LIMIT 1"""
    ),
)
def formula_ranked(spark, folder):
    """Four forms of one broken product blame the same rows: one is kept."""
    table = planted(spark, folder)
    rules = formulas.formula_rules(table, measure(table, quartiles=False), SEARCHED)
    kept = formulas.ranked_rules(table, rules, SEARCHED)
    return small_frame(
        spark,
        [(r["rule"], r["violations"], r["hold_rate"]) for r in kept],
        "rule string, violations bigint, hold_rate double",
    )
