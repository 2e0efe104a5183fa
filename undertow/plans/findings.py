"""Turn detector results into ranked findings, and findings into scores.

Only aggregates arrive here: a few rows per detector. The findings form a small typed DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "ordinal int, id string, kind string, severity string, title string, description string,"
    " evidence array<string>, matches bigint, pct double, confidence int, factor string,"
    " factor_pct double, columns array<string>, predicate string, source string, note string"
)
from undertow.session import small_frame
# The column of the scored table that holds the cluster of each row.
CLUSTER = "cluster_label"
SEVERITIES = ("critical", "moderate", "info")
CORRELATION_NOTE = "The columns move together; which one drives the other is open."


@dataclass
class Finding:
    kind: str
    severity: str
    title: str
    description: str
    evidence: list[str]
    matches: int
    pct: float
    confidence: int
    columns: list[str]
    predicate: str | None = None
    factor: str | None = None
    factor_pct: float | None = None
    source: str = "deterministic"
    note: str = ""
    detail: dict = field(default_factory=dict)


def change(a: float | None, b: float | None) -> float:
    """(a - b) / |b| in percent to one decimal; 0 where it cannot be said."""
    if a is None or b is None or b == 0 or b != b:
        return 0.0
    return round((a - b) / abs(b) * 100, 1)


def confidence_of(count: float, effect: float) -> int:
    return int(min(94, max(55, 70 + min(12, count) + min(10, abs(effect) / 3))))


def share(count: int, rows: int) -> float:
    return round(count / max(rows, 1) * 100, 1)


def contradiction_finding(c, overall_b: float, compared: dict, lines: list[str], factor) -> Finding:
    effect = change(compared[c.col_b]["group_mean"], overall_b)
    high, low = ("high", "low") if c.direction == "high" else ("low", "high")
    title = f"{c.col_b} is {low} although {c.col_a} is {high}"
    return Finding(
        kind="contradiction",
        severity="critical" if c.pct >= 5 and abs(effect) >= 20 else "moderate",
        title=title[0].upper() + title[1:],
        description=(
            f"Over the table {c.col_a} and {c.col_b} rise together (r={c.r:.2f}), yet {c.count} row(s)"
            f" ({c.pct}%) go the other way, which no mean of a column reveals."
        ),
        evidence=lines,
        matches=c.count,
        pct=c.pct,
        confidence=confidence_of(c.count, effect),
        columns=[c.col_a, c.col_b],
        predicate=c.predicate,
        factor=factor[0] if factor else None,
        factor_pct=factor[1] if factor else None,
        source="template",
        note=CORRELATION_NOTE,
    )


def segment_finding(s, rows: int, predicate: str) -> Finding:
    return Finding(
        kind="segment",
        severity="critical" if s["spread_pct"] >= 25 else "moderate",
        title=f"{s['number']} is weakest where {s['category']} is {s['worst']}",
        description=(
            f"Its mean there is {s['worst_mean']}, while the whole table has {s['overall']};"
            f" between the groups of {s['category']} means differ by {s['spread_pct']}%."
        ),
        evidence=[
            f"{g['grp']}: {round(g['mean'], 2)} (table: {s['overall']})" for g in s["groups"]
        ],
        matches=s["worst_size"],
        pct=share(s["worst_size"], rows),
        confidence=confidence_of(10, s["spread_pct"]),
        columns=[s["category"], s["number"]],
        predicate=predicate,
        source="template",
        note=CORRELATION_NOTE,
    )


def outlier_finding(summary, top: list, columns: list[str]) -> Finding:
    return Finding(
        kind="outliers",
        severity="moderate",
        title=(
            f"{summary['anomaly_count']} rows far from the others"
            f" ({summary['method']})"
        ),
        description=(
            f"That is {summary['anomaly_pct']}% of the table."
            " Look at each: wrong input, misuse and rare but true cases all look alike here."
        ),
        evidence=[", ".join(f"{c}={row[c]}" for c in columns if c in row) for row in top[:3]],
        matches=summary["anomaly_count"],
        pct=summary["anomaly_pct"],
        confidence=78,
        columns=columns,
        predicate="is_anomaly",
        source="statistical",
        note="The score says how far, not why.",
    )


def missing_finding(m, rows: int) -> Finding:
    name = m["column"]
    return Finding(
        kind="missing",
        severity="info",
        title=f"Gaps in '{name}': {m['pct']}% of its cells",
        description=f"Of {rows} rows, {m['missing']} lack {name}; its mean and quartiles rest on the others.",
        evidence=[f"{name} without a value in {m['missing']} row(s)"],
        matches=m["missing"],
        pct=m["pct"],
        confidence=99,
        columns=[name],
        predicate="`" + name.replace("`", "``") + "` IS NULL",
    )


def quality_finding(q, rows: int) -> Finding:
    examples = list(q["examples"])
    return Finding(
        kind="quality",
        severity="info",
        title=f"Check {q['column']}: {q['issue']}",
        description=f"{q['issue']} in '{q['column']}'; first seen: {examples}.",
        evidence=[f"first seen: {examples}"] if examples else [q["issue"]],
        matches=q["bad_rows"],
        pct=share(q["bad_rows"], rows),
        confidence=95,
        columns=[q["column"]],
        predicate=q["predicate"],
    )


def cluster_finding(best, means: list, stats) -> Finding:
    shown = [(m["variable"], m["mean"]) for m in means]
    return Finding(
        kind="cluster",
        severity="moderate",
        title=(
            f"Rows of group {best['cluster']} ({best['members']} in all)"
            " form a type of their own"
        ),
        description="Several columns set these rows apart together: "
        + "; ".join(f"{name}={mean}" for name, mean in shown[:4])
        + ".",
        evidence=[
            f"{name}: {mean} (table: {round(stats[name].mean, 1)})" for name, mean in shown[:5]
        ],
        matches=best["members"],
        pct=best["pct"],
        confidence=74,
        columns=[name for name, _ in shown[:3]],
        predicate=f"{CLUSTER} = {best['cluster']}",
        source="clustering (k-means)",
        note="Found by distance alone; the groups may have no meaning.",
    )


def formula_finding(rule: dict, examples: list, rows: int, predicate: str) -> Finding:
    columns = [rule["col_a"], rule["col_b"], rule["col_c"]]
    if not rule["violations"]:
        return Finding(
            kind="verified",
            severity="info",
            title=f"Formula kept by every row: {rule['rule']}",
            description=f"Within the tolerance, '{rule['rule']}' is true of each of the {rows} rows.",
            evidence=[f"{rows} of {rows} rows agree"],
            matches=rows,
            pct=100.0,
            confidence=99,
            columns=columns,
        )
    sides = f"{rule['col_a']}{rule['op']}{rule['col_b']}"
    lines = [
        f"{e['label']}: {rule['col_c']}={e['recorded']:g} but {sides}={e['expected']:,.2f}"
        for e in examples
    ]
    return Finding(
        kind="formula",
        severity="critical",
        title=f"Formula {rule['rule']} missed by {rule['violations']} row(s)",
        description=(
            f"With {rule['hold_rate']}% of rows agreeing, '{rule['rule']}' was probably computed;"
            f" {rule['violations']} row(s) disagree."
        ),
        evidence=[*lines, f"{rule['hold_rate']}% of rows agree"],
        matches=rule["violations"],
        pct=share(rule["violations"], rows),
        confidence=int(min(93, 75 + rule["hold_rate"] // 5)),
        columns=columns,
        predicate=predicate,
        source="template",
        note="Recomputed from the cells; the source may round differently.",
    )


def key_finding(key, examples: list[str]) -> Finding:
    shown = ", ".join(examples)
    return Finding(
        kind="duplicates",
        severity="moderate",
        title=f"'{key['column']}' is no key: {key['repeated_rows']} row(s) share a value",
        description=(
            f"A join on {key['column']} would multiply {key['repeated_rows']} row(s) ({key['pct']}%),"
            f" since their value occurs again, as {shown} do."
        ),
        evidence=[f"values that occur again: {shown}"],
        matches=key["repeated_rows"],
        pct=key["pct"],
        confidence=97,
        columns=[key["column"]],
    )


def findings_frame(spark: SparkSession, findings: list[Finding]) -> DataFrame:
    """All findings with ids in the order they were found."""
    rows = [
        (
            i,
            f"F{i + 1}",
            f.kind,
            f.severity,
            f.title,
            f.description,
            f.evidence,
            f.matches,
            float(f.pct),
            f.confidence,
            f.factor,
            f.factor_pct,
            f.columns,
            f.predicate,
            f.source,
            f.note,
        )
        for i, f in enumerate(findings)
    ]
    return small_frame(spark, rows, SCHEMA)


def severity_rank():
    rank = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.col("severity") == name, i).otherwise(rank)
    return rank


def ranked(findings: DataFrame) -> DataFrame:
    """Critical first, then by confidence; equal ones keep the order they were found in."""
    return findings.orderBy(severity_rank(), F.desc("confidence"), "ordinal")


def table_scores(
    findings: DataFrame, missing_pct: float, issues: int, anomaly_pct: float
) -> DataFrame:
    """One row: data health, mean confidence, hidden risk and the number of findings by severity."""
    worst = F.least(F.lit(30.0), F.lit(missing_pct / 2 + 3.0 * issues))
    unusual = F.least(F.lit(25.0), F.lit(float(anomaly_pct)))
    health = F.greatest(F.lit(35.0), F.lit(100.0) - worst - unusual - F.lit(2.0 * issues))
    many = F.lit(anomaly_pct > 12)
    risk = (
        F.when((F.col("critical") >= 2) | (many & (F.col("critical") >= 1)), "HIGH")
        .when((F.col("critical") >= 1) | (F.col("moderate") >= 2) | many, "MEDIUM")
        .otherwise("LOW")
    )
    counted = findings.agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES],
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bround(F.avg("confidence"), 0), F.lit(60.0)).alias("mean_confidence"),
    )
    return counted.select(
        *SEVERITIES,
        "total",
        F.floor(health).cast("int").alias("data_health"),
        F.col("mean_confidence").cast("int").alias("insight_confidence"),
        risk.alias("hidden_risk"),
    )
