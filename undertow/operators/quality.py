"""Entry errors: values outside the range a column's name promises, extremes, copies, constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions import vocabulary as words
from undertow.functions.cells import column, flat_columns, number, quoted, sql_double
from undertow.operators.duplicates import duplicate_rows
from undertow.operators.statistics import TableStats

ISSUE_SCHEMA = (
    "seq int, column string, rule string, issue string, bad_rows bigint,"
    " examples array<double>, predicate string"
)
from undertow.session import small_frame
ROW_ISSUE = "(rows)"


@dataclass(frozen=True)
class Rule:
    column: str
    name: str
    wording: str
    predicate: str


def outside(name: str, low: float, high: float) -> str:
    return f"({quoted(name)} < {low:g} OR {quoted(name)} > {high:g})"


def value_rules(stats: TableStats) -> list[Rule]:
    """The value rules that apply, in report order: by column, then range, age, extremes."""
    rules = []
    for name in stats.numeric:
        c = stats[name]
        tokens = set(name.lower().replace("-", "_").split("_"))
        if tokens & set(words.PERCENT_TOKENS) and not words.has_word(name, words.PERCENT_SKIP):
            five_stars = "rating" in tokens and c.high <= 5
            low, high = (1, 5) if five_stars else (0, 100)
            rules.append(
                Rule(name, "range", "value(s) beyond the scale", outside(name, low, high))
            )
        if words.has_word(name, ("age",)):
            rules.append(Rule(name, "age", "age(s) nobody reaches", outside(name, 0, 120)))
        if c.spread:
            z = f"abs(({quoted(name)} - {sql_double(c.mean)}) / {sql_double(c.spread)})"
            rules.append(
                Rule(name, "extreme", "value(s) over four deviations out", f"{z} > 4")
            )
    return rules


def count_rules(df: DataFrame, rules: list[Rule], also: list | None = None) -> dict:
    """Rows breaking each rule, all counted in one scan, with any other aggregates asked for."""
    counts = [F.count_if(F.expr(r.predicate)).alias(f"r{i}") for i, r in enumerate(rules)]
    wanted = counts + (also or [])
    return df.agg(*wanted).first().asDict() if wanted else {}


def rule_examples(df: DataFrame, rules: list[Rule], row_id: str, most: int = 5) -> DataFrame:
    """The first values, in row order, that break each rule: (rule_no, place, value)."""
    if not rules:
        return small_frame(df.sparkSession, [], "rule_no int, place int, value double")
    hits = F.array(
        *[
            F.when(
                F.expr(r.predicate),
                F.struct(F.lit(i).alias("rule_no"), number(r.column).alias("value")),
            )
            for i, r in enumerate(rules)
        ]
    )
    order = Window.partitionBy("rule_no").orderBy("row_key")
    return (
        df.select(column(row_id).alias("row_key"), F.inline(F.array_compact(hits)))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= most)
        .select("rule_no", "place", F.round("value", 2).alias("value"))
    )


def quality_issues(
    df: DataFrame,
    stats: TableStats,
    row_id: str,
    most: int | None = 6,
    columns: list[str] | None = None,
) -> DataFrame:
    """The issue list in report order: value rules, duplicate rows, constant columns.

    `bad_rows` is the true number of rows; `examples` holds up to five of their values. An extreme
    is reported only for a column with no other issue. `row_id` orders the examples; pass `columns`
    without it when it was added on the way and is no part of the table.
    """
    spark = df.sparkSession
    rules = value_rules(stats)
    flat = flat_columns(df) if columns is None else columns
    edges = [
        expression
        for i, name in enumerate(flat)
        for expression in (
            F.min(column(name)).alias(f"low{i}"),
            F.max(column(name)).alias(f"high{i}"),
        )
    ]
    counted = count_rules(df, rules, edges)
    broken: list[tuple[Rule, int]] = []
    for i, rule in enumerate(rules):
        bad = counted[f"r{i}"]
        known = any(r.column == rule.column for r, _ in broken)
        if bad and not (rule.name == "extreme" and known):
            broken.append((rule, bad))
    examples: dict[int, list[float]] = {}
    shown = [rule for rule, _ in broken]
    for row in rule_examples(df, shown, row_id).orderBy("rule_no", "place").collect():
        examples.setdefault(row["rule_no"], []).append(row["value"])
    issues = [
        (rule.column, rule.name, f"{bad} {rule.wording}", bad, examples.get(i, []), rule.predicate)
        for i, (rule, bad) in enumerate(broken)
    ]
    copies = duplicate_rows(df, flat).first()["duplicate_rows"]
    if copies:
        issues.append((ROW_ISSUE, "copies", f"{copies} further copies of rows", copies, [], None))
    for i, name in enumerate(flat):
        if counted[f"low{i}"] == counted[f"high{i}"]:
            wording = "one value in every row"
            issues.append((name, "constant", wording, stats.rows, [], None))
    rows = [(seq, *issue) for seq, issue in enumerate(issues)]
    return small_frame(spark, rows if most is None else rows[:most], ISSUE_SCHEMA)
