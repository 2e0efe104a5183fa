"""The whole audit: repair, measure, detect, and rank, with only aggregates on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.cells import column, flat_columns, numeric_columns, quoted, sql_text
from undertow.operators import anomalies, clusters, compare, contradictions, formulas, keys
from undertow.operators import profile, quality, segments
from undertow.operators.frequencies import column_counts, hashed_counts
from undertow.operators.ingest import repair, with_row_id
from undertow.operators.statistics import TableStats, measure
from undertow.plans import charts, findings, investigate, report
from undertow.session import settled, side_by_side, small_frame, written
from undertow.sources.validate import UnusableTable

ROW_ID = "row_id"
MOST_GROUPS = 20


@dataclass(frozen=True)
class Listed:
    """How many of each kind an audit lists; None lists all. Counts always cover every row.

    `formula_columns` are the number columns that formulas are searched among.
    """

    contradictions: int | None = 4
    segments: int | None = 4
    issues: int | None = 6
    keys: int | None = 3
    formula_columns: int | None = 8
    broken_formulas: int | None = 3
    kept_formulas: int | None = 1


@dataclass(frozen=True)
class Audit:
    """Everything found about one table. The frames are small, or lazy views of the table."""

    name: str
    table: DataFrame
    row_id: str
    columns: list[str]
    numbers: list[str]
    categories: list[str]
    stats: TableStats
    log: DataFrame
    profile: DataFrame
    scored: DataFrame
    anomalies: DataFrame
    top_rows: DataFrame
    segments: DataFrame
    missing: DataFrame
    issues: DataFrame
    clusters: DataFrame | None
    formula_examples: DataFrame
    findings: DataFrame
    scores: DataFrame
    listed: Listed = Listed()

    def investigate(self, finding_id: str) -> investigate.Investigation:
        """Compare a finding's rows with the rest of the table."""
        found = self.findings.where(F.col("id") == finding_id).first()
        if found is None:
            raise KeyError(finding_id)
        return investigate.investigate(
            self.scored, found["predicate"], self.numbers, found["title"]
        )

    def number_profile(self) -> DataFrame:
        return profile.number_profile(self.table, self.stats)

    def common_values(self) -> DataFrame:
        names = [n for n in self.columns if n not in self.numbers]
        return profile.common_values(self.table, names)

    def charts(
        self, sampled: bool = False, points: int | None = charts.SCATTER_ROWS
    ) -> dict[str, DataFrame]:
        """The data of every chart some finding calls for.

        Scatter charts show the first `points` rows, or `sampled` ones of both kinds; None shows all.
        """
        scatter = charts.scatter_sample if sampled else charts.scatter_points
        drawn: dict[str, DataFrame] = {}
        top = {}
        for row in findings.ranked(self.findings).collect():
            top.setdefault(row["kind"], row)
        if "contradiction" in top:
            a, b = top["contradiction"]["columns"]
            rule = top["contradiction"]["predicate"]
            drawn["contradiction"] = scatter(self.scored, a, b, rule, self.row_id, points)
        elif self.anomalies.first()["anomaly_count"] >= 3 and len(self.numbers) >= 2:
            a, b = self.numbers[:2]
            drawn["outliers"] = scatter(
                self.scored, a, b, "is_anomaly", self.row_id, points
            )
        if "segment" in top:
            drawn["segment"] = charts.segment_bars(self.segments.limit(1))
        if "formula" in top:
            names = top["formula"]["columns"]
            searched = formulas.searched_columns(
                self.stats, (self.row_id,), self.listed.formula_columns
            )
            first = [
                row["rule_no"] for row in self.formula_examples.select("rule_no").distinct().collect()
                if formulas.formula_at(row["rule_no"], searched).text in top["formula"]["title"]
                and set(names) <= set(searched)
            ]
            own = self.formula_examples.where(F.col("rule_no").isin(first[:1]))
            drawn["formula"] = charts.formula_pairs(own)
        if "cluster" in top:
            number = int(top["cluster"]["predicate"].rsplit(" ", 1)[1])
            drawn["cluster"] = charts.cluster_bars(self.clusters, self.stats, number)
        if "missing" in top:
            drawn["missing"] = charts.missing_bars(self.missing)
        if self.numbers and self.stats.rows >= 10:
            cited = charts.most_cited(self.findings, self.numbers)
            target = cited or self.numbers[-1]
            drawn["distribution"] = charts.histogram(self.table, target, self.stats)
            time = charts.time_column(self.table)
            if time:
                line = settled(charts.trend(self.table, time, cited or self.numbers[0]))
                if line.count() >= charts.LEAST_TREND_POINTS:
                    drawn["trend"] = line
        return drawn

    def report(self) -> DataFrame:
        """(dataset, ordinal, text): a heading, a block per finding by rank, and the repairs made."""
        top = report.heading(
            self.name, self.stats.rows, len(self.columns), self.scores.first()
        )
        spark = self.table.sparkSession
        first = small_frame(spark,
            [(self.name, -1, top)], "dataset string, ordinal int, text string"
        )
        blocks = first.unionByName(report.finding_blocks(self.findings, self.name))
        return blocks.unionByName(report.repair_block(self.log, self.name))

    def preview(self) -> DataFrame:
        shown = self.table.select(column(self.row_id), *[column(n) for n in self.columns])
        return report.preview(shown, self.row_id)


def audit(
    df: DataFrame,
    row_id: str | None = None,
    name: str = "table",
    log: list | None = None,
    method: str | None = None,
    with_clusters: bool = True,
    seed: int = 42,
    repaired: bool = False,
    listed: Listed = Listed(),
) -> Audit:
    """Audit a table. `row_id` names its unique column; without one, rows are numbered.

    A table that had to be repaired or numbered is written once to the shared folder, so that the
    scans that follow read pruned columns instead of parsing text again. `listed` says how many of
    each kind of finding to list.
    """
    if not repaired:
        fixed = repair(df, log)
        notes, table = fixed.log_frame(), fixed.table
        changed = bool(fixed.log) or row_id is None
    else:
        notes = small_frame(df.sparkSession,
            [], "seq int, step string, column string, detail string"
        )
        table, changed = df, row_id is None
    spark = table.sparkSession
    key = row_id or (ROW_ID if ROW_ID not in table.columns else "_" + ROW_ID)
    if row_id is None:
        table = with_row_id(table, key)
    added = () if row_id else (key,)
    columns = flat_columns(table, added)
    if not columns:
        raise UnusableTable(f"'{name}' has no column with a value")
    if changed:
        table = written(table)
    if row_id:
        check_identity(table, row_id)
    stats = measure(table, numeric_columns(table, added))
    numbers = stats.numeric
    rows = stats.rows

    part = _Part(table, key, columns, stats, method, with_clusters, seed, listed)
    done = side_by_side(
        spark,
        {
            "columns": part.columns_and_segments,
            "breaks": part.contradictions,
            "rows": part.anomalies,
            "issues": part.quality,
            "clusters": part.clusters,
            "formulas": part.formulas,
        },
    )
    profiled, categories, gaps, missing, key_list = done["columns"]
    scored, summary, top = done["rows"]
    outliers = summary.first()
    found: list[findings.Finding] = list(done["breaks"])
    found += [findings.segment_finding(s, rows, _segment_rule(s)) for s in gaps.collect()]
    if outliers["anomaly_count"] >= 3 and len(found) < 6:
        shown = [r.asDict() for r in top.collect()]
        found.append(findings.outlier_finding(outliers, shown, numbers[:4]))
    missed = missing.orderBy("ordinal").collect()
    found += [findings.missing_finding(m, rows) for m in missed]
    issues = done["issues"]
    issue_rows = issues.orderBy("seq").collect()
    found += [findings.quality_finding(q, rows) for q in issue_rows]
    clustered = None
    if done["clusters"] is not None:
        label, clustered, best, own = done["clusters"]
        scored = scored.withColumn(findings.CLUSTER, label)
        if best is not None and len(found) < 8:
            found.append(findings.cluster_finding(best, own, stats))
    examples, formula_list = done["formulas"]
    found += formula_list + key_list

    frame = findings.findings_frame(spark, found)
    scores = findings.table_scores(
        frame, float(sum(m["pct"] for m in missed)), len(issue_rows), outliers["anomaly_pct"]
    )
    return Audit(
        name, table, key, columns, numbers, categories, stats, notes, profiled, scored, summary,
        top, gaps, missing, issues, clustered, examples, findings.ranked(frame), scores, listed,
    )


def check_identity(table: DataFrame, row_id: str) -> None:
    """Raise unless every row has its own value: samples, ranks and drill-downs rely on it."""
    keys = table.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(column(row_id)).alias("keys")).first()
    if keys["rows"] != keys["keys"]:
        raise ValueError(f"'{row_id}' names {keys['keys']} of {keys['rows']} rows; it must be unique and not null")


def _segment_rule(gap) -> str:
    return f"CAST({quoted(gap['category'])} AS STRING) = {sql_text(gap['worst'])}"


@dataclass(frozen=True)
class _Part:
    """The detectors of one audit. None needs another's result, so they can run side by side."""

    table: DataFrame
    key: str
    names: list[str]
    stats: TableStats
    method: str | None
    with_clusters: bool
    seed: int
    listed: Listed

    def columns_and_segments(self):
        """Profile, categories, segment gaps, missing columns and repeating keys."""
        table, stats = self.table, self.stats
        counted = settled(column_counts(hashed_counts(table, self.names)))
        profiled = settled(profile.column_profile(table, self.names, counted))
        by_column = profiled.orderBy("ordinal").collect()
        numeric = numeric_columns(table)
        categories = [
            r["column"]
            for r in by_column
            if r["column"] not in numeric and r["distinct_values"] <= MOST_GROUPS
        ]
        judged = segments.judged_columns(stats)
        means = segments.group_means(table, judged, categories)
        gaps = settled(
            segments.top_segments(segments.segment_gaps(means, stats), self.listed.segments)
        )
        missing = profile.columns_with_gaps(profiled)
        repeated = keys.key_columns(table, counted, most=self.listed.keys)
        repeated = repeated.orderBy("ordinal").collect()
        samples: dict[str, list[str]] = {}
        chosen = keys.key_examples(table, [r["column"] for r in repeated])
        for row in chosen.collect():
            samples.setdefault(row["column"], []).append((row["place"], row["example"]))
        found = [
            findings.key_finding(r, [text for _, text in sorted(samples[r["column"]])])
            for r in repeated
        ]
        return profiled, categories, gaps, missing, found

    def contradictions(self) -> list[findings.Finding]:
        table, stats = self.table, self.stats
        breaks = contradictions.contradictions(table, stats, self.listed.contradictions)
        groups = {str(i): c.predicate for i, c in enumerate(breaks)}
        pairs = {str(i): (c.col_a, c.col_b) for i, c in enumerate(breaks)}
        if not breaks:
            return []
        compared = settled(compare.compare_groups(table, groups, stats.numeric))
        lines: dict[str, list[str]] = {}
        for row in compare.evidence(compared, pairs).orderBy("group", "place").collect():
            lines.setdefault(row["group"], []).append(row["line"])
        factors = {
            row["group"]: (row["variable"], row["diff_pct"])
            for row in compare.contributing_factor(compared, pairs).collect()
        }
        by_group: dict[str, dict] = {}
        for row in compared.collect():
            by_group.setdefault(row["group"], {})[row["variable"]] = row
        return [
            findings.contradiction_finding(
                c, stats[c.col_b].mean, by_group[g], lines[g], factors.get(g)
            )
            for g, c in zip(groups, breaks)
        ]

    def anomalies(self):
        """The scored table, its summary and its top rows."""
        table, stats = self.table, self.stats
        if stats.numeric:
            scored = anomalies.score_rows(
                table, stats, self.key, stats.numeric, self.method, self.seed
            )
        else:
            scored = table.withColumns(
                {
                    anomalies.SCORE: F.lit(0.0),
                    anomalies.ZMAX: F.lit(0.0),
                    anomalies.FLAG: F.lit(False),
                }
            )
        enough = len(stats.numeric) >= 2 and stats.rows >= 10
        used = self.method or (anomalies.FOREST if enough else anomalies.ZSCORE)
        summary = settled(anomalies.anomaly_summary(scored, used))
        return scored, summary, settled(anomalies.top_rows(scored, self.key))

    def quality(self) -> DataFrame:
        return quality.quality_issues(
            self.table, self.stats, self.key, columns=self.names, most=self.listed.issues
        )

    def clusters(self):
        """The label, the profile, and the hidden subgroup with its means, if there is one."""
        table, stats = self.table, self.stats
        if not self.with_clusters:
            return None
        fitted = clusters.fit_clusters(table, stats, stats.numeric, seed=self.seed, row_id=self.key)
        if fitted is None:
            return None
        profiled = settled(
            clusters.cluster_profile(table, fitted.label, stats.numeric, stats.rows)
        )
        best = clusters.hidden_subgroup(profiled, stats).first()
        own = []
        if best is not None:
            mine = profiled.where(F.col("cluster") == best["cluster"])
            own = mine.orderBy("ordinal").collect()
        return fitted.label, profiled, best, own

    def formulas(self):
        """Example rows and findings of the broken and verified rules."""
        table, stats = self.table, self.stats
        searched = formulas.searched_columns(stats, (self.key,), self.listed.formula_columns)
        rules = formulas.formula_rules(table, stats, searched)
        rules = formulas.ranked_rules(
            table, rules, searched, self.listed.broken_formulas, self.listed.kept_formulas
        )
        broken = [formulas.as_formula(r) for r in rules if r["violations"]]
        shown = table.select(column(self.key), *[column(n) for n in self.names if n != self.key])
        violating = formulas.violating_rows(shown, broken, searched, self.key)
        examples = settled(formulas.violation_examples(violating))
        by_rule: dict[int, list] = {}
        for row in examples.orderBy("rule_no", "place").collect():
            by_rule.setdefault(row["rule_no"], []).append(row)
        return examples, [
            findings.formula_finding(
                r, by_rule.get(r["rule_no"], []), stats.rows, formulas.as_formula(r).predicate()
            )
            for r in rules
        ]
