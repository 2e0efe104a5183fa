from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import undertow
from undertow.functions.cells import confidence
from undertow.operators.anomalies import ZSCORE
from undertow.operators.statistics import measure
from undertow.plans import charts, findings, investigate, report
from undertow.session import new_path


def school(spark, n=200):
    """Marks that follow effort, but for 14 rows; section B does worse; some cells are gaps."""
    draw = np.random.default_rng(3)
    values = []
    for i in range(n):
        odd = i < 14
        effort = 50.0 + 40 * draw.random() if not odd else 86.0 + 4 * draw.random()
        section = "ABC"[i % 3]
        final = 40.0 if odd else 20 + effort * 0.6 - (12 if section == "B" else 0) + 6 * draw.random()
        attend = None if i % 9 == 0 else (147.0 if i == 5 else 80.0 + 10 * draw.random())
        hours = 1.5 if odd else 4 + draw.random()
        values.append((f"S{i:03d}", attend, effort, final, hours, section))
    return spark.createDataFrame(
        values,
        "Student_ID string, Attendance double, Internal_Marks double, Final_Marks double,"
        " Study_Hours double, Section string",
    )


@pytest.fixture(scope="module")
def done(spark):
    return undertow.audit(school(spark), name="school", method=ZSCORE)


def test_findings_of_a_table_with_planted_patterns(done):
    found = {r["kind"]: r for r in done.findings.collect()}
    assert {"contradiction", "segment", "missing", "quality"} <= set(found)
    first = done.findings.first()
    assert first["severity"] == "critical"
    assert first["title"] == "Final_Marks is low although Internal_Marks is high"
    assert first["factor"] == "Study_Hours" and first["matches"] >= 14
    assert found["missing"]["columns"] == ["Attendance"]
    assert done.issues.first()["examples"] == [147.0]


def test_ids_follow_the_order_found_and_ranks_follow_severity(done):
    rows = done.findings.collect()
    order = {"critical": 0, "moderate": 1, "info": 2}
    keys = [(order[r["severity"]], -r["confidence"], r["ordinal"]) for r in rows]
    assert keys == sorted(keys)
    assert sorted(r["id"] for r in rows) == sorted(f"F{r['ordinal'] + 1}" for r in rows)


def test_every_predicate_selects_its_rows(done):
    for row in done.findings.where("predicate IS NOT NULL").collect():
        assert done.scored.where(row["predicate"]).count() == row["matches"], row["title"]


def test_investigation_of_a_finding(done):
    first = done.findings.first()
    result = done.investigate(first["id"])
    assert result.group_size == first["matches"] and not result.fell_back
    rows = result.rows.collect()
    assert rows[0]["variable"] == "Study_Hours" and rows[0]["verdict"] == "significant"
    assert "Study_Hours" in result.summary
    with pytest.raises(KeyError):
        done.investigate("F99")


def test_investigation_falls_back_only_when_it_must(done):
    assert investigate.investigate(done.scored, "Final_Marks > 1000", done.numbers).fell_back
    one = investigate.investigate(done.scored, "Attendance = 147", done.numbers)
    assert one.group_size == 1 and not one.fell_back
    with pytest.raises(ValueError):
        investigate.investigate(done.table, None, done.numbers)


def test_scores(done):
    scores = done.scores.first()
    rows = done.findings.collect()
    assert scores["total"] == len(rows)
    assert scores["hidden_risk"] == ("HIGH" if scores["critical"] >= 2 else "MEDIUM")
    assert 35 <= scores["data_health"] <= 100


def test_scores_of_a_clean_table(spark):
    none = findings.findings_frame(spark, [])
    got = findings.table_scores(none, 0.0, 0, 0.0).first()
    assert (got["data_health"], got["insight_confidence"], got["hidden_risk"]) == (100, 60, "LOW")


@pytest.mark.parametrize(
    "gap_pct, issues, unusual, health", [(8.9, 1, 11.1, 79), (200.0, 0, 0.0, 70), (80.0, 9, 50.0, 35)]
)
def test_health(spark, gap_pct, issues, unusual, health):
    none = findings.findings_frame(spark, [])
    assert findings.table_scores(none, gap_pct, issues, unusual).first()["data_health"] == health


def test_confidence_in_both_places(spark):
    cases = [(14, -60.7), (3, 0.0), (100, 200.0), (10, 17.1)]
    frame = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(cases)], "i int, n int, e double")
    got = frame.select("i", confidence(F.col("n"), F.col("e")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [findings.confidence_of(n, e) for n, e in cases]


def test_charts(done):
    drawn = done.charts()
    assert {"contradiction", "segment", "missing", "distribution"} <= set(drawn)
    first = done.findings.first()
    assert drawn["contradiction"].where("flagged").count() == first["matches"]
    assert drawn["distribution"].agg(F.sum("rows")).first()[0] == 200
    assert drawn["segment"].where("highlighted").first()["label"] == "B"


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(4.0,)] * 12, "x double")
    got = charts.histogram(frame, "x", measure(frame)).collect()
    assert len(got) == 8 and sum(r["rows"] for r in got) == 12


def test_months_follow_the_calendar(spark):
    frame = spark.createDataFrame(
        [("March", 3.0), ("January", 1.0), ("April", 4.0), ("January", 2.0)], "month string, v double"
    )
    got = charts.trend(frame, "month", "v").collect()
    assert [(r["label"], r["value"]) for r in got] == [("January", 1.5), ("March", 3.0), ("April", 4.0)]


def test_report(done, spark):
    blocks = [r["text"] for r in done.report().orderBy("ordinal").collect()]
    assert blocks[0].startswith("# What school hides")
    titles = [r["title"] for r in done.findings.collect()]
    assert [b.split("\n")[0].split(". ", 1)[1] for b in blocks[1 : 1 + len(titles)]] == titles
    assert [b.startswith("## Repairs") for b in blocks[1 + len(titles) :]] == [True] * (done.log.count() > 0)
    assert any("Also different there: **Study_Hours**" in b for b in blocks)
    path = new_path(spark, "report")
    report.write_blocks(done.report(), path)
    assert spark.read.text(path).select("dataset").distinct().first()[0] == "school"


def test_json_has_no_nan(spark):
    path = new_path(spark, "json")
    frame = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "i int, x double")
    report.write_json(frame, path)
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert sorted(lines, key=lambda r: r["i"]) == [{"i": 1}, {"i": 2, "x": 1.5}]


def test_nested_values_have_no_nan_either(spark):
    path = new_path(spark, "json")
    nan = float("nan")
    frame = spark.createDataFrame(
        [(1, [1.0, nan], {"x": nan}, (nan, 2.0))], "i int, a array<double>, m map<string,double>, s struct<p:double,q:double>"
    )
    report.write_json(frame, path)
    assert json.loads(spark.read.text(path).first()[0]) == {"i": 1, "a": [1.0, None], "m": {"x": None}, "s": {"q": 2.0}}


@pytest.mark.parametrize("minutes", [100_000, 30, 600, 5_000_000])
def test_trends_cover_the_whole_span(spark, minutes):
    frame = spark.range(minutes).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as at", "double(id) as v"
    )
    got = charts.trend(frame, "at", "v").collect()
    assert 3 <= len(got) <= charts.TREND_POINTS
    assert got[-1]["value"] > minutes * 0.8


def test_ties_between_cited_columns_go_by_rank(spark):
    found = [
        findings.Finding("missing", "info", "one", "", [], 1, 1.0, 99, ["x"]),
        findings.Finding("segment", "critical", "two", "", [], 1, 1.0, 80, ["z"]),
    ]
    assert charts.most_cited(findings.findings_frame(spark, found), ["x", "z"]) == "z"


def test_preview(done):
    rows = done.preview().collect()
    assert len(rows) == 8 and rows[0]["Attendance"] == "" and rows[1]["Student_ID"] == "S001"


def test_whole_audit_with_its_seeded_parts(spark):
    one = undertow.audit(school(spark), "Student_ID", name="school")
    kinds = {r["kind"] for r in one.findings.collect()}
    assert "outliers" in kinds
    assert one.clusters is not None and "cluster_label" in one.scored.columns
    two = undertow.audit(school(spark).repartition(5), "Student_ID", name="school")
    assert one.findings.collect() == two.findings.collect()


def test_a_table_without_numbers(spark):
    frame = spark.createDataFrame([(f"a{i}", "x") for i in range(12)], "name string, t string")
    got = undertow.audit(frame, "name")
    assert [r["kind"] for r in got.findings.collect()] == ["quality"]
    assert got.charts() == {}


def test_an_empty_table(spark):
    frame = spark.createDataFrame([], "k int, x double, t string")
    got = undertow.audit(frame, "k", repaired=True)
    assert got.stats.rows == 0
    assert got.scored.count() == 0


def test_awkward_column_names(spark):
    values = [(i, float(i), float(i) if i % 5 else 100.0 - i, "it's" if i % 2 else "b\\c") for i in range(60)]
    frame = spark.createDataFrame(values, "`the key` int, `a.b` double, `c``d` double, `g's` string")
    got = undertow.audit(frame, "the key", repaired=True, method=ZSCORE)
    for row in got.findings.where("predicate IS NOT NULL").collect():
        assert got.scored.where(row["predicate"]).count() == row["matches"], row["title"]


def test_a_table_may_have_columns_named_like_ours(spark):
    values = [(i, i * 1.0, 5.0 if i % 2 else 9.0, i % 3) for i in range(40)]
    frame = spark.createDataFrame(values, "row_id int, score double, zmax double, cluster int")
    got = undertow.audit(frame, repaired=True, method=ZSCORE)
    rows = investigate.investigate(got.scored, "score >= 20", got.numbers).rows
    means = {r["variable"]: r for r in rows.collect()}
    assert means["score"]["group_mean"] == 29.5 and means["score"]["rest_mean"] == 9.5


def test_a_row_id_must_be_unique(spark):
    frame = spark.createDataFrame([(i // 2, float(i)) for i in range(30)], "k int, x double")
    with pytest.raises(ValueError, match="unique"):
        undertow.audit(frame, "k")


def test_a_table_of_null_words_is_refused_by_name(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("a,b\n" + "NA,null\n-,n/a\n" * 5)
    loaded = undertow.read_table(spark, str(path))
    with pytest.raises(ValueError, match="sheet"):
        undertow.audit(loaded.table, log=loaded.log, name="sheet")


def test_an_audit_may_list_everything(spark):
    from undertow.plans.audit import Listed

    values = [(i, *[999.0 if i == j else float(i % 7) for j in range(9)]) for i in range(80)]
    names = ", ".join(f"mark{j} double" for j in range(9))
    frame = spark.createDataFrame(values, f"k int, {names}")

    def issues(listed):
        done = undertow.audit(frame, "k", method=ZSCORE, with_clusters=False, repaired=True, listed=listed)
        return done.findings.where("kind = 'quality'").count()

    assert issues(Listed()) == 6
    assert issues(Listed(*[None] * 7)) >= 9
