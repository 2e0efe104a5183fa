from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from undertow.operators import contradictions as c
from undertow.operators import formulas, keys, quality, segments
from undertow.operators.anomalies import FOREST, ZSCORE, anomaly_summary, score_rows, top_rows
from undertow.operators.clusters import cluster_profile, fit_clusters, hidden_subgroup, spread_out
from undertow.operators import clusters
from undertow.operators.compare import compare_groups, contributing_factor, evidence
from undertow.operators.duplicates import duplicate_rows
from undertow.operators.forest import average_path, contamination
from undertow.operators.frequencies import categorical_columns, column_counts, value_counts
from undertow.operators.profile import column_profile, missing_columns, number_profile
from undertow.operators.statistics import imputed, measure


def mixed(rows):
    return rows(
        [(1, 1.0, "a", True), (2, None, "b", True), (3, 4.0, None, False), (4, 9.0, "a", True)],
        "id int, x double, t string, flag boolean",
    )


def test_measure(rows):
    stats = measure(mixed(rows))
    assert stats.rows == 4 and stats.numeric == ["id", "x"]
    x = stats["x"]
    assert (x.non_null, x.low, x.high, x.median) == (3, 1.0, 9.0, 4.0)
    assert x.mean == pytest.approx(14 / 3) and x.std == pytest.approx(np.std([1, 4, 9], ddof=1))


def test_measure_of_nothing(rows):
    stats = measure(rows([], "x double, y int"))
    assert stats.rows == 0 and stats.numeric == []
    assert stats["x"].median is None and stats["x"].spread is None


def test_filled_moments_equal_those_of_the_filled_column(rows):
    frame = mixed(rows)
    stats = measure(frame)
    got = frame.select(imputed(stats, ["x"])[0].alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert stats["x"].filled(stats.rows) == pytest.approx(tuple(got))


def test_profile_counts(rows):
    got = {r["column"]: r for r in column_profile(mixed(rows)).collect()}
    assert (got["x"]["missing"], got["x"]["missing_pct"], got["x"]["distinct_values"]) == (1, 25.0, 3)
    assert (got["t"]["distinct_values"], got["flag"]["distinct_values"]) == (2, 2)


def test_profile_of_an_empty_table(rows):
    got = column_profile(rows([], "x double, t string")).collect()
    assert [(r["rows"], r["missing"], r["distinct_values"]) for r in got] == [(0, 0, 0)] * 2


def test_one_value_has_no_deviation(rows):
    frame = rows([(2.0,)], "x double")
    assert number_profile(frame, measure(frame)).first()["std"] == 0.0


def test_value_counts_keep_large_integers_apart(rows):
    frame = rows([(2**53,), (2**53 + 1,), (2**53 + 1,)], "k bigint")
    got = column_counts(value_counts(frame)).first()
    assert (got["distinct_values"], got["repeated_rows"]) == (2, 2)


def test_categories(rows):
    values = [(i, f"t{i}", "ab"[i % 2], i % 2 == 0) for i in range(30)]
    frame = rows(values, "n int, many string, few string, flag boolean")
    assert categorical_columns(frame) == ["few", "flag"]


def test_missing_share_is_not_rounded_before_the_test(rows):
    values = [(None if i < 499 else 1, None if i < 500 else 1) for i in range(10000)]
    got = missing_columns(rows(values, "a int, b int")).collect()
    assert [(r["column"], r["pct"]) for r in got] == [("b", 5.0)]


def test_duplicate_rows(rows):
    values = [(1, None), (1, None), (None, 1), (2, "a"), (2, "a"), (2, "a"), (3, "b")]
    values = [(a, None if b is None else str(b)) for a, b in values]
    frame = rows(values, "a int, b string")
    got = duplicate_rows(frame).first()["duplicate_rows"]
    assert got == 3


def test_no_rows_no_duplicates(rows):
    assert duplicate_rows(rows([], "a int")).first()["duplicate_rows"] == 0


# --- contradictions


def tilted(rows, gaps=False):
    values = []
    for i in range(200):
        b = 200.0 - i if i % 5 == 0 else float(i)
        values.append((i, float(i), None if gaps and i % 9 == 0 else b, 5.0))
    return rows(values, "id int, a double, b double, same double")


@pytest.mark.parametrize("gaps", [False, True])
def test_correlations(rows, gaps):
    frame = tilted(rows, gaps)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in c.correlations(frame, measure(frame)).collect()}
    pairs = [(r["a"], r["b"]) for r in frame.collect() if r["b"] is not None]
    assert got["a", "b"] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1])
    assert got["a", "same"] is None and got["b", "same"] is None


def test_contradictions(rows):
    frame = tilted(rows)
    found = c.contradictions(frame, measure(frame))
    pairs = [(f.col_a, f.col_b, f.direction) for f in found]
    assert ("a", "b", "high") in pairs or ("a", "b", "low") in pairs
    first = found[0]
    assert frame.where(first.predicate).count() == first.count
    assert len({(f.col_a, f.col_b) for f in found}) == len(found)


def test_too_little_data_has_no_contradictions(rows):
    frame = rows([(float(i), float(i)) for i in range(9)], "a double, b double")
    assert c.contradictions(frame, measure(frame)) == []


def test_row_order_and_partitions_change_nothing(rows):
    frame = tilted(rows)
    shuffled = frame.repartition(7).orderBy(F.rand(3))
    one = c.contradictions(frame, measure(frame))
    two = c.contradictions(shuffled, measure(shuffled))
    # Sums taken in another order may differ in the last digit of r.
    assert [f.r for f in one] == pytest.approx([f.r for f in two])
    assert [(f.predicate, f.count) for f in one] == [(f.predicate, f.count) for f in two]


# --- group against rest


def test_unknown_rows_belong_to_the_rest(rows):
    frame = rows([(1.0, 10.0), (None, 20.0), (5.0, 60.0)], "k double, v double")
    got = compare_groups(frame, {"g": "k >= 5"}, ["v"]).first()
    assert (got["group_size"], got["group_mean"], got["rest_mean"], got["diff_pct"]) == (1, 60.0, 15.0, 300.0)


def test_nothing_to_compare_with(rows):
    frame = rows([(0.0,), (0.0,)], "v double")
    got = compare_groups(frame, {"g": "v > 5"}, ["v"]).first()
    assert (got["group_size"], got["group_mean"], got["diff_pct"]) == (0, 0.0, 0.0)


def test_evidence_and_factor(rows):
    values = [(float(i), 1.0 if i < 5 else 2.0, 10.0, 3.0 if i < 5 else 1.0) for i in range(10)]
    frame = rows(values, "a double, b double, flat double, other double")
    pairs = {"g": ("b", "a")}
    compared = compare_groups(frame, {"g": "a < 5"}, ["a", "b", "flat", "other"])
    lines = [r["variable"] for r in evidence(compared, pairs, extra=1).orderBy("place").collect()]
    assert lines == ["b", "a", "flat"]
    best = contributing_factor(compared, pairs).first()
    assert (best["variable"], best["diff_pct"]) == ("other", 200.0)


# --- segments


def test_segments(rows):
    values = [(g, v, v) for g, v in [("a", 1.0), ("b", 2.0), ("c", 1.0)] for _ in range(3)]
    values += [(None, 50.0, 50.0)]
    frame = rows(values, "grp string, sales double, delay double")
    stats = measure(frame, quartiles=False)
    means = segments.group_means(frame, segments.judged_columns(stats), ["grp"])
    got = {r["number"]: r for r in segments.segment_gaps(means, stats).collect()}
    assert got["sales"]["worst"] == "a" and got["delay"]["worst"] == "b"
    assert got["sales"]["spread_pct"] == round(1 / (62 / 10) * 100, 1)


def test_small_or_many_groups_are_no_segments(rows):
    values = [("a", f"g{i % 9}", float(i)) for i in range(27)] + [("b", "g0", 0.0)] * 2
    frame = rows(values, "small string, many string, x double")
    means = segments.group_means(frame, ["x"], ["small", "many"])
    assert means.count() == 0


def test_skipped_names(rows):
    frame = rows([(1.0, 2.0, 3.0)], "unit_price double, width double, score double")
    assert segments.judged_columns(measure(frame, quartiles=False)) == ["score"]


# --- quality


def test_quality(rows):
    values = [(i, 50.0, 30.0, 3.0, 1.0 if i else 500.0) for i in range(60)]
    values[3] = (3, 147.0, 30.0, 3.0, 1.0)
    values[4] = (4, -1.0, 130.0, 6.0, 1.0)
    frame = rows(values, "k int, attendance double, age double, rating double, load double")
    got = quality.quality_issues(frame, measure(frame), "k").collect()
    named = [(r["column"], r["rule"], r["bad_rows"], list(r["examples"])) for r in got]
    assert named == [
        ("attendance", "range", 2, [147.0, -1.0]),
        ("age", "age", 1, [130.0]),
        ("rating", "extreme", 1, [6.0]),
        ("load", "extreme", 1, [500.0]),
    ]


def test_stars_out_of_five(rows):
    frame = rows([(i, 4.0 if i else 0.5) for i in range(10)], "k int, rating double")
    got = quality.quality_issues(frame, measure(frame), "k").first()
    assert (got["column"], got["rule"], list(got["examples"])) == ("rating", "range", [0.5])


def test_copies_and_constants(rows):
    frame = rows([(1, "x", None)] * 3, "k int, t string, gap string")
    got = quality.quality_issues(frame, measure(frame), "k").collect()
    assert [(r["column"], r["bad_rows"]) for r in got] == [
        ("(rows)", 2), ("k", 3), ("t", 3), ("gap", 3),
    ]


def test_issue_list_stops_at_six(rows):
    frame = rows([(1,) * 8], ", ".join(f"c{i} int" for i in range(8)))
    stats = measure(frame)
    assert quality.quality_issues(frame, stats, "c0").count() == 6
    assert quality.quality_issues(frame, stats, "c0", most=None).count() == 8


# --- keys


def test_keys(rows):
    values = [(i, i if i else 1, f"n{i if i > 1 else 0}", i % 3) for i in range(40)]
    frame = rows(values, "plain int, ref int, title string, kind int")
    got = keys.key_columns(frame).orderBy("ordinal").collect()
    # `title` has no telling name, but is nearly unique with only two repeated rows.
    assert [(r["column"], r["repeated_rows"]) for r in got] == [("ref", 2), ("title", 2)]
    shown = keys.key_examples(frame, ["ref", "title"]).orderBy("column").collect()
    assert [r["example"] for r in shown] == ["1 ×2", "n0 ×2"]


# --- formulas


def sheet(rows, n=60, breaks=(3, 7)):
    values = [
        (f"r{i}", float(i % 7 + 1), float(i * 3 % 11 + 2), 0.0 if i % 5 else 4.0) for i in range(n)
    ]
    full = [(k, a, b, z, a * b + (500 if i in breaks else 0)) for i, (k, a, b, z) in enumerate(values)]
    return rows(full, "k string, a double, b double, z double, total double")


def test_formulas(rows):
    frame = sheet(rows)
    names = ["a", "b", "z", "total"]
    found = formulas.formula_rules(frame, measure(frame), names)
    rules = {r["rule"]: r["violations"] for r in found.collect()}
    assert rules["total ≈ a × b"] == 2 and rules["total ≈ b × a"] == 2
    kept = formulas.ranked_rules(frame, found, names)
    assert [r["violations"] for r in kept] == [2]
    rule = [r for r in formulas.candidates(names) if r.text == "total ≈ a × b"]
    shown = formulas.violation_examples(formulas.violating_rows(frame, rule, names, "k"))
    assert [(r["label"], r["recorded"] - r["expected"]) for r in shown.orderBy("place").collect()] == [
        ("row r3", 500.0), ("row r7", 500.0),
    ]


def test_formula_counts_cover_every_row(rows):
    """A rule that holds for 98 % of 30,000 rows, all of whose breaks stand at the end."""
    frame = sheet(rows, 30_000, range(29_400, 30_000)).repartition(5)
    names = ["a", "b", "z", "total"]
    found = formulas.formula_rules(frame, measure(frame), names).collect()
    counted = {r["rule"]: (r["valid_rows"], r["violations"]) for r in found}
    assert counted["total ≈ a × b"] == (30_000, 600)


def test_division_by_zero_is_not_checked(rows):
    frame = sheet(rows, breaks=())
    rule = [r for r in formulas.candidates(["a", "z", "total"]) if r.text == "total ≈ a ÷ z"]
    broken = formulas.violating_rows(frame, rule, ["a", "z", "total"], "k")
    assert broken.count() == 12


def test_search_order():
    names = ["p", "q", "r"]
    listed = formulas.candidates(names)
    assert listed[0].text == "r ≈ p + q"
    assert [f.number for f in listed] == sorted(f.number for f in listed)
    assert all(formulas.formula_at(f.number, names) == f for f in listed)
    assert formulas.mirrored(listed[0], names).text == "r ≈ q + p"


def test_predicate_and_search_agree(rows):
    frame = sheet(rows)
    for rule in formulas.candidates(["a", "b", "total"]):
        by_search = formulas.violating_rows(frame, [rule], ["a", "b", "total"], "k").count()
        assert frame.where(rule.predicate()).count() == by_search


# --- row scores


def test_zscore_scores(rows):
    values = [(i, float(i % 5), None if i % 4 else 1.0) for i in range(40)] + [(40, 90.0, 1.0)]
    frame = rows(values, "k int, x double, flat double")
    stats = measure(frame, ["x", "flat"])
    scored = score_rows(frame, stats, "k", method=ZSCORE)
    got = {r["k"]: r for r in scored.collect()}
    expected = (90 - stats["x"].mean) / stats["x"].std
    assert got[40]["anomaly_zmax"] == pytest.approx(expected) and got[40]["anomaly_score"] == 1.0
    assert [k for k, r in got.items() if r["is_anomaly"]] == [40]
    top = top_rows(scored, "k").collect()
    assert [r["k"] for r in top] == [40]
    assert anomaly_summary(scored, ZSCORE).first()["anomaly_pct"] == 2.4


def test_rescue_flags_the_top_rows(rows):
    frame = rows([(i, 0.0 if i else 1.0) for i in range(8)] + [(8, 0.0)], "k int, x double")
    scored = score_rows(frame, measure(frame), "k", ["x"], ZSCORE)
    assert [r["k"] for r in scored.where("is_anomaly").collect()] == [0]


def test_no_rescue_of_even_rows(rows):
    frame = rows([(i, float(i % 2)) for i in range(40)], "k int, x double")
    assert score_rows(frame, measure(frame), "k", ["x"], ZSCORE).where("is_anomaly").count() == 0


def test_constants_score_nothing(rows):
    frame = rows([(i, 3.0) for i in range(12)], "k int, x double")
    got = score_rows(frame, measure(frame), "k", ["x"], ZSCORE).agg(F.max("anomaly_score")).first()[0]
    assert got == 0.0


def cloud(rows, n=1200, odd=6):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(n, 3))
    points[:odd] += 9
    return rows([(i, *map(float, p)) for i, p in enumerate(points)], "k int, x double, y double, z double")


def test_forest_finds_planted_outliers(rows):
    frame = cloud(rows)
    scored = score_rows(frame, measure(frame, ["x", "y", "z"]), "k", method=FOREST)
    top = {r["k"] for r in scored.orderBy(F.desc("anomaly_score")).limit(6).collect()}
    assert top == set(range(6))
    flagged = scored.where("is_anomaly").count()
    assert flagged == pytest.approx(1200 * contamination(1200), abs=2)


def test_forest_repeats_itself_on_other_partitions(rows):
    frame = cloud(rows, 300)
    stats = measure(frame, ["x", "y", "z"])
    one = score_rows(frame, stats, "k", method=FOREST).orderBy("k").collect()
    two = score_rows(frame.repartition(5), stats, "k", method=FOREST).orderBy("k").collect()
    assert [r["anomaly_score"] for r in one] == pytest.approx([r["anomaly_score"] for r in two])


def test_forest_on_a_table_large_enough_for_one_tree_per_row(spark):
    odd = F.col("k") % 200 == 0
    frame = spark.range(60000).select(F.col("id").alias("k")).repartition(3)
    frame = frame.select(
        "k",
        (F.when(odd, 50.0).otherwise(0.0) + F.pmod(F.xxhash64("k"), F.lit(1000)) / 500).alias("x"),
        (F.when(odd, 50.0).otherwise(0.0) + F.pmod(F.hash("k"), F.lit(1000)) / 500).alias("y"),
    )
    scored = score_rows(frame, measure(frame, ["x", "y"]), "k", method=FOREST)
    top = {r["k"] for r in scored.orderBy(F.desc("anomaly_score"), "k").limit(300).collect()}
    assert top == set(range(0, 60000, 200))


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_contamination_bounds():
    assert [contamination(n) for n in (10, 180, 10**9)] == [0.15, 20 / 180, 0.03]


# --- clusters


def blobs(rows, n=300):
    draw = np.random.default_rng(2)
    centre = np.where(np.arange(n) % 10 < 6, 0.0, np.where(np.arange(n) % 10 < 9, 20.0, 60.0))
    points = centre[:, None] + draw.normal(size=(n, 2)) + 10
    return rows([(i, *map(float, p)) for i, p in enumerate(points)], "k int, x double, y double")


def test_clusters(rows):
    frame = blobs(rows)
    stats = measure(frame, ["x", "y"])
    fitted = fit_clusters(frame, stats, ["x", "y"], restarts=3)
    assert fitted.settled
    profile = cluster_profile(frame, fitted.label, ["x", "y"], stats.rows)
    members = {r["cluster"]: r["members"] for r in profile.collect()}
    assert members == {0: 180, 1: 90, 2: 30}
    best = hidden_subgroup(profile, stats).first()
    assert (best["cluster"], best["members"]) == (2, 30)


def test_clusters_of_few_different_rows(spark):
    # Three groups far apart, each of nine points that 3,000 rows share.
    place = F.col("id") % 27
    group = (place / 9).cast("int")
    frame = spark.range(81_000).select(
        (F.when(group == 1, 1000.0).when(group == 2, 500.0).otherwise(0.0) + place % 3).alias("x"),
        (F.when(group == 2, 866.0).otherwise(0.0) + (place / 3).cast("int") % 3).alias("y"),
    )
    stats = measure(frame, ["x", "y"])
    fitted = fit_clusters(frame, stats, ["x", "y"])
    profile = cluster_profile(frame, fitted.label, ["x", "y"], stats.rows)
    assert {r["cluster"]: r["members"] for r in profile.collect()} == {0: 27_000, 1: 27_000, 2: 27_000}


def test_starting_centres_come_from_all_rows(spark):
    n = F.col("id")
    # One point holds nearly all rows; the two others are rare.
    value = F.when(n == 7_777, 50.0).when(n % 5_000 == 1, -20.0).otherwise(1.0)
    drawn = spark.range(20_000).select(value.alias("f0"), value.alias("f1"), F.xxhash64("id").alias("row"))
    starts = spread_out(drawn, 3, 10)
    assert all(sorted(c[:, 0].tolist()) == [-20.0, 1.0, 50.0] for c in starts)
    assert np.array_equal(starts, spread_out(drawn.repartition(7), 3, 10))
    only = drawn.where("f0 < 0").unionAll(drawn.where("f0 = 50"))
    assert all(set(c[:, 0]) == {-20.0, 50.0} for c in spread_out(only, 3, 5))


def test_starting_centres_are_drawn_by_squared_distance(spark):
    value = F.when(F.col("id") % 2 == 0, 0.0).when(F.col("id") % 4 == 1, 1.0).otherwise(3.0)
    drawn = spark.range(8_000).select(value.alias("f0"), F.lit(0.0).alias("f1"), F.xxhash64("id").alias("row"))
    starts = spread_out(drawn, 2, 400)[:, :, 0]
    first = [(starts[:, 0] == v).mean() for v in (0.0, 1.0, 3.0)]
    assert np.allclose(first, [0.5, 0.25, 0.25], atol=0.08)
    after = starts[starts[:, 0] == 0.0, 1]
    assert abs((after == 3.0).mean() - 0.9) < 0.08


def test_rounds_read_few_packed_rows(rows, monkeypatch):
    """A round hands blocks to Python, not single rows, and moves centres as plain loops do."""
    frame = blobs(rows)
    seen, plain = [], clusters.one_round

    def watched(cells, centres):
        moved, costs = plain(cells, centres)
        seen.append((cells.count(), centres.copy(), moved, costs))
        return moved, costs

    monkeypatch.setattr(clusters, "one_round", watched)
    stats = measure(frame, ["x", "y"])
    fitted = fit_clusters(frame, stats, ["x", "y"], restarts=3)
    points = np.array(frame.select(*fitted.features).collect())
    for blocks, centres, moved, costs in seen:
        assert blocks <= 16
        apart = ((points[:, None, None] - centres) ** 2).sum(3)
        label = apart.argmin(2)
        assert np.allclose(costs, apart.min(2).sum(0))
        for r, c in np.ndindex(centres.shape[:2]):
            own = points[label[:, r] == c]
            assert np.allclose(moved[r, c], own.mean(0) if len(own) else centres[r, c])


def test_rows_between_centres_belong_to_the_first():
    near = np.array([[[True, False, True, False], [True, True, True, False], [False, True, True, False]]])
    assert clusters.first_of(near).argmax(1).tolist() == [[0, 1, 0, 0]]
    assert near.sum(1).tolist() == [[1, 1, 1, 1]]


def test_too_few_rows_for_clusters(rows):
    frame = rows([(float(i), float(i)) for i in range(11)], "x double, y double")
    assert fit_clusters(frame, measure(frame), ["x", "y"]) is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["a", "b", None])), max_size=30))
def test_counts_add_up(spark, values):
    frame = spark.createDataFrame(values, "n int, t string")
    for row in column_counts(value_counts(frame)).collect():
        name = frame.columns[row["ordinal"]]
        present = [v for v in (dict(zip(frame.columns, r))[name] for r in values) if v is not None]
        assert row["distinct_values"] == len(set(present))
        assert row["missing"] == len(values) - len(present)
        assert row["repeated_rows"] == sum(present.count(v) > 1 for v in present)


def test_ledger_of_violations(rows):
    rng = random.Random(4)
    values = []
    for i in range(400):
        a, b, c = (float(rng.randrange(1, 50)) for _ in range(3))
        total, product = a + b, b * c
        if i % 9 == 0:
            total += 500
        if i % 6 == 0:
            product += 700
        values.append((i, a, b, c, None if i % 50 == 7 else total, None if i % 40 == 3 else product))
    frame = rows(values, "k int, a double, b double, c double, total double, product double").repartition(5)
    names = ["a", "b", "c", "total", "product"]
    rules = [r for r in formulas.candidates(names) if (r.c, r.op) in (("total", "+"), ("product", "×"), ("a", "−"))]
    broken = {r.number: {x["k"] for x in frame.where(r.predicate()).select("k").collect()} for r in rules}
    want = {
        (x, y): len(broken[x] & broken[y]) for x in broken for y in broken if broken[x] & broken[y]
    }
    ledger = formulas.violation_ledger(frame, rules)
    assert {(r["rule_a"], r["rule_b"]): r["rows"] for r in ledger.collect()} == want
    listed = formulas.violating_rows(frame, rules, names, "k").select("rule_no", "row_id").collect()
    assert {(r[0], r[1]) for r in listed} == {(n, k) for n, ks in broken.items() for k in ks}
    assert formulas.violation_ledger(frame.limit(0), rules).collect() == []
    assert formulas.violation_ledger(frame, []).collect() == []


def test_ledger_is_one_scan_and_rows_are_not_multiplied(rows):
    frame = rows([(1, 1.0, 2.0, 3.0)], "k int, a double, b double, c double")
    rules = formulas.candidates(["a", "b", "c"])
    for result in (formulas.violation_ledger(frame, rules), formulas.violating_rows(frame, rules, [], "k")):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Generate" not in plan


def test_group_tables_of_all_categories_in_one_pass(rows):
    rng = random.Random(9)
    values = [
        (i, rng.choice(["x", "y", None]), rng.choice("abcdefghijk"), rng.choice([True, False]),
         rng.choice([None, float("nan"), 1.5, 2.5, 1e9]), i % 7)
        for i in range(600)
    ]
    frame = rows(values, "k int, g string, many string, flag boolean, v double, w int").repartition(6)
    means = segments.group_means(frame, ["v", "w"], ["g", "many", "flag"])
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    want = {}
    for at, name in ((1, "g"), (3, "flag")):
        for group in {r[at] for r in values} - {None}:
            mine = [r for r in values if r[at] == group]
            for number, place in (("v", 4), ("w", 5)):
                held = [r[place] for r in mine if r[place] is not None and r[place] == r[place]]
                want[name, str(group).lower(), number] = (len(mine), pytest.approx(sum(held) / len(held)))
    assert {(r["category"], r["grp"], r["number"]): (r["size"], r["mean"]) for r in means.collect()} == want
    assert segments.group_means(frame.limit(0), ["v"], ["g"]).collect() == []
    alone = frame.withColumn("v", F.when(F.col("g") == "x", F.col("v")))
    kept = {r["grp"]: r["mean"] for r in segments.group_means(alone, ["v"], ["g"]).collect()}
    assert kept["y"] is None and kept["x"] is not None


def test_header_score_looks_at_each_cell_once(rows):
    from undertow.operators.ingest import header_score

    table = rows([("Total", "$1,200", " ", "inf"), ("Name", "Unit", None, "n/a")], "a string, b string, c string, d string")
    score = header_score(table, table.columns)
    assert str(score).upper().count("RLIKE") <= 6 * len(table.columns)
    assert [r[0] for r in table.select(score).collect()] == [None, 7.5]


def test_layouts_are_tried_once_on_equal_cells(spark, monkeypatch):
    from undertow.functions.vocabulary import DATE_FORMATS
    from undertow.operators import ingest

    tried, real = spark.sparkContext.accumulator(0), ingest.date_from_text

    def counted(c, layout):
        def note(cell):
            tried.add(1)
            return cell

        return real(F.udf(note, "string")(c), layout)

    monkeypatch.setattr(ingest, "date_from_text", counted)
    days = spark.range(400).selectExpr("if(id % 4 = 0, '2024-01-31', '2024-02-01') AS day")
    assert ingest.date_formats(days, ["day"]) == {"day": ("yyyy-M-d", 400)}
    assert tried.value <= 4 * len(DATE_FORMATS)
