"""Plan shapes and large-table paths: what must hold when the table is far larger than here."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from undertow.operators import contradictions, keys, quality, segments
from undertow.operators.anomalies import ZSCORE, score_rows
from undertow.operators.contradictions import correlations
from undertow.operators.frequencies import (
    HEAD,
    column_counts,
    common,
    hashed_counts,
    top_values,
    value_counts,
)
from undertow.operators.statistics import measure
from undertow.plans import charts
from undertow.session import new_path, written

SMALL = "/root/testdata/sf0.001"
HOT = 3000


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value in every column but the key."""
    hot = F.col("id") < HOT
    frame = spark.range(3 * HOT).select(
        F.col("id").alias("k"),
        F.when(hot, 7.0).otherwise(F.col("id") * 37 % 1009 / 3).alias("x"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("t"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("g"),
    )
    return written(frame.repartition(6), "skewed")


def test_a_score_reads_only_its_columns(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    scored = score_rows(events, measure(events, ["value"]), "event_id", ["value"], ZSCORE)
    text = plan(scored.select("event_id", "anomaly_score"))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    assert "Exchange" not in text


def test_filters_reach_the_scan(spark):
    table = spark.read.parquet(f"{SMALL}/orders.parquet")
    stats = measure(table, ["o_totalprice"])
    rule = f"o_totalprice >= CAST('{stats['o_totalprice'].q75!r}' AS DOUBLE)"
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual" in plan(table.where(rule))


def test_top_values_are_cut_before_the_shuffle(skewed):
    text = plan(top_values(value_counts(skewed)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_long_texts_are_shuffled_as_hashes(spark):
    """Unique texts of 4,000 characters, a hot one among them, shuffle less than 200 bytes each."""
    hot = F.lit("h" * 4000)
    text = F.when(F.col("id") % 3 == 0, hot).otherwise(F.repeat(F.md5(F.col("id").cast("string")), 125))
    frame = written(spark.range(3 * HOT).select(text.alias("t")).repartition(6), "long-texts")
    counts = column_counts(hashed_counts(frame))
    got = counts.first()
    assert (got["distinct_values"], got["repeated_rows"]) == (2 * HOT + 1, HOT)
    steps = plan(hashed_counts(frame))
    assert "hashpartitioning(slot" in steps and "substring(value" in steps
    top = common(frame, ["t"], 2).orderBy("place").collect()
    assert [(r["value"][:1], len(r["value"]), r["freq"]) for r in top][:1] == [("h", 4000, HOT)]
    assert top[1]["value"] == frame.where("t < 'h'").agg(F.min("t")).first()[0]


def test_common_values_equal_a_full_count(spark):
    """Ties, texts that begin alike, gaps, texts around the cut, numbers and odd column names."""
    start = "b" * HEAD
    values = [None, "", "a", "b" * (HEAD - 1), start, start + "x", start + "w", start + "é", "z" * 90, "c"]
    table = [(values[i * i % 10], values[i % 7], i % 4 if i % 5 else None) for i in range(200)]
    table += [(start + str(i), start + "y" * i, 7) for i in range(20)]
    frame = spark.createDataFrame(table, "`odd.name` string, c1 string, n int")
    names = frame.columns
    for k, least in ((1, 1), (5, 1), (5, 2), (8, 2), (500, 1)):
        kept = value_counts(frame, names).where(F.col("freq") >= least)
        want = sorted(map(tuple, top_values(kept, k).select("ordinal", "value", "freq", "place").collect()))
        got = common(frame, names, k, least).select("ordinal", "value", "freq", "place")
        assert sorted(map(tuple, got.collect())) == want
    assert common(frame.limit(0), names).count() == 0


def test_rare_flags_are_drawn_on_any_partitioning(spark):
    """Three flagged rows among 9,000 all show, and the points do not depend on the partitions."""
    frame = spark.range(9000).select("id", F.col("id").alias("x"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("y"))
    rule = "id IN (4001, 5002, 8003, 7)"
    shown = []
    for parts in (1, 7):
        points = charts.scatter_sample(frame.repartition(parts), "x", "y", rule, "id", 100)
        assert "WindowGroupLimit" in plan(points)
        shown.append(sorted(map(tuple, points.collect())))
    assert shown[0] == shown[1] and len(shown[0]) == 53
    assert sum(flagged for *_, flagged in shown[0]) == 3
    assert charts.scatter_sample(frame, "x", "y", rule, "id", None).count() == frame.where("y IS NOT NULL").count()


def test_examples_are_cut_before_the_shuffle(skewed):
    rules = [quality.Rule("x", "range", "", "x > 1")]
    assert "WindowGroupLimit" in plan(quality.rule_examples(skewed, rules, "k"))


def test_hot_values_are_combined_before_the_shuffle(skewed):
    text = plan(value_counts(skewed))
    assert "partial_count" in text


def test_hot_values_are_counted_whole(skewed):
    got = {r["ordinal"]: r for r in column_counts(value_counts(skewed)).collect()}
    assert got[2]["distinct_values"] == 2 * HOT + 1 and got[2]["repeated_rows"] == HOT
    stats = measure(skewed, ["x"], direct_rows=0)
    assert stats["x"].median == measure(skewed, ["x"])["x"].median
    means = segments.group_means(skewed, ["x"], ["g"])
    assert means.agg(F.sum("size")).first()[0] == 3 * HOT
    assert keys.key_columns(skewed).count() == 0


def test_both_ways_to_correlate_agree(skewed, monkeypatch):
    frame = skewed.select("x", (F.col("x") * 2 + F.col("k") % 11).alias("y"), "k")
    stats = measure(frame)
    direct = {r["pair"]: r["r"] for r in correlations(frame, stats).collect()}
    monkeypatch.setattr(contradictions, "SUMS_PER_SCAN", 0)
    matrix = {r["pair"]: r["r"] for r in correlations(frame, stats).collect()}
    assert matrix == pytest.approx(direct)
    monkeypatch.setattr(contradictions, "TILE", 1)
    tiles = {r["pair"]: r["r"] for r in correlations(frame, stats).collect()}
    assert tiles == pytest.approx(direct)


@pytest.mark.parametrize("tile", [3, 4, 11, 12, 256])
def test_bands_of_columns_with_gaps(spark, monkeypatch, tile):
    """Any cut into bands gives each pair its own rows, as a plain correlation does."""
    rng = np.random.default_rng(5)
    cells = rng.normal(size=(200, 12)) + rng.normal(size=(200, 1))
    cells[rng.random(cells.shape) < 0.2] = np.nan
    cells[:, 4] = 3.0
    names = [f"c{i}" for i in range(12)]
    table = pd.DataFrame(cells, columns=names)
    frame = spark.createDataFrame(table).replace(float("nan"), None).repartition(3)
    monkeypatch.setattr(contradictions, "TILE", tile)
    monkeypatch.setattr(contradictions, "CELLS", 100)
    got = correlations(frame, measure(frame)).orderBy("pair").collect()
    pairs = list(combinations(names, 2))
    assert [(r["pair"], r["col_a"], r["col_b"]) for r in got] == [(i, *p) for i, p in enumerate(pairs)]
    want = table.corr(min_periods=2)
    for row in got:
        r = want.loc[row["col_a"], row["col_b"]]
        assert row["r"] is None if np.isnan(r) else row["r"] == pytest.approx(r)


def test_a_wide_table_in_bounded_memory(spark):
    """600 columns with gaps: 179,700 pairs, three bands."""
    wide = spark.range(40).select(
        *[F.when((F.col("id") + i) % 9 > 0, F.sin(F.col("id") * (i + 1))).alias(f"z{i}") for i in range(600)]
    )
    found = contradictions._matrix_correlations(wide, 600).where("a % 150 = 0 AND b % 150 = 1").collect()
    table = wide.toPandas()
    assert {(r["a"], r["b"]) for r in found} == {
        (a, b) for a in range(0, 600, 150) for b in range(1, 600, 150) if a < b
    }
    for row in found:
        assert row["r"] == pytest.approx(table[f"z{row['a']}"].corr(table[f"z{row['b']}"]))


def test_scratch_files_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x").startswith(folder + "/")


def test_task_code_travels_with_the_job():
    assert "undertow" in cloudpickle.list_registry_pickle_by_value()
