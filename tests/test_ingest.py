from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from undertow.functions.cells import number_from_text, reads_as_number, role_of, strip
from undertow.operators.ingest import needs_header_search, repair, unique_names


def one_column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = frame.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in got]


def test_numbers_in_text(spark):
    cases = {
        "$1,200": 1200.0, "72,000": 72000.0, "85%": 85.0, "(12)": -12.0, "€ 3.5": 3.5,
        "₹1,00,000": 100000.0, " 7 ": 7.0, "-4e2": -400.0, ".5": 0.5, "5.": 5.0, "(-5)": 5.0,
        "1d": None, "1.5f": None, "NaN": None, "Infinity": None, "0x1p3": None, "": None,
        "-": None, "N/A": None, "1-2": None, "12%%": 12.0, "abc": None, "+3": 3.0,
    }
    assert one_column(spark, list(cases), number_from_text) == list(cases.values())


def test_numeric_look(spark):
    cases = {
        "$1,200": True, "(12%)": True, "85%": True, "inf": True, "n/a": False, "none": False,
        "-": False, "": False, "Total": False, "1d": False, "3 4": False,
    }
    assert one_column(spark, list(cases), reads_as_number) == list(cases.values())


def test_strip_removes_every_kind_of_white_space(spark):
    cells = ["  a b ", "\ta ", "　x", "plain", ""]
    assert one_column(spark, cells, strip) == [c.strip() for c in cells]


def test_roles(spark):
    cases = {
        "Final_Result": "outcome", "Lab Marks": "driver", "Region": "segment", "Order_ID": "meta",
        "Price": "metric", "study_group": "driver", "final_month": "outcome",
    }
    assert one_column(spark, list(cases), role_of) == list(cases.values())


def test_names():
    assert unique_names([" a ", "", "a", None, "nan", "a"]) == [
        "a", "Column_2", "a_1", "Column_4", "Column_5", "a_2",
    ]


def test_names_spark_cannot_tell_apart():
    assert unique_names(["Name", "name", "a", "a_1", "a"]) == ["Name", "name_1", "a", "a_1", "a_2"]


def test_when_a_header_is_searched():
    assert needs_header_search(["Report", None, "", None])
    assert needs_header_search(["1", "2", "3"])
    assert not needs_header_search(["id", "name", None])


def test_repair(spark):
    values = [
        (f" n{i} ", f"${i},000", "N/A" if i % 2 else f"0{i % 9 + 1}/15/2024", None, "-")
        for i in range(12)
    ] + [(" ", "null", "", None, "NA")]
    frame = spark.createDataFrame(values, "` name ` string, pay string, day string, e string, f string")
    fixed = repair(frame)
    assert fixed.table.columns == ["name", "pay", "day"]
    got = fixed.table.orderBy("pay").collect()
    assert len(got) == 12
    assert got[2]["name"] == "n2" and got[2]["pay"] == 2000.0
    assert got[2]["day"] == dt.datetime(2024, 3, 15) and got[1]["day"] is None
    steps = [(r["step"], r["column"]) for r in fixed.log_frame().orderBy("seq").collect()]
    assert steps == [("padding", None), ("number", "pay"), ("date", "day")]


def test_text_that_is_only_half_numeric_stays_text(spark):
    frame = spark.createDataFrame([("1",), ("2",), ("x",), ("y",), ("3",), ("z",)], "c string")
    assert dict(repair(frame).table.dtypes)["c"] == "string"


def test_too_few_values_stay_text(spark):
    frame = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "c string")
    assert dict(repair(frame).table.dtypes)["c"] == "string"


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(1.0, 1), (float("nan"), 2)], "x double, i int")
    assert repair(frame).table.where("x IS NULL").count() == 1


def test_dates_of_a_sparse_column_are_found(spark):
    values = [(i, "2024-05-01" if i >= 300 else None) for i in range(310)]
    frame = spark.createDataFrame(values, "i int, d string")
    assert dict(repair(frame).table.dtypes)["d"] == "timestamp_ntz"


def test_month_names_stay_text(spark):
    frame = spark.createDataFrame([("January",), ("March",)] * 6, "month string")
    assert dict(repair(frame).table.dtypes)["month"] == "string"


def test_an_empty_row_changes_nothing(spark):
    values = [(f"{i}", "a") for i in range(8)]
    schema = "n string, t string"
    plain = repair(spark.createDataFrame(values, schema)).table
    padded = repair(spark.createDataFrame(values + [(" ", "N/A")], schema)).table
    assert sorted(plain.collect()) == sorted(padded.collect())
    assert plain.schema == padded.schema


def test_a_late_layout_decides_and_lost_cells_are_logged(rows):
    values = [("2024-01-05",)] * 25 + [("1/15/2024",)] * 2000
    fixed = repair(rows(values, "d string").repartition(3))
    assert fixed.table.where("d is not null").count() == 2000
    assert fixed.log == [(0, "date", "d", "2000 text cell(s) read as dates (M/d/yyyy), 25 emptied")]


@pytest.mark.parametrize("text", [
    "1/15/24", "2024-01-05 10:00:00.123", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00.5+02:00",
    "Jan 5 2024", "1/15/2024 3:05 PM", "12/31/2024 11:59:59 am", "5-Mar-2024",
])
def test_common_layouts(rows, text):
    table = repair(rows([(text,)] * 6, "d string")).table
    assert dict(table.dtypes)["d"] == "timestamp_ntz" and table.where("d is null").count() == 0


def test_nan_counts_as_missing_everywhere(rows):
    from undertow.operators.statistics import measure

    values = [(float(i),) for i in range(1, 21)] + [(float("nan"),)] * 10
    stats = measure(rows(values, "x double"))["x"]
    assert (stats.non_null, stats.mean, stats.median, stats.q75) == (20, 10.5, 10.5, 15.25)
