from __future__ import annotations

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from undertow.operators.ingest import repair
from undertow.sources import quoted
from undertow.sources.readers import read_table
from undertow.sources.sniff import folder_formats
from undertow.sources.validate import UnusableTable, check_usable, is_binary

BODY = "".join(f"k{i},{i},{'ab'[i % 2]}\n" for i in range(20))


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv(spark, tmp_path):
    table = read_table(spark, put(tmp_path / "a.csv", "key,value,kind\n" + BODY)).table
    assert table.columns == ["key", "value", "kind"] and table.count() == 20


def test_title_rows_of_different_height_in_one_folder(spark, tmp_path):
    head = "key,value,kind\n"
    put(tmp_path / "t" / "a.csv", "Sales report,,\n,,\n" + head + BODY)
    put(tmp_path / "t" / "b.csv", "Another,,\n" + head + BODY)
    loaded = read_table(spark, str(tmp_path / "t"))
    assert loaded.table.columns == ["key", "value", "kind"]
    assert loaded.table.count() == 40
    assert loaded.log[0][1] == "header"
    fixed = repair(loaded.table, loaded.log)
    assert dict(fixed.table.dtypes)["value"] == "double"


def test_many_blocks_keep_their_lines(spark, tmp_path):
    head = "Report,,\n,,\nkey,value,kind\n"
    body = "".join(f"k{i},{i},x\n" for i in range(5000))
    for name in ("a", "b"):
        put(tmp_path / "big" / f"{name}.csv", head + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        table = read_table(spark, str(tmp_path / "big")).table
        assert table.count() == 10000
        assert table.agg(F.sum(F.col("value").cast("long"))).first()[0] == 2 * sum(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_long_lines_are_skipped_and_short_ones_filled(spark, tmp_path):
    lines = ["a,b", "1,2", *[f"{i},{i}" for i in range(30)], "1,2,3", "7"]
    table = read_table(spark, put(tmp_path / "a.csv", "\n".join(lines) + "\n")).table
    assert table.count() == 32
    assert table.where("a = '7' AND b IS NULL").count() == 1


def test_latin1(spark, tmp_path):
    path = put(tmp_path / "a.csv", "name,n\ncafé,1\nthé,2\n", "latin-1")
    assert {r["name"] for r in read_table(spark, path).table.collect()} == {"café", "thé"}


def test_tab_and_guessed_separators(spark, tmp_path):
    tabs = put(tmp_path / "a.tsv", "a\tb\n1\t2\n")
    pipes = put(tmp_path / "b.txt", "a|b\n1|x, y\n")
    assert read_table(spark, tabs).table.first() == ("1", "2")
    assert read_table(spark, pipes).table.first() == ("1", "x, y")


def test_quotes_and_doubled_quotes(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'a,b\n"x, ""y""",2\n')
    assert read_table(spark, path).table.first() == ('x, "y"', "2")


def test_json_layouts(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    paths = {
        "records": json.dumps(records, indent=1),
        "table": json.dumps({"columns": ["a", "b"], "data": [[1, "x"], [2, "y"]]}),
        "lists": json.dumps({"a": [1, 2], "b": ["x", "y"]}),
    }
    for name, text in paths.items():
        table = read_table(spark, put(tmp_path / f"{name}.json", text)).table
        got = sorted((int(r["a"]), r["b"]) for r in table.collect())
        assert got == [(1, "x"), (2, "y")], name


def test_formats_of_a_mixed_folder(spark, tmp_path):
    put(tmp_path / "m" / "a.csv", "a,b\n")
    put(tmp_path / "m" / "noext", '  {"a": 1}')
    put(tmp_path / "m" / "sheet.csv", "PK\x03\x04rest")
    put(tmp_path / "m" / "odd.doc", "text")
    spark.range(3).write.parquet(str(tmp_path / "m" / "p"))
    found = {
        r["path"].rsplit("/", 1)[1].split("-")[0]: (r["format"], r["supported"])
        for r in folder_formats(spark, str(tmp_path / "m")).where("path NOT LIKE '%_SUCCESS'").collect()
    }
    assert found == {
        "a.csv": ("csv", True), "noext": ("json", True), "sheet.csv": ("xlsx", True),
        "odd.doc": ("doc", False), "part": ("parquet", True),
    }


def test_parquet_under_a_wrong_name(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    wrong = tmp_path / "data.csv"
    wrong.write_bytes(part.read_bytes())
    assert read_table(spark, str(wrong), row_id="key").table.count() == 5


def test_unusable_input(spark, tmp_path):
    with pytest.raises(UnusableTable):
        read_table(spark, put(tmp_path / "empty.csv", "\n"))
    with pytest.raises(UnusableTable):
        read_table(spark, put(tmp_path / "a.xlsx", "PK\x03\x04"))
    with pytest.raises(UnusableTable):
        read_table(spark, put(tmp_path / "a.doc", "text"))
    with pytest.raises(UnusableTable):
        check_usable(spark.createDataFrame([], "a string"))
    garbage = "\x01\x02\x03\x04\x05\x06"
    with pytest.raises(UnusableTable):
        check_usable(spark.createDataFrame([(garbage, "a\x00")] * 3, "a string, b string"))
    check_usable(spark.createDataFrame([("text", "more")], "a string, b string"))


def test_binary_cells(spark):
    cases = {"plain": False, "a\x00b": True, "\x01\x02\x03": False, "\x01\x02\x03\x04": True, "": False}
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = frame.select("i", is_binary(F.col("c")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got] == list(cases.values())


def cells(loaded):
    return sorted(tuple(row) for row in loaded.table.collect())


def test_quoted_line_breaks(spark, tmp_path):
    loaded = read_table(spark, put(tmp_path / "q.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n'))
    assert cells(loaded) == [("1", "two\nlines"), ("2", 'say "hi"')]


def test_long_lines_are_counted(spark, tmp_path):
    loaded = read_table(spark, put(tmp_path / "l.csv", "a,b\n1,x\n2,y,z\n" + "3,w\n" * 30 + "4,v,u\n"))
    assert loaded.table.columns == ["a", "b"] and loaded.table.count() == 31
    assert [note[1:] for note in loaded.log] == [("long lines", None, "2 line(s) with more than 2 fields left out")]


@pytest.mark.parametrize("titled", ["a", "b", ""])
def test_titled_and_plain_files_of_a_folder(spark, tmp_path, titled):
    for name in "ab":
        title = "Report of the year,,\n,,\n" if name == titled else ""
        body = "".join(f"{name}{i},{i},x\n" for i in range(20))
        put(tmp_path / "f" / f"{name}.csv", f"{title}key,value,kind\n{body}")
    loaded = read_table(spark, str(tmp_path / "f"))
    assert loaded.table.columns == ["key", "value", "kind"]
    assert cells(loaded) == sorted((f"{n}{i}", str(i), "x") for n in "ab" for i in range(20))


def test_files_with_other_column_orders(spark, tmp_path):
    put(tmp_path / "o" / "a.csv", "key,value\nk1,1\nk2,2\n")
    put(tmp_path / "o" / "b.csv", "value,key\n3,k3\n4,k4\n")
    loaded = read_table(spark, str(tmp_path / "o"))
    assert cells(loaded.__class__(loaded.table.select("key", "value"))) == [(f"k{i}", str(i)) for i in range(1, 5)]
    put(tmp_path / "o" / "c.csv", "key,other\nk5,5\n")
    with pytest.raises(UnusableTable, match="other"):
        read_table(spark, str(tmp_path / "o"))


def test_folders_of_json_documents(spark, tmp_path):
    put(tmp_path / "d" / "a.json", '{"columns": ["a", "b"], "data": [[1, "x"], [2, "y"]]}')
    put(tmp_path / "d" / "b.json", '{"columns": ["b", "a"], "data": [["z", 3]]}')
    table = read_table(spark, str(tmp_path / "d"), kind="json").table
    assert sorted((int(r["a"]), r["b"]) for r in table.collect()) == [(1, "x"), (2, "y"), (3, "z")]
    put(tmp_path / "e" / "a.json", '{"a": [1, 2], "b": ["x", "y"]}')
    put(tmp_path / "e" / "b.json", '{"a": [3], "b": ["z"]}')
    table = read_table(spark, str(tmp_path / "e"), kind="json").table
    assert sorted((r["a"], r["b"]) for r in table.collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_long_lines_stand_in_several_files(spark, monkeypatch):
    from registry import sources

    paths, read = [], sources.read_table
    monkeypatch.setattr(sources, "read_table", lambda s, path, kind: paths.append(path) or read(s, path, kind))
    folder = "/root/testdata/sf0.001"
    found = sources.read_csv_long_lines(spark, folder).first()
    assert spark.read.text(paths[0]).select("_metadata.file_path").distinct().count() > 1
    stray = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderkey % 97 = 0").count()
    total = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert (found["kept"], found["left_out"]) == (total - stray, stray)


def test_files_wider_than_the_first(spark, tmp_path):
    put(tmp_path / "w" / "a.csv", "x,y\n1,2\n3,4\n")
    put(tmp_path / "w" / "b.csv", "Report,,,\n,,,\nz,x,y,u\n5,6,7,8\n9,10,11,12\n13,14,15,16,17\n")
    put(tmp_path / "w" / "c.csv", "y,x\n18,19\n20,21,22\n")
    loaded = read_table(spark, str(tmp_path / "w"))
    assert loaded.table.columns == ["z", "x", "y", "u"]
    assert {tuple(r) for r in loaded.table.collect()} == {
        (None, "1", "2", None), (None, "3", "4", None), ("5", "6", "7", "8"), ("9", "10", "11", "12"),
        (None, "19", "18", None),
    }
    assert [note[3] for note in loaded.log if note[1] == "long lines"] == [
        "2 line(s) with more than their header's fields left out"
    ]
    put(tmp_path / "w" / "d.csv", "x,other\n1,2\n")
    with pytest.raises(UnusableTable, match="d.csv.*other"):
        read_table(spark, str(tmp_path / "w"))


def test_separators_of_each_file(spark, tmp_path):
    for name, sep in zip("abcd", ",;|\t"):
        put(tmp_path / "s" / f"{name}.txt", f"key{sep}value\n{name}{sep}1\n")
    table = read_table(spark, str(tmp_path / "s")).table
    assert sorted(map(tuple, table.collect())) == [(name, "1") for name in "abcd"]


def messy_records(rng, n):
    parts = ['"', "\n", "\r\n", ",", "x", "word ", '""', ";"]
    return [[f"{i}", "".join(rng.choices(parts, k=rng.randrange(12))), rng.choice(["", "plain", 'stray " mark'])]
            for i in range(n)]


@pytest.mark.parametrize("seed, block", [(1, "700"), (2, "64m")])
def test_quoted_line_breaks_across_blocks(spark, tmp_path, seed, block):
    rng = random.Random(seed)
    want = []
    for name in ("a", "b"):
        rows = messy_records(rng, 120)
        rows[40][1] = "a long cell\n" * 200
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerows([["key", "value", "kind"], *rows])
        # A quote inside an unquoted cell is text.
        text = out.getvalue().replace('"stray "" mark"', 'stray " mark')
        put(tmp_path / "q" / f"{name}.csv", text)
        want += [tuple(cell or None for cell in row) for row in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        loaded = read_table(spark, str(tmp_path / "q"))
        assert loaded.table.columns == ["key", "value", "kind"]
        assert sorted(map(str, loaded.table.collect())) == sorted(
            f"Row(key={k!r}, value={v!r}, kind={x!r})" for k, v, x in want
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_blocks_of_a_quoted_file_are_parsed_by_several_tasks(spark, tmp_path):
    path = put(tmp_path / "m.csv", "a,b\n" + "".join(f'{i},"two\nlines"\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        parsed = quoted.parsed_blocks(spark, path, "UTF-8", ",", 13)
        assert parsed.where(f"kind = {quoted.RECORD}").select(F.spark_partition_id()).distinct().count() > 3
        both = parsed.where(f"kind = {quoted.RECORD}").groupBy("given").count().collect()
        extra = sum(r["count"] for r in both if r["given"] == quoted.INSIDE)
        assert extra <= parsed.select("_block").distinct().count()  # the readings soon agree
        assert read_table(spark, path).table.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_quote_left_open(spark, tmp_path):
    table = read_table(spark, put(tmp_path / "o.csv", 'a,b\n1,"x\ny"\n2,"never closed\n3,z\n')).table
    assert table.where("a = '1'").first()["b"] == "x\ny"


@pytest.mark.parametrize("line, state, after", [
    ('a,"b', 0, 1), ('a,"b"', 0, 0), ('a,"b""', 0, 1), ('a,"b"""', 0, 0), ('a, "b', 0, 0), ('5" x,"', 0, 1),
    ('b",c', 1, 0), ('b""', 1, 1), ('b"",c",d', 1, 0), ('b",""', 1, 0), ('b","', 1, 1), ("plain", 1, 1),
    ("plain", 0, 0), ('"",""', 0, 0), ('"', 0, 1), ('"', 1, 0), ('b"x"y,"z', 1, 1),
])
def test_states_of_lines(line, state, after):
    assert quoted.line_states(",")(line, state) == after


@pytest.mark.parametrize("cell, names", [("café", ["Größe", "Ort"]), ('"ca\nfé"', ["Größe", "Ort"])])
def test_folder_in_latin1(spark, tmp_path, cell, names):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_bytes(f"Größe,Ort\n{i},{cell}\n".encode("latin1"))
    table = read_table(spark, str(tmp_path), "csv").table
    assert table.columns == names
    assert sorted(map(tuple, table.collect())) == [(str(i), cell.strip('"')) for i in range(2)]


def test_files_of_a_thousand_orders_lie_in_one_folder(spark, tmp_path):
    from registry.sources import order_files

    orders = spark.range(3500).selectExpr(
        "id AS o_orderkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "DATE'2024-01-31' AS o_orderdate",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    path = order_files(spark, str(tmp_path), F.lit("Order Key"), F.col("Order Key"))
    shown = list(Path(path).glob("**/part-*"))
    assert len(shown) == 4 and {p.parent for p in shown} == {Path(path)}
    assert sum(len(p.read_text().split()) for p in shown) == 3500 + 4 * 2  # "Order Key" is two words


def test_heads_of_many_files_are_read_by_several_tasks(spark, tmp_path):
    from undertow.session import written
    from undertow.sources.readers import file_heads

    for i in range(24):
        (tmp_path / f"{i}.txt").write_text(f"a{';|'[i % 2]}b\n{i}{';|'[i % 2]}2\n")
    heads = written(file_heads(spark, str(tmp_path), "UTF-8", None))
    assert len(heads.inputFiles()) > 1
    assert {tuple(r) for r in heads.groupBy("separator").count().collect()} == {(";", 24), ("|", 24)}
