"""Read CSV, delimited text, JSON or Parquet, from one file or a folder of files of one layout."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions.cells import column
from undertow.operators.ingest import (
    HEADER_LINES,
    best_header,
    needs_header_search,
    unique_names,
)
from undertow.session import written
from undertow.sources.quoted import BLOCK, FILE, LINE, decoded, read_records
from undertow.sources.sniff import folder_formats
from undertow.sources.validate import UnusableTable, check_usable

SEPARATORS = (",", "\t", ";", "|")
HEAD_LINES = 20
EXTRA = "_extra_field"
#: Distinct headers that a folder may hold.
MOST_HEADERS = 1_000


@dataclass(frozen=True)
class Loaded:
    """A table as read, with notes on how its header was found."""

    table: DataFrame
    log: list[tuple[int, str, str | None, str]] = field(default_factory=list)


def text_facts(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The encoding, and whether a line ends inside quotes, from one look at every line.

    UTF-8 unless some line is not valid UTF-8; then Latin-1, which accepts every byte.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = spark.read.text(path).agg(
        F.max(~F.is_valid_utf8("value")).alias("broken"), F.max(quotes % 2 == 1).alias("open")
    ).first()
    return "ISO-8859-1" if found["broken"] else "UTF-8", bool(found["open"])


def head_lines(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """The first lines of one file: the first by name."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    return [row[0] for row in decoded(spark.read.text(files[0]), encoding).limit(HEAD_LINES).collect()]


def guess_separator(lines: list[str]) -> str:
    """The separator found most often in the first lines; a comma when there is none."""
    counts = {s: sum(line.count(s) for line in lines) for s in SEPARATORS}
    best = max(SEPARATORS, key=lambda s: counts[s])
    return best if counts[best] else ","


def file_heads(spark: SparkSession, path: str, encoding: str, separator: str | None) -> DataFrame:
    """file, line, separator and cells of the first lines of every file.

    Lines are numbered as the reader numbers them, without empty ones.
    """
    lines = decoded(spark.read.text(path), encoding).where("trim(value) <> ''")
    first = numbered_lines(lines.where("_metadata.file_block_start = 0"), HEAD_LINES)

    def look(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(LINE)
        lines = group["value"].tolist()
        own = separator or guess_separator(lines)
        rows = [next(csv.reader([line], delimiter=own), []) for line in lines]
        cells = [[cell or None for cell in row] for row in rows]
        return pd.DataFrame({FILE: group[FILE], LINE: group[LINE], "separator": own, "cells": cells})

    # An explicit number of partitions keeps the few lines of many files from being merged into one slow task.
    dealt = first.where(F.col(LINE).isNotNull()).select(FILE, LINE, "value").repartition(
        spark.sparkContext.defaultParallelism, FILE
    )
    return dealt.groupBy(FILE).applyInPandas(
        look, f"{FILE} string, {LINE} int, separator string, cells array<string>"
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    separator: str | None = ",",
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> Loaded:
    """Delimited text as string columns under the header of the file.

    Short lines are filled with NULL; lines with more fields than their file's header are left out, and
    the log says how many. Each file of a folder has its own header and, if none is given, its own
    separator: if its first line cannot be the header, the most header-like of the next ones is, and the
    title lines above it are left out. Files may order their columns differently, and leave out some of
    those of the widest file; a file with a column that the widest lacks is refused by name. Where quotes
    span lines, the blocks of a file are parsed side by side (see `quoted`); only a file that ends within
    quotes is read by one task.
    """
    found_encoding, open_quotes = text_facts(spark, path)
    encoding = encoding or found_encoding
    multi_line = open_quotes if multi_line is None else multi_line
    lines = [line for line in head_lines(spark, path, encoding) if line.strip()]
    if not lines:
        raise UnusableTable(f"No table in '{path}'")
    many = len(spark.read.text(path).inputFiles()) > 1
    if multi_line:
        loaded = read_quoted(spark, path, encoding, separator, lines)
        if loaded:
            return loaded
    if many:
        return read_folder(spark, path, encoding, separator, multi_line)
    separator = separator or guess_separator(lines)
    rows = list(csv.reader(lines, delimiter=separator))
    widths = [len(row) for row in rows]
    usual = max(set(widths), key=lambda width: (widths.count(width), width))
    first = rows[0] + [None] * (usual - len(rows[0]))
    titled = needs_header_search(first)
    width = usual if titled else len(rows[0])
    raw = raw_names(width)
    reader = delimited_reader(spark, separator, encoding, multi_line, raw)
    plain = reader.option("header", True).csv(path)
    if titled and len(rows) > 4:
        grid = reader.option("header", False).csv(path)
        early = numbered_lines(grid.where("_metadata.file_block_start = 0"), HEADER_LINES + 1)
        early = early.where(F.col(LINE).isNotNull() & column(EXTRA).isNull()).select(
            "*", F.lit(None).cast("array<int>").alias("_widths"), F.lit(width).alias("_usual")
        )
        return under_headers(Grid(numbered_lines(grid, HEADER_LINES + 1), located(grid)), early, raw)
    log: list[tuple[int, str, str | None, str]] = []
    names = unique_names(first[:width])
    table = plain.where(column(EXTRA).isNull()).select(*raw)
    too_long = plain.where(column(EXTRA).isNotNull()).count()
    if too_long:
        log.append((0, "long lines", None, f"{too_long} line(s) with more than {width} fields left out"))
    return Loaded(table.toDF(*names), log)


def raw_names(width: int) -> list[str]:
    return [f"_c{i}" for i in range(width)]


def delimited_reader(
    spark: SparkSession, separator: str, encoding: str, multi_line: bool, raw: list[str]
) -> DataFrameReader:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*raw, EXTRA]])
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def read_folder(
    spark: SparkSession, path: str, encoding: str, separator: str | None, multi_line: bool
) -> Loaded:
    """Files of their own widths and separators: as wide a grid as any file's first lines need."""
    heads = written(file_heads(spark, path, encoding, separator), "file-heads")
    seen = heads.groupBy("separator").agg(F.max(F.size("cells")).alias("width")).collect()
    raw = raw_names(max(row["width"] for row in seen))
    numbered, plain = [], []
    for row in seen:  # of the few separators there are
        reader = delimited_reader(spark, row["separator"], encoding, multi_line, raw)
        grid = reader.option("header", False).csv(path)
        for parts, frame in ((numbered, numbered_lines(grid, HEADER_LINES + 1)), (plain, located(grid))):
            if len(seen) > 1:
                own = heads.where(F.col("separator") == row["separator"]).select(FILE).distinct()
                frame = frame.join(own, FILE, "left_semi")
            parts.append(frame)
    grid = Grid(reduce(DataFrame.unionByName, numbered), reduce(DataFrame.unionByName, plain))
    return under_headers(grid, early_lines(heads, raw), raw)


def early_lines(heads: DataFrame, raw: list[str]) -> DataFrame:
    """The first lines of every file as a grid, each with the number of cells of all of its file's."""
    file = Window.partitionBy(FILE)
    sizes = F.sort_array(F.collect_list(F.struct(LINE, F.size("cells").alias("n"))).over(file))
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(raw)]
    early = heads.select(FILE, LINE, *cells, F.lit(None).cast("string").alias(EXTRA), sizes["n"].alias("_widths"))
    return early.withColumn("_usual", most_frequent(F.col("_widths"))).where(F.col(LINE) <= HEADER_LINES)


def read_quoted(
    spark: SparkSession, path: str, encoding: str, separator: str | None, lines: list[str]
) -> Loaded | None:
    """Files whose quotes span lines; None if one of them ends within quotes."""
    kinds = [separator]
    if separator is None:
        heads = written(file_heads(spark, path, encoding, None), "file-heads")
        kinds = sorted(row[0] for row in heads.select("separator").distinct().collect())
    parts = []
    for kind in kinds:
        records = read_records(spark, path, encoding, kind, HEADER_LINES + 1)
        if not records.sound:
            return None
        rows = records.rows
        if len(kinds) > 1:
            rows = rows.join(heads.where(F.col("separator") == kind).select(FILE).distinct(), FILE, "left_semi")
        parts.append(rows)
    rows = reduce(DataFrame.unionByName, parts)
    early = rows.where(F.col(LINE).isNotNull())
    raw = raw_names(early.agg(F.max(F.size("cells"))).first()[0] or 1)
    beyond = F.array_join(F.slice("cells", len(raw) + 1, F.greatest(F.size("cells"), F.lit(1))), "")
    grid = rows.select(
        FILE, LINE, *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(raw)],
        F.when(beyond != "", beyond).alias(EXTRA),
    )
    return under_headers(Grid(grid, grid), early_lines(early, raw), raw)


@dataclass(frozen=True)
class Grid:
    """All lines of all files with their file and cells: once with early lines numbered, once as they come."""

    numbered: DataFrame
    plain: DataFrame


def located(grid: DataFrame) -> DataFrame:
    return grid.select(F.col("_metadata.file_path").alias(FILE), "*")


def most_frequent(widths: Column) -> Column:
    """The number that occurs most often, the larger one of equally frequent ones."""
    counted = F.transform(
        F.array_distinct(widths), lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), w.alias("w"))
    )
    return F.array_max(counted)["w"]


def under_headers(grid: Grid, early: DataFrame, raw: list[str]) -> Loaded:
    """The lines below each file's header, under the columns of the widest file.

    `early` has the first lines of every file, numbered, in cells as wide as any header. Nothing about single files reaches the driver: only the
    distinct headers do, and no more than `MOST_HEADERS`.
    """
    own_width = F.coalesce(F.get("_widths", F.col("header_line")), F.lit(len(raw)))
    found = file_headers(early, raw).withColumn("own_width", own_width).drop("_widths")
    headers = written(found.withColumn("header", F.slice("header", 1, F.col("own_width"))), "headers")
    kinds = headers.groupBy("header").agg(F.min(FILE).alias("example"), F.max("header_line").alias("top"))
    shown = kinds.orderBy("example").limit(MOST_HEADERS + 1).collect()
    if not shown:
        raise UnusableTable("No header in any file")
    if len(shown) > MOST_HEADERS:
        raise UnusableTable(f"Files with more than {MOST_HEADERS} different headers")
    own_names = {tuple(row["header"]): unique_names(row["header"]) for row in shown}
    widest = max(len(row["header"]) for row in shown)
    names = next(own_names[tuple(row["header"])] for row in shown if len(row["header"]) == widest)
    for row in shown:
        mine = own_names[tuple(row["header"])]
        if not set(mine) <= set(names):
            raise UnusableTable(f"Files with different columns: '{row['example']}' has {mine}, another {names}")
    cells = F.array(*[column(c) for c in raw])
    beyond = F.slice(cells, F.col("own_width") + 1, len(raw))
    fits = F.col(EXTRA).isNull() & ~F.exists(beyond, lambda cell: cell.isNotNull())
    fits = F.coalesce(fits, F.lit(True))  # a file of long lines alone has no header
    below = F.col(LINE).isNull() | (F.col(LINE) > F.coalesce("header_line", F.lit(-1)))
    kept = grid.numbered.join(headers, FILE, "left").where(below & fits)
    # Counted without numbering all lines: of those above a header only few can be too long.
    too_long = grid.plain.join(headers, FILE, "left").where(~fits).count()
    too_long -= early.select(FILE, LINE, *raw, EXTRA).join(headers, FILE).where(~below & ~fits).count() if too_long else 0
    log: list[tuple[int, str, str | None, str]] = []
    if top := max(row["top"] for row in shown):
        log.append((0, "header", None, f"Header in line {top + 1}; {top} line(s) above it left out"))
    if too_long:
        width = widest if len({len(row["header"]) for row in shown}) == 1 else "their header's"
        log.append((len(log), "long lines", None, f"{too_long} line(s) with more than {width} fields left out"))
    if len(own_names) == 1:
        return Loaded(kept.select(*[column(c).alias(n) for c, n in zip(raw, names)]), log)
    # Where each column stands in a file follows from its header, of which there are few.
    places = F.create_map(*[
        x for header, mine in own_names.items() for x in (
            F.to_json(F.array(*[F.lit(cell).cast("string") for cell in header])),
            F.array(*[F.lit(mine.index(name) if name in mine else -1) for name in names]),
        )
    ])
    placed = kept.withColumn("_places", F.element_at(places, F.to_json("header")))
    at = [F.get("_places", F.lit(i)) for i in range(len(names))]
    return Loaded(placed.select(*[F.when(p >= 0, F.get(cells, p)).alias(n) for p, n in zip(at, names)]), log)


def numbered_lines(grid: DataFrame, keep: int) -> DataFrame:
    """Number the first lines of every file; later lines get NULL.

    A task reads the lines of a file split in order, and only the split at the start of a file is
    counted, so nothing is shuffled or sorted.
    """
    located = grid.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        "*",
    )
    schema = T.StructType([*located.schema.fields, T.StructField(LINE, T.IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, passed = None, 0
        for batch in batches:
            files = np.array(batch.column(0).to_pylist(), dtype=object)
            starts = batch.column(1).to_numpy(zero_copy_only=False)
            lines = np.full(batch.num_rows, -1, dtype=np.int64)
            edges = np.flatnonzero(files[1:] != files[:-1]) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
                if begin == end:
                    continue
                here = (files[begin], starts[begin])
                if here != current:
                    current, passed = here, 0
                if starts[begin] == 0:
                    lines[begin:end] = passed + np.arange(end - begin)
                passed += end - begin
            early = (lines >= 0) & (lines < keep)
            numbers = pa.array(lines.astype(np.int32), pa.int32(), mask=~early)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, numbers], names=[*batch.schema.names, LINE]
            )

    return located.mapInArrow(number, schema)


def file_headers(early: DataFrame, raw: list[str]) -> DataFrame:
    """(file, header_line, header) of each file: its first line if that can be a header.

    `_usual` is the number of fields that most of the file's first lines have; `_widths` stays.
    """
    all_cells = F.transform(F.array(*[column(c) for c in raw]), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    cells = F.slice(all_cells, 1, F.col("_usual"))
    digits = F.forall(cells, lambda c: c.rlike("^[0-9]+$"))
    blank = F.size(F.filter(cells, lambda c: c.isin("", "nan", "None") | c.startswith("Unnamed")))
    fit = ~digits & (blank < 0.4 * F.col("_usual"))
    first = early.where(F.col(LINE) == 0).select(
        FILE, "_widths", fit.alias("fit"), F.array(*[column(c) for c in raw]).alias("own")
    )
    # A first line that is found unfit is not searched again.
    shifted = early.where(F.col(LINE) >= 1).withColumn("_at", F.col(LINE) - 1)
    searched = best_header(shifted, FILE, "_at", raw, "_usual")
    use_own = F.col("fit") | F.col("header").isNull()
    return first.join(searched, FILE, "left").select(
        FILE, "_widths",
        F.when(use_own, 0).otherwise(F.col("header_line") + 1).alias("header_line"),
        F.when(use_own, F.col("own")).otherwise(F.col("header")).alias("header"),
    )


def read_json(spark: SparkSession, path: str) -> Loaded:
    """JSON as a list of records, `{columns, data}`, `{column: [values]}`, or one record per line.

    A document is parsed by one task, so a large table should come as many files or as lines.
    """
    head = [line.strip() for line in head_lines(spark, path, "UTF-8") if line.strip()]
    if not head:
        raise UnusableTable(f"No table in '{path}'")
    start = head[0].lstrip("\ufeff")
    whole = [line for line in head if line.startswith("{") and line.endswith("}")]
    by_line = start.startswith("{") and len(whole) == len(head) > 1
    table = spark.read.option("multiLine", not by_line).json(path)
    if by_line or start.startswith("["):
        return Loaded(table)
    if {"columns", "data"} <= set(table.columns):
        # Documents may order their columns differently: a cell goes by its document's own names.
        orders = sorted(row[0] for row in table.select("columns").distinct().collect())
        names = list(dict.fromkeys(str(name) for order in orders for name in order))
        cells = table.select("columns", F.explode("data").alias("cells"))
        at = [(F.array_position("columns", n) - 1).cast("int") for n in names]
        values = [F.when(place >= 0, F.get("cells", place)) for place in at]
        return Loaded(cells.select(*[v.alias(n) for n, v in zip(names, values)]))
    lists = [f.name for f in table.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if lists and len(lists) == len(table.columns):
        return Loaded(table.select(F.inline(F.arrays_zip(*[column(n) for n in lists]))))
    return Loaded(table)


def read_parquet(spark: SparkSession, path: str, row_id: str | None = None) -> Loaded:
    """Parquet; `row_id` adds an identity made of file and row position.

    It needs no shuffle and stays the same on every recomputation.
    """
    table = spark.read.parquet(path)
    if row_id:
        place = F.format_string("%s#%012d", "_metadata.file_name", "_metadata.row_index")
        table = table.select(place.alias(row_id), "*")
    return Loaded(table)


def one_format(spark: SparkSession, path: str) -> str:
    formats = folder_formats(spark, path).groupBy("format").count().collect()
    kinds = sorted(row["format"] for row in formats)
    if len(kinds) != 1:
        raise UnusableTable(f"'{path}' holds files of {len(kinds)} formats: {', '.join(kinds)}")
    return kinds[0]


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> Loaded:
    """Read a file or folder and refuse what is no table.

    The format comes from the first bytes and the name unless `kind` gives it.
    """
    kind = kind or one_format(spark, path)
    loaded = _read(spark, path, kind, options)
    check_usable(loaded.table, path, from_text=kind != "parquet")
    return loaded


def _read(spark: SparkSession, path: str, kind: str, options: dict) -> Loaded:
    if kind in ("csv", "tsv", "txt"):
        separator = {"csv": ",", "tsv": "\t", "txt": None}[kind]
        return read_delimited(spark, path, **{"separator": separator, **options})
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path, **options)
    if kind in ("xlsx", "xls"):
        raise UnusableTable(f"'{path}' is an Excel workbook, for which Spark has no reader")
    raise UnusableTable(f"No reader for files of kind '{kind}'")
