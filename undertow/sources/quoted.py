"""Delimited text whose quoted cells hold line breaks, parsed block by block.

Where a block of a file begins, nobody knows whether a quote is open. So every block is parsed under
both assumptions at once. The two readings mostly meet at the first line that holds a quote, and from
there on there is one; what differs is kept under the assumption it needs. Each block also tells the state
in which it ends for either one, and following these from the start of the file gives the true state of
every block. A record cut by the edge of a block comes as pieces, which are put together by their place.

A quote opens a cell only at its start, as in other readers, so a stray quote within a cell is text.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.session import written

FILE, BLOCK, LINE = "_file", "_block", "_line"
OUTSIDE, INSIDE, EITHER = 0, 1, 2  # the assumption that a row needs
RECORD, HEAD, TAIL, STATES = 0, 1, 2, 3
PARSED = (
    f"{FILE} string, {BLOCK} long, given int, kind int, {LINE} int, cells array<string>, piece string,"
    " after_outside int, after_inside int"
)
BATCH = 5_000


def line_states(separator: str) -> Callable[[str, int], int]:
    """A function from a line and the state at its start to the state at its end."""
    sep = re.escape(separator)
    rest = re.compile(rf'(?:(?:"(?:[^"]|"")*+"[^{sep}]*+|[^"{sep}][^{sep}]*+)?{sep})*+')
    last = re.compile(rf'"(?:[^"]|"")*+(?!")$')
    closing = re.compile(rf'(?:[^"]|"")*+"[^{sep}]*+(?:{sep}|$)')

    def after(line: str, state: int) -> int:
        if '"' not in line:
            return state
        at = 0
        if state == INSIDE:
            found = closing.match(line)
            if not found:
                return INSIDE
            at = found.end()
            if at == len(line) and not line.endswith(separator):
                return OUTSIDE
        at = rest.match(line, at).end()
        return INSIDE if last.match(line, at) else OUTSIDE

    return after


class Reading:
    """One reading of a block: complete records, and what is left of a record at either edge."""

    def __init__(self, state: int, separator: str):
        self.state, self.separator = state, separator
        self.lines: list[str] = []
        self.in_head = state == INSIDE

    def take(self, line: str, state: int) -> tuple[int, str] | None:
        """The kind and text of what ends with this line."""
        # A line break within a cell stays what it is; one at a record's end is no part of it.
        self.lines.append(line.removesuffix("\r") if state == OUTSIDE else line)
        self.state = state
        return self.ended(HEAD if self.in_head else RECORD) if state == OUTSIDE else None

    def ended(self, kind: int) -> tuple[int, str]:
        text = "\n".join(self.lines)
        self.lines, self.in_head = [], False
        return kind, text


def cells_of(text: str, separator: str) -> list[str | None]:
    """The cells of one record; an empty cell is missing."""
    csv.field_size_limit(sys.maxsize)
    *lines, last = text.split("\n")
    try:
        row = next(csv.reader([*(line + "\n" for line in lines), last], delimiter=separator), [])
    except csv.Error:  # a carriage return within an unquoted cell
        row = next(csv.reader([text.replace("\r", "")], delimiter=separator), [])
    return [cell or None for cell in row]


class Block:
    """A block read under both assumptions until they agree."""

    def __init__(self, file: str, start: int, separator: str, keep: int):
        self.key, self.separator, self.keep = (file, start), separator, keep
        self.after = line_states(separator)
        self.readings = {OUTSIDE: Reading(OUTSIDE, separator), INSIDE: Reading(INSIDE, separator)}
        if start == 0:
            del self.readings[INSIDE]
        self.number = 0

    def lines(self, line: str) -> Iterator[tuple]:
        states = {given: self.after(line, reading.state) for given, reading in self.readings.items()}
        for given, reading in self.readings.items():
            if (piece := reading.take(line, states[given])) is not None:
                yield self.row(given, *piece)
        if len(states) == 2 and set(states.values()) == {OUTSIDE}:
            self.readings = {EITHER: self.readings[OUTSIDE]}

    def row(self, given: int, kind: int, text: str) -> tuple:
        if kind != RECORD:
            return (*self.key, given, kind, None, None, text, None, None)
        number = None
        if self.key[1] == 0 and text.strip():
            number = self.number if self.number < self.keep else None
            self.number += 1
        return (*self.key, given, kind, number, cells_of(text, self.separator), None, None, None)

    def end(self) -> Iterator[tuple]:
        for given, reading in self.readings.items():
            if reading.lines:
                # A piece that neither begins nor ends here goes on from block to block.
                yield self.row(given, HEAD if reading.in_head else TAIL, reading.ended(0)[1])
        states = {given: reading.state for given, reading in self.readings.items()}
        outside, inside = (states.get(given, states.get(EITHER)) for given in (OUTSIDE, INSIDE))
        yield (*self.key, EITHER, STATES, None, None, None, outside, inside)


def decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """Lines as text. Spark's text reader passes on the bytes of a line, whatever encoding it is given."""
    if encoding.upper().replace("-", "") == "UTF8":
        text = F.make_valid_utf8("value")
    else:
        text = F.decode(F.col("value").cast("binary"), encoding)
    return lines.withColumn("value", text)


def parsed_blocks(spark: SparkSession, path: str, encoding: str, separator: str, keep: int) -> DataFrame:
    """Records and pieces of all blocks; the first `keep` records of every file are numbered."""
    lines = decoded(spark.read.option("lineSep", "\n").text(path), encoding).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), "value"
    )
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(),
             pa.int32(), pa.int32()]
    names = [field.split()[0] for field in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            for file, start, line in zip(*(column.to_pylist() for column in batch.columns)):
                if block is None or block.key != (file, start):
                    rows += block.end() if block else ()
                    block = Block(file, start, separator, keep)
                rows += block.lines(line)
                if len(rows) >= BATCH:
                    yield as_batch(rows, kinds, names)
                    rows = []
        rows += block.end() if block else ()
        if rows:
            yield as_batch(rows, kinds, names)

    return lines.mapInArrow(run, PARSED)


def as_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def true_states(parsed: DataFrame) -> DataFrame:
    """file, block and the state that holds at the block's start, and whether its file ends outside quotes."""

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(BLOCK)
        states, state = [], OUTSIDE
        for outside, inside in zip(group["after_outside"], group["after_inside"]):
            states.append(state)
            state = int(inside if state == INSIDE else outside)
        return group.assign(state=np.array(states, dtype=np.int32), sound=state == OUTSIDE)[
            [FILE, BLOCK, "state", "sound"]
        ]

    return parsed.where(F.col("kind") == STATES).groupBy(FILE).applyInPandas(
        follow, f"{FILE} string, {BLOCK} long, state int, sound boolean"
    )


def stitched(pieces: DataFrame, separator: str) -> DataFrame:
    """The records that blocks have cut, from their pieces: one that begins, and all that go on from it."""
    begins = F.max(F.when(F.col("kind") == TAIL, F.col(BLOCK)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        text = "\n".join(group.sort_values([BLOCK, "kind"])["piece"])
        return pd.DataFrame({FILE: [group[FILE].iloc[0]], "cells": [cells_of(text, separator)]})

    before = Window.partitionBy(FILE).orderBy(BLOCK, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        pieces.withColumn("record", begins.over(before))
        .groupBy(FILE, "record")
        .applyInPandas(run, f"{FILE} string, cells array<string>")
        .withColumn(LINE, F.lit(None).cast("int"))
    )


@dataclass(frozen=True)
class Records:
    """file, line (of the first ones) and cells of every record; `sound` unless a quote stays open."""

    rows: DataFrame
    sound: bool


def read_records(spark: SparkSession, path: str, encoding: str, separator: str, keep: int) -> Records:
    parsed = written(parsed_blocks(spark, path, encoding, separator, keep), "parsed-blocks")
    states = written(true_states(parsed), "block-states")
    sound = states.where("not sound").isEmpty()
    needed: Column = (F.col("given") == EITHER) | (F.col("given") == F.col("state"))
    true = parsed.where(F.col("kind") != STATES).join(states, [FILE, BLOCK]).where(needed)
    whole = true.where(F.col("kind") == RECORD).select(FILE, LINE, "cells")
    cut = stitched(true.where(F.col("kind") != RECORD).select(FILE, BLOCK, "kind", "piece"), separator)
    # Lines that hold nothing are no records.
    filled = F.exists("cells", lambda cell: cell.isNotNull() & (F.trim(cell) != "")) | (F.size("cells") > 1)
    return Records(whole.unionByName(cut.select(FILE, LINE, "cells")).where(filled), sound)
