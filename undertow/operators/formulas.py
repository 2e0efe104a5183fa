"""Arithmetic rules `c ≈ a op b` that hold for nearly every row, and the rows that break them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions.cells import column, number, quoted, text_columns
from undertow.operators.statistics import TableStats
from undertow.session import small_frame

OPERATIONS = ("+", "−", "×", "÷")
RULE_SCHEMA = (
    "rule_no int, rule string, col_a string, op string, col_b string, col_c string,"
    " valid_rows bigint, violations bigint, hold_rate double"
)


@dataclass(frozen=True)
class Tolerance:
    relative: float = 0.02
    absolute: float = 0.05


@dataclass(frozen=True)
class Formula:
    """One candidate: `number` is its place in the search order."""

    number: int
    a: str
    op: str
    b: str
    c: str

    @property
    def text(self) -> str:
        return f"{self.c} ≈ {self.a} {self.op} {self.b}"

    def predicate(self, tolerance: Tolerance = Tolerance()) -> str:
        """The violating rows as a SQL condition; NULL where the rule cannot be checked."""
        a, b, c = (f"CAST({quoted(n)} AS DOUBLE)" for n in (self.a, self.b, self.c))
        sql = {
            "+": f"{a} + {b}",
            "−": f"{a} - {b}",
            "×": f"{a} * {b}",
            "÷": f"{a} / CASE WHEN abs({b}) > 1e-9 THEN {b} END",
        }[self.op]
        off = f"abs({c} - ({sql}))"
        return (
            f"NOT ({off} / greatest(abs({c}), 1D) <= {tolerance.relative}D"
            f" OR {off} <= {tolerance.absolute}D)"
        )


def formula_at(place: int, columns: list[str]) -> Formula:
    """The formula at a place of the search order: by a, then b, then c, then operation."""
    rest, op = divmod(place, len(OPERATIONS))
    rest, c = divmod(rest, len(columns))
    a, b = divmod(rest, len(columns))
    return Formula(place, columns[a], OPERATIONS[op], columns[b], columns[c])


def _place(columns: list[str], a: str, b: str, c: str, op: str) -> int:
    slot, width = columns.index, len(columns)
    triple = (slot(a) * width + slot(b)) * width + slot(c)
    return triple * len(OPERATIONS) + OPERATIONS.index(op)


def candidates(columns: list[str]) -> list[Formula]:
    """Every ordered triple and operation; mirrored sums and products come once, a before b."""
    return [
        Formula(_place(columns, a, b, c, op), a, op, b, c)
        for a, b, c in permutations(columns, 3)
        for op in OPERATIONS
        if op in "−÷" or columns.index(a) < columns.index(b)
    ]


def mirrored(rule: Formula, columns: list[str]) -> Formula | None:
    """The same sum or product with a and b swapped, at its own place in the search order."""
    if rule.op in "−÷":
        return None
    return formula_at(_place(columns, rule.b, rule.a, rule.c, rule.op), columns)


def _expected(a: np.ndarray, b: np.ndarray, op: str) -> np.ndarray:
    """What a formula makes of its two sides; NaN where it makes nothing finite."""
    if op == "÷":
        b = np.where(np.abs(b) > 1e-9, b, np.nan)
    value = {"+": np.add, "−": np.subtract, "×": np.multiply, "÷": np.divide}[op](a, b)
    return np.where(np.isfinite(value), value, np.nan)


def _off(recorded: np.ndarray, expected: np.ndarray, tol: Tolerance) -> tuple[np.ndarray, np.ndarray]:
    """Where a rule can be checked, and where it holds."""
    off = np.abs(recorded - expected)
    held = (off / np.maximum(np.abs(recorded), 1.0) <= tol.relative) | (off <= tol.absolute)
    return ~np.isnan(off), held


def _numbers(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {
        name: np.array(batch.column(f"c{i}").to_numpy(zero_copy_only=False), dtype=float)
        for i, name in enumerate(names)
    }


def _violations(
    batch: pa.RecordBatch, rules: list[Formula], names: list[str], tol: Tolerance
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per rule: which rows of the batch break it, what all rows record and what the rule expects."""
    cells = _numbers(batch, names)
    with np.errstate(all="ignore"):
        for rule in rules:
            expected = _expected(cells[rule.a], cells[rule.b], rule.op)
            valid, held = _off(cells[rule.c], expected, tol)
            yield valid & ~held, cells[rule.c], expected


def _sides(rules: list[Formula]) -> list[str]:
    return list(dict.fromkeys(name for rule in rules for name in (rule.a, rule.b, rule.c)))


def _tally(cells: DataFrame, rules: list[Formula], columns: list[str], tol: Tolerance) -> DataFrame:
    """rule_no, valid_rows, held, and the range of what the rule expects, over every row.

    Each task counts all rules over its batches of columns and passes on one row per rule, so
    neither rows nor plan are multiplied by the number of rules.
    """
    sides: dict[tuple[int, int, str], list[tuple[int, int]]] = {}
    for at, rule in enumerate(rules):
        side = (columns.index(rule.a), columns.index(rule.b), rule.op)
        sides.setdefault(side, []).append((at, columns.index(rule.c)))
    numbers = [rule.number for rule in rules]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        valid, held = np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=np.int64)
        low, high = np.full(len(numbers), np.inf), np.full(len(numbers), -np.inf)
        for batch in batches:
            grid = list(_numbers(batch, columns).values())
            with np.errstate(all="ignore"):
                for (a, b, op), recorded in sides.items():
                    expected = _expected(grid[a], grid[b], op)
                    if np.isnan(expected).all():
                        continue
                    bounds = np.nanmin(expected), np.nanmax(expected)
                    for at, c in recorded:
                        checked, ok = _off(grid[c], expected, tol)
                        valid[at] += np.count_nonzero(checked)
                        held[at] += np.count_nonzero(ok)
                        low[at], high[at] = min(low[at], bounds[0]), max(high[at], bounds[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.array(numbers, dtype=np.int32), valid, held, low, high)],
            names=["rule_no", "valid_rows", "held", "low", "high"],
        )

    grid = cells.select(*[number(n).alias(f"c{i}") for i, n in enumerate(columns)])
    counted = grid.mapInArrow(
        count, "rule_no int, valid_rows long, held long, low double, high double"
    )
    return counted.groupBy("rule_no").agg(
        F.sum("valid_rows").alias("valid_rows"),
        F.sum("held").alias("held"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def searched_columns(stats: TableStats, leave_out: tuple[str, ...] = (), most: int | None = 8) -> list[str]:
    return [n for n in stats.numeric if n not in leave_out][:most]


def formula_rules(
    df: DataFrame,
    stats: TableStats,
    columns: list[str] | None = None,
    least_rate: float = 0.90,
    tolerance: Tolerance = Tolerance(),
) -> DataFrame:
    """Every rule that holds for at least `least_rate` of its rows, counted over every row.

    What a rule expects must vary; a rule that expects one number says nothing.
    """
    names = searched_columns(stats) if columns is None else columns
    spark = df.sparkSession
    empty = small_frame(spark, [], RULE_SCHEMA)
    if len(names) < 3 or stats.rows < 8:
        return empty
    rules = [r for r in candidates(names) if stats[r.c].spread]
    cells = df.select(*[column(n) for n in names])
    if not rules:
        return empty
    described = []
    for rule in rules:
        for form in (rule, mirrored(rule, names)):
            if form is not None:
                described.append(
                    (rule.number, form.number, form.text, form.a, form.op, form.b, form.c)
                )
    forms = small_frame(spark,
        described,
        "checked_no int, rule_no int, rule string, col_a string, op string, col_b string,"
        " col_c string",
    )
    tally = _tally(cells, rules, names, tolerance).where(
        (F.col("valid_rows") >= 8)
        & (F.col("held") >= least_rate * F.col("valid_rows"))
        & (F.col("low") < F.col("high"))
    )
    return (
        tally.withColumnRenamed("rule_no", "checked_no")
        .join(F.broadcast(forms), "checked_no")
        .select(
            "rule_no",
            "rule",
            "col_a",
            "op",
            "col_b",
            "col_c",
            "valid_rows",
            (F.col("valid_rows") - F.col("held")).alias("violations"),
            F.round(F.col("held") / F.col("valid_rows") * 100, 1).alias("hold_rate"),
        )
    )


def violation_ledger(df: DataFrame, rules: list[Formula], tolerance: Tolerance = Tolerance()) -> DataFrame:
    """(rule_a, rule_b, rows) for all pairs of rules that some row breaks both, a rule with itself included.

    One scan for all rules. A row's broken rules are the bits of a mask; a task counts its masks and
    passes on what they say of pairs, so rows are neither multiplied nor shuffled.
    """
    schema = "rule_a int, rule_b int, rows long"
    if not rules:
        return small_frame(df.sparkSession, [], schema)
    names, numbers = _sides(rules), np.array([rule.number for rule in rules], dtype=np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((len(rules), len(rules)), dtype=np.int64)
        for batch in batches:
            broken = np.stack([bad for bad, _, _ in _violations(batch, rules, names, tolerance)], 1)
            broken = broken[broken.any(1)]
            if not len(broken):
                continue
            masks, rows = np.unique(np.packbits(broken, axis=1), axis=0, return_counts=True)
            bits = np.unpackbits(masks, axis=1, count=len(rules)).astype(np.int64)
            pairs += bits.T @ (bits * rows[:, None])
        a, b = np.nonzero(pairs)
        columns = numbers[a], numbers[b], pairs[a, b]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["rule_a", "rule_b", "rows"])

    cells = df.select(*[number(n).alias(f"c{i}") for i, n in enumerate(names)])
    return cells.mapInArrow(count, schema).groupBy("rule_a", "rule_b").agg(F.sum("rows").alias("rows"))


def ranked_rules(
    df: DataFrame,
    rules: DataFrame,
    columns: list[str],
    broken: int | None = 3,
    verified: int | None = 1,
    most_overlap: float = 0.5,
    tolerance: Tolerance = Tolerance(),
) -> list[dict]:
    """The most violated rules, each blaming mostly different rows, and one rule without violations.

    Rules are taken by violations, then hold rate. A rule is skipped if more than half of its
    violating rows, as a share of both sets, already belong to a rule taken before.
    """
    rows = [row.asDict() for row in rules.collect()]
    rows.sort(key=lambda r: (-r["violations"], -r["hold_rate"], r["rule_no"]))
    open_rules = [r for r in rows if r["violations"]]
    kept: list[dict] = []
    shared: dict[tuple[int, int], int] = {}
    if len(open_rules) > 1:
        ledger = violation_ledger(df, [as_formula(r) for r in open_rules], tolerance)
        shared = {(r["rule_a"], r["rule_b"]): r["rows"] for r in ledger.collect()}

    def overlaps(one: dict, other: dict) -> bool:
        both = shared.get((one["rule_no"], other["rule_no"]), 0)
        return both > most_overlap * (one["violations"] + other["violations"] - both)

    for rule in open_rules:
        if broken is not None and len(kept) == broken:
            break
        if not any(overlaps(taken, rule) for taken in kept):
            kept.append(rule)
    return kept + [r for r in rows if not r["violations"]][:verified]


def as_formula(row: dict) -> Formula:
    return Formula(row["rule_no"], row["col_a"], row["op"], row["col_b"], row["col_c"])


def row_label(df: DataFrame, row_id: str, longest: int = 24) -> Column:
    """A short text naming a row: its first text cell of at most 24 characters, else its id."""
    named = []
    for name in text_columns(df):
        if name == row_id:
            continue
        cell = F.trim(column(name))
        short = (F.length(cell) > 0) & (F.length(cell) <= longest)
        named.append(F.when(short, F.concat(F.lit(f"{name}="), cell)))
    return F.coalesce(*named, F.concat(F.lit("row "), column(row_id).cast("string")))


def violating_rows(
    df: DataFrame,
    rules: list[Formula],
    columns: list[str],
    row_id: str,
    tolerance: Tolerance = Tolerance(),
) -> DataFrame:
    """Every row breaking a rule: (rule_no, row_id, label, recorded, expected)."""
    if not rules:
        return small_frame(df.sparkSession,
            [], "rule_no int, row_id string, label string, recorded double, expected double"
        )
    broken = reduce(
        lambda one, other: one | other,
        [F.coalesce(F.expr(r.predicate(tolerance)), F.lit(False)) for r in rules],
    )
    names = _sides(rules)
    cells = df.where(broken).select(
        column(row_id).alias("row_id"), row_label(df, row_id).alias("label"),
        *[number(n).alias(f"c{i}") for i, n in enumerate(names)],
    )
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    schema = T.StructType([
        T.StructField("rule_no", T.IntegerType()), T.StructField("row_id", kinds["row_id"]),
        T.StructField("label", kinds["label"]), T.StructField("recorded", T.DoubleType()),
        T.StructField("expected", T.DoubleType()),
    ])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rule, (bad, recorded, expected) in zip(rules, _violations(batch, rules, names, tolerance)):
                at = np.flatnonzero(bad)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), rule.number, dtype=np.int32)),
                        batch.column("row_id").take(pa.array(at)), batch.column("label").take(pa.array(at)),
                        pa.array(recorded[at]), pa.array(expected[at]),
                    ],
                    names=schema.names,
                )

    return cells.mapInArrow(listed, schema)


def violation_examples(violations: DataFrame, most: int = 5) -> DataFrame:
    """The first violating rows of each rule, in row order."""
    order = Window.partitionBy("rule_no").orderBy("row_id")
    return (
        violations.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= most)
        .select("rule_no", "place", "row_id", "label", "recorded", "expected")
    )
