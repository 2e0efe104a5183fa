"""How filters interact: what each removes in every order they could be applied in.

A document's failed filters are bits of one mask, and masks are counted per part; all later work is on
those counts, at most 2**filters rows a part. The states of the lattice are the sets of filters that
have already been applied. An edge adds one filter to a state and removes the documents that fail it
and passed all before. Forward counts say how many orders reach a state, backward counts how many ways
lead from it to the full set, so forward of an edge's start times backward of its end is the number of
orders that take the edge. Weighted so, an edge's removals add up to the filter's share over all
orders; and every step of an order is one of the same edges, so its report is read from there.

Which copy of a text stays is settled by the smallest doc_id that holds it: texts meet as 128-bit
hashes, combined before the shuffle, and the answer goes back by hash and id together, so a text that a
third of all rows hold is no hot key. Labels are joined by id.

Null texts count as empty and are equal to empty ones; a null lang is the part ''. A document with a
null id is never a later copy, and no document is later than it; such ids share one join key, whose
rows Spark splits like any skewed one. Rows that share an id are documents of their own, and neither is
the smaller. Labels of a repeated doc_id count if any row says 1; labels of no document, or with null
ids, count for none. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.words import let, words
from undertow.session import small_frame

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: An order takes a row per step, so the report has filters! * filters rows a part.
MOST_FILTERS = 7


@dataclass(frozen=True)
class Filter:
    """A letter, and when a document fails.

    `fails` reads `text`, `n_words` and `n_distinct`; with `of_copies` it reads `later_copy` alone.
    """

    letter: str
    fails: Callable[[], Column]
    of_copies: bool = False


FILTERS = (
    Filter("A", lambda: F.col("n_words") < 100),
    Filter("B", lambda: 100 * F.col("n_distinct") < 80 * F.col("n_words")),
    Filter("C", lambda: 100 * capitals(F.col("text")) > 10 * F.length("text")),
    Filter("D", lambda: F.col("text").rlike(r"[#$%&*|]")),
    Filter("E", lambda: F.col("later_copy"), of_copies=True),
)
COUNTS = ("n", "good", "toxic")


def capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, CAPITALS, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, hash of the text, and its numbers of words and distinct words."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = let(
        words(F.col("text")),
        lambda found: F.struct(
            F.size(found).cast("long").alias("all"), F.size(F.array_distinct(found)).cast("long").alias("distinct")
        ),
    )
    return docs.withColumn("sizes", sizes).select(
        "doc_id", "part", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"),
        F.col("sizes.all").alias("n_words"), F.col("sizes.distinct").alias("n_distinct"),
    )


def failed_filters(docs: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """doc_id, part and `mask`: bit i is set if the document fails filter i."""

    def bits(of_copies: bool) -> Column:
        total = F.lit(0)
        for i, one in enumerate(filters):
            if one.of_copies == of_copies:
                total = total + F.when(one.fails(), 1 << i).otherwise(0)
        return total

    plain = measured(docs).select("doc_id", "part", "h", bits(False).alias("bits"))
    first = plain.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("is_first", F.lit(True)).hint("merge")
    joined = plain.join(first, ["h", "doc_id"], "left").withColumn(
        "later_copy", F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    )
    return joined.select("doc_id", "part", (F.col("bits") + bits(True)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the numbers of documents, of good and of toxic ones."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("toxic"),
    )
    return (
        masks.join(marks.hint("merge"), "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )


@dataclass(frozen=True)
class Edge:
    """Adding filter `bit` to the filters of `state`; `orders` is the number of orders that do so there."""

    state: int
    bit: int
    orders: int


def lattice(size: int) -> list[Edge]:
    """All edges between subsets of `size` filters, with the orders through each."""
    full = (1 << size) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    bits = [1 << i for i in range(size)]
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ bit] for bit in bits if state & bit)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | bit] for bit in bits if not state & bit)
    return [
        Edge(state, i, forward[state] * backward[state | bit])
        for state in range(full + 1)
        for i, bit in enumerate(bits)
        if not state & bit
    ]


def edge_counts(counts: DataFrame, size: int) -> DataFrame:
    """A row per part and edge: what stays behind it, what it removes, and what fails it in vain."""
    edges = F.array(*(
        F.struct(
            F.lit(e.state).alias("state"), F.lit(e.bit).alias("bit"), F.lit(1 << e.bit).alias("own"),
            F.lit(e.orders).cast("long").alias("orders"),
        )
        for e in lattice(size)
    ))
    mask, fails = F.col("mask"), F.col("mask").bitwiseAND(F.col("own")) != 0
    passed = mask.bitwiseAND(F.col("state")) == 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    removed = passed & fails
    return counts.select("*", F.inline(edges)).groupBy("part", "state", "bit", "orders").agg(
        total(passed & ~fails).alias("kept"),
        total(removed).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(mask == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )


def report(counts: DataFrame, letters: str) -> DataFrame:
    """Every step of every order, per part, read from the edges it takes."""
    if len(letters) > MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"up to {MOST_FILTERS} filters with a letter each, not {letters!r}")
    edges = edge_counts(counts, len(letters))
    shares = edges.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = []
    for order in permutations(range(len(letters))):
        state, name = 0, "".join(letters[i] for i in order)
        for step, bit in enumerate(order, 1):
            steps.append((name, step, state, bit))
            state |= 1 << bit
    steps = small_frame(counts.sparkSession, steps, "filter_order string, step int, state int, bit int")
    return (
        edges.join(shares, ["part", "bit"])
        .join(F.broadcast(steps), ["state", "bit"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
            "good_lost", "toxic_lost", "shapley",
        )
    )


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """part, filter_order and step with what that step keeps, removes and loses."""
    counts = mask_counts(failed_filters(docs, filters), labels)
    return report(counts, "".join(one.letter for one in filters))
