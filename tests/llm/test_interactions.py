"""Filter interactions against applying the filters in every order, document by document."""

from __future__ import annotations

import random
import re
from itertools import permutations
from math import factorial

from llm.conftest import MESSY
from pyspark.sql import functions as F

from undertow.llm import interactions

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """(doc_id, part, set of failed letters) of (doc_id, text, lang) rows."""
    found = []
    for doc_id, text, lang in rows:
        words, letters = WORDS.findall(text or ""), set()
        if len(words) < 100:
            letters.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            letters.add("B")
        if 100 * sum("A" <= x <= "Z" for x in text or "") > 10 * len(text or ""):
            letters.add("C")
        if re.search(r"[#$%&*|]", text or ""):
            letters.add("D")
        if doc_id is not None and any(
            i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in rows
        ):
            letters.add("E")
        found.append((doc_id, lang or "", letters))
    return found


def expected(rows, good, toxic):
    report = {}
    docs = failing(rows)
    for part in {p for _, p, _ in docs}:
        mine = [(i, letters) for i, p, letters in docs if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                out = [(i, x) for i, x in left if letter in x]
                gone = [(i, x) for i, x in mine if letter in x and not any(y is x for _, y in left)]
                left = [(i, x) for i, x in left if letter not in x]
                shares[letter] += len(out)
                report[part, "".join(order), step] = [
                    len(left), len(out), len(gone), sum(x == {letter} for _, x in mine),
                    sum(i in good for i, _ in out), sum(i in toxic for i, _ in out),
                ]
        for (p, order, step), row in report.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return {key: tuple(row) for key, row in report.items()}


def found(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in frame.collect()}


def test_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", "SHOUT " * 30, "a b c " * 50, "x" * 99, *(text for _, text, _ in MESSY)]
    texts += [" ".join(f"{rng.choice('abAB')}{i}" for i in range(rng.choice([90, 100, 130]))) for _ in range(12)]
    texts += [text + rng.choice([" $", " |", " word"]) for text in texts[-8:]]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(7, "twice", "en"), (7, "twice", "en"), (7, "another", "fr"), (None, "twice", "fr"), (None, "", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    report = found(interactions.audit(docs, marked))
    assert report == expected(rows, good, toxic)
    assert len(report) == 3 * 120 * 5


def test_clashing_columns_and_empty_tables(spark, messy, nothing):
    clashing = messy.select("*", F.lit("x").alias("h"), F.lit("y").alias("part"), F.lit(1).alias("mask"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(i, text, "en") for i, text, _ in MESSY]
    assert found(interactions.audit(clashing, labels)) == expected(rows, set(), set())
    assert interactions.audit(nothing, labels).collect() == []


def test_paths_through_the_lattice():
    for size in range(1, 7):
        edges = interactions.lattice(size)
        assert len(edges) == size * 2 ** (size - 1)
        for bit in range(size):
            assert sum(e.orders for e in edges if e.bit == bit) == factorial(size)
        for step in range(size):
            assert sum(e.orders for e in edges if e.state.bit_count() == step) == factorial(size)


def test_filters_of_ones_own(spark, documents):
    own = (
        interactions.Filter("S", lambda: F.length("text") < 4),
        interactions.Filter("E", lambda: F.col("later_copy"), of_copies=True),
    )
    docs = documents([(1, "abc", "a"), (2, "abc", "a"), (3, "abcdef", "a"), (4, "abcdef", "a")])
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = found(interactions.audit(docs, labels, own))
    assert rows["en", "SE", 1] == (2, 2, 0, 1, 1, 0, 3)
    assert rows["en", "SE", 2] == (1, 1, 1, 1, 0, 0, 3)
    assert rows["en", "ES", 1] == (2, 2, 0, 1, 1, 0, 3)
