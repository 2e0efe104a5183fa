"""Source mixing against a plain loop, and its texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from undertow.llm import mixing
from undertow.llm.words import word_count
from pyspark.sql import functions as F

from llm.conftest import MESSY


def sized(docs):
    return docs.withColumn("size", word_count(F.col("text")))


def shares(sizes):
    """Targets by sharing again and again until no source is above twice its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def expected(rows):
    sizes = defaultdict(int)
    for _, size, source in rows:
        sizes[source] += size
    target, taken = shares(sizes), []
    key = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    for source in sizes:
        whole, start = int(target[source] + 1e-6), 0
        own = sorted(((key(i), i is not None, i or 0, size) for i, size, s in rows if s == source))
        for _, known, i, size in own:
            epochs, rest = divmod(whole, sizes[source]) if sizes[source] else (0, 0)
            cut = max(0, min(size, rest - start))
            taken.append((i if known else None, size, epochs * size + cut))
            start += size
    return target, sorted(taken, key=str)


@pytest.mark.parametrize("rows_per_range", [4_096, 4])
def test_against_a_loop(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(rows_per_range)
    rows = [(i, rng.randrange(60), rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    rows += [(None, 5, "a"), (None, 7, "z"), (4, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string")
    found = mixing.mix(docs).collect()
    target, taken = expected(rows)
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in found), key=str) == taken
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in found)
    by_source = defaultdict(int)
    for r in found:
        by_source[r["source"]] += r["taken"]
    assert all(abs(by_source[s] - target[s]) < 1 for s in target)


def test_messy_rows_and_reruns(messy):
    first = sorted(mixing.mix(sized(messy)).select("doc_id", "size", "source", "taken").collect(), key=str)
    again = sorted(
        mixing.mix(sized(messy).repartition(3)).select("doc_id", "size", "source", "taken").collect(), key=str
    )
    assert first == again
    assert len(first) == len(MESSY)
    assert all(r["taken"] <= 2 * r["size"] for r in first)


def test_empty_tables(nothing, documents):
    assert mixing.mix(sized(nothing)).collect() == []
    rows = mixing.mix(sized(documents([(1, None, "a"), (2, " ", None)]))).collect()
    assert [(r["target"], r["taken"]) for r in rows] == [(0.0, 0)] * 2


def test_copies_hold_the_words_taken(messy):
    mixed = mixing.mix(sized(messy))
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixing.copies(mixed).collect())
    assert words == sum(r["taken"] for r in mixed.collect())
