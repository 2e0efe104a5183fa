"""Columns that are called like working columns keep their names and values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from undertow.llm import lines, mixing, simhash
from undertow.llm.words import spare, word_count

CHANGED = {"text", "size", "n_lines", "n_deleted", *mixing.ADDED}


def mixed(docs):
    return mixing.mix(docs.withColumn("size", word_count(F.col("text"))))


def used(docs):
    return mixing.copies(mixed(docs))


@pytest.mark.parametrize("operator", [mixed, used, lines.dedupe_lines, simhash.dedupe])
def test_values_stay(messy, operator):
    result = operator(messy)
    kept = [name for name in messy.columns if name not in CHANGED]
    assert set(kept) <= set(result.columns)
    names = [f"`{name}`" for name in kept]
    given = {tuple(row) for row in messy.select(names).collect()}
    got = {tuple(row) for row in result.select(names).collect()}
    assert got and got <= given


def test_spare(spark):
    docs = spark.createDataFrame([], "_H int, place int")
    assert spare(docs, "_h", "place", "_id") == ["_h_", "place_", "_id"]
