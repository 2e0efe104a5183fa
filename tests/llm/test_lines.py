"""Line dedup against all pairs of places."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from undertow.llm import lines

from llm.conftest import MESSY


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def place(row):
    i, text = row
    return (i is not None, i or 0, hashlib.md5(text.encode()).digest())


def expected(rows, least):
    """Each document's text without every line that a long enough earlier run holds."""
    known = sorted({row for row in rows if row[1] is not None}, key=place)
    split = [[(at, x) for at, x in enumerate(text.split("\n")) if words(x)] for _, text in known]
    gone = [set() for _ in known]
    for b, later in enumerate(split):
        for a in range(b + 1):
            for j in range(len(later)):
                for i in range(len(split[a]) if a < b else j):
                    size = total = 0
                    while (
                        i + size < len(split[a]) and j + size < len(later)
                        and split[a][i + size][1] == later[j + size][1]
                    ):
                        total += words(later[j + size][1])
                        size += 1
                    if total >= least:
                        gone[b] |= {later[j + k][0] for k in range(size)}
    texts = {}
    for row, drop in zip(known, gone):
        texts[row] = "\n".join(x for at, x in enumerate(row[1].split("\n")) if at not in drop), len(drop)
    return texts


@pytest.mark.parametrize("least", [1, 3, 7])
def test_against_all_pairs(spark, least):
    rng = random.Random(least)
    pool = ["a", "b b", "c c c", "", "d d", " ", "e e e e e", "f"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(12)))) for i in range(40)]
    passage = "\n".join(["a", "f", "b b", "d d"])
    rows += [(100 + i, f"{i} own\n{passage}\n{'x ' * i}own") for i in range(6)]
    rows += [(None, passage), (3, passage), (3, passage), (200, None), (201, "a\n" * 9)]
    found = lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    texts = expected(rows, least)
    assert len(found) == len(rows)
    want = [(i, *texts[i, text]) if text is not None else (i, None, 0) for i, text in rows]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_deleted"]) for r in found))) == sorted(map(str, want))


def test_messy_rows(messy):
    found = lines.dedupe_lines(messy)
    assert found.columns == [c for c in messy.columns if c != "n_lines"] + ["n_lines", "n_deleted"]
    rows = found.collect()
    assert len(rows) == len(MESSY)
    texts = expected([(i, text) for i, text, _ in MESSY], lines.LEAST)
    want = [(i, *texts[i, text]) if text is not None else (i, None, 0) for i, text, _ in MESSY]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_deleted"]) for r in rows))) == sorted(map(str, want))


def test_empty_table(nothing):
    assert lines.dedupe_lines(nothing).collect() == []


def test_only_built_in_functions(messy):
    plan = lines.dedupe_lines(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
