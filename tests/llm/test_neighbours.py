"""Multi-index hashing against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from undertow.llm import neighbours

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, entry string, vector string"


def brute(rows, k=20, every=20):
    """The definition: k largest inner products per query, ties to the smaller id."""
    answers = {}
    for query, vector in rows:
        if query % every == 0:
            scored = sorted((-float(np.sum(np.multiply(vector, other))), i) for i, other in rows if i != query)
            answers[query] = [(i, -s) for s, i in scored[:k]]
    return answers


def recall(found, want):
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found.get(q, [])}) for q in want)
    return hits / max(1, sum(len(x) for x in want.values()))


def answers(frame):
    found = {}
    for row in frame.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(found[row["query_id"]])
    return found


@pytest.mark.parametrize("reach", [0, 5, 20, 47, 60, 127])
def test_probing_finds_every_code_within_reach(reach):
    rng = np.random.default_rng(reach)
    codes = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    codes[:200] = codes[0]
    codes[:200] ^= np.packbits(rng.random((200, 128)) < 0.3, axis=1)
    block = neighbours.Block(codes, reach)
    for code in codes[:20]:
        near = np.flatnonzero(neighbours.distances(codes, code) <= reach)
        assert block.probe(code).tolist() == near.tolist()


def test_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table.collect()]
    want, found = brute(rows), answers(neighbours.nearest(table))
    assert found.keys() == want.keys() and all(len(x) == 20 for x in found.values())
    assert recall(found, want) >= 0.9
    truth = dict(rows)
    assert all(s == pytest.approx(truth[q] @ truth[i], abs=1e-12) for q, x in found.items() for i, s in x)


def test_copies_norms_and_blocks(spark, monkeypatch):
    """A hot vector, very different norms, ties, and more blocks than one."""
    monkeypatch.setattr(neighbours, "VECTORS", 90)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    vectors[100:240] = vectors[0]
    vectors = vectors.astype(np.float32)
    rows = [(i, vectors[i].tolist(), 0, "x", "y") for i in range(400)]
    found = answers(neighbours.nearest(spark.createDataFrame(rows + rows[:40], SCHEMA)))
    want = brute([(i, vectors[i].astype(float)) for i in range(400)])
    assert found.keys() == want.keys()
    assert recall(found, want) >= 0.9
    assert [i for i, _ in found[100]] == [i for i, _ in want[100]]


def test_rows_that_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(20 * i, v, 0, "x", "y") for i, v in enumerate(bad)] + [(None, [1.0, 1.0], 0, "x", "y")]
    good = [(200, [1.0, 0.0]), (201, [2.0, 0.0]), (203, [2.0, 0.0]), (220, [0.0, 1.0])]
    table = spark.createDataFrame(rows + [(*x, 0, "x", "y") for x in good], SCHEMA)
    found = answers(neighbours.nearest(table))
    assert found == {200: [(201, 2.0), (203, 2.0), (220, 0.0)], 220: [(200, 0.0), (201, 0.0), (203, 0.0)]}


def test_empty_table(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
