"""SimHash links and components against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from undertow.llm import simhash
from undertow.llm.components import components

from llm.conftest import LINE, MESSY


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(value):
    return int(np.uint64(value).astype(np.int64))


def roots(values, linked):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(values))]


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_every_fingerprint_within_two_bits_meets_at_an_anchor():
    anchors, rng = simhash.Anchors(), np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63 - 1, 5000)
    home, others = anchors.of(prints)
    for flips in (1, 2):
        moved = prints.copy()
        for _ in range(flips):
            moved ^= np.left_shift(np.int64(1), rng.integers(0, 64, len(moved)))
        there, _ = anchors.of(moved)
        assert ((others == there[:, None]).any(1) | (home == there)).all()


@pytest.mark.parametrize("hot", [simhash.HOT, 3, 0])
def test_links(spark, hot):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(500):
        value = rng.choice(values[:200])
        for _ in range(rng.randrange(4)):
            value ^= 1 << rng.randrange(64)
        values.append(value)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = [tuple(sorted(map(int, row))) for row in simhash.links(prints, hot).collect()]
    distinct = sorted(set(values))
    want = {
        tuple(sorted((signed(a), signed(b)))) for n, a in enumerate(distinct) for b in distinct[:n] if near(a, b)
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = list(range(1, 60))
    rng.shuffle(chain)
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(100, n) for n in range(101, 160)] + [(7, 7), (200, 201)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: 1 for n in range(2, 60)} | {n: 100 for n in range(101, 160)} | {201: 200}


def test_documents(spark, documents):
    rng, rows = random.Random(6), []
    for group in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 300))]
        for _ in range(rng.randrange(1, 5)):
            rows.append((len(rows) * 7 % 101 + 101 * len(rows), " ".join(words).title() + " " * group, "a"))
            words[rng.randrange(len(words))] = "edited"
    rows += [(i, text, source) for i, text, source in MESSY if i is not None]
    prints = [fingerprint(text) for _, text, _ in rows]
    root = roots(prints, near)
    least = {r: min(rows[n][0] for n in range(len(rows)) if root[n] == r) for r in set(root)}
    want = sorted((rows[n][0], signed(prints[n]), least[root[n]]) for n in range(len(rows)))
    docs = documents(rows)
    found = simhash.link(docs)
    assert found.columns == ["doc_id", "fp", "component_id"]
    assert sorted(map(tuple, found.collect())) == want
    kept = simhash.dedupe(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_null_ids_and_empty_tables(documents, nothing):
    rows = simhash.link(documents([(None, LINE, "a"), (None, LINE, "a"), (5, "", "a"), (4, None, "a")])).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in rows))) == [
        "(4, 4)", "(5, 4)", "(None, None)", "(None, None)"
    ]
    assert simhash.dedupe(documents([(None, LINE, "a"), (None, LINE, "a"), (9, LINE, "a")])).count() == 1
    assert simhash.link(nothing).collect() == [] and simhash.dedupe(nothing).collect() == []
