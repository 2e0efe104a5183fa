"""Suffix dedup against a plain search for every string, and its parts by themselves."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from llm.conftest import MESSY
from pyspark.sql import functions as F

from undertow.llm import suffixes


def expected(rows, length):
    """Spans removed from each (doc_id, text), and what is left; a null id comes before all others."""
    rank = lambda i: (i is not None, i or 0)
    least, found = {}, []
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            least[w] = min(least.get(w, rank(i)), rank(i))
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if least[data[p : p + length]] < rank(i):
                gone[p : p + length] = b"\1" * length
        spans = [p for p in range(len(data)) if gone[p] and not (p and gone[p - 1])]
        ends = [p + 1 for p in range(len(data)) if gone[p] and not (p + 1 < len(data) and gone[p + 1])]
        found.append((i, len(data), list(zip(spans, ends)), bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(found, key=str)


def plain(frame):
    return sorted(
        ((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in frame.collect()),
        key=str,
    )


def passages(rng, n):
    shared = ["".join(rng.choices("abcde é", k=rng.randrange(30, 150))) for _ in range(12)]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            part = rng.choice(shared)
            cut = rng.randrange(len(part)) if rng.random() < 0.5 else 0
            parts.append(part[cut:] if rng.random() < 0.7 else "".join(rng.choices("xyz \n\0", k=rng.randrange(60))))
        yield "".join(parts)


@pytest.mark.parametrize("length, hot, records", [(50, 1000, 200_000), (20, 3, 50), (50, 2, 300)])
def test_against_plain_search(spark, length, hot, records):
    rng = random.Random(length + hot)
    texts = [None, "", "a" * 49, "a" * 50, "a" * 400, "ab" * 300, "b" + "ab" * 200, "\0" * 120, "x" + "\0" * 90]
    texts += list(passages(rng, 150))
    rows = list(enumerate(texts)) + [(3, texts[6]), (3, texts[6]), (None, texts[-1]), (None, texts[-2]), (70, texts[-3])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert plain(suffixes.dedupe(docs, length, hot, records)) == expected(rows, length)




@pytest.mark.parametrize("seed", range(6))
def test_merge_of_runs(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(b"ab\0", k=rng.randrange(16, 40))) for _ in range(rng.randrange(1, 300))]
    runs = [sorted(texts[i :: seed + 1]) for i in range(seed + 1) if texts[i :: seed + 1]]
    coded = [(run, [0, *(len(os.path.commonprefix(pair)) for pair in zip(run, run[1:]))]) for run in runs]
    run, place, lcp = suffixes.merge(coded)
    merged = [runs[r][p] for r, p in zip(run, place)]
    assert merged == sorted(texts)
    assert list(lcp) == [0, *(len(os.path.commonprefix(pair)) for pair in zip(merged, merged[1:]))]


def test_merge_compares_no_known_prefix():
    """Heads with a long common prefix are read from its end on."""
    read = []

    class Watched(bytes):
        def __getitem__(self, key):
            read.append(key)
            return bytes.__getitem__(self, key)

    runs = [[Watched(b"p" * 1000 + bytes([x, y])) for x in range(4)] for y in range(3)]
    suffixes.merge([(run, [0, 1000, 1000, 1000]) for run in runs])
    early = [key for key in read if (key.start if isinstance(key, slice) else key) < 1000]
    assert len(read) > 20 and len(early) <= 2 * (len(runs) - 1) + 2 * 1000 * (len(runs) - 1)


def test_front_coding():
    run = sorted(os.urandom(2).hex().encode() * 9 for _ in range(200))
    lcp = np.array([0, *(len(os.path.commonprefix(pair)) for pair in zip(run, run[1:]))])
    sizes = np.array([len(x) for x in run])
    rest = b"".join(x[h:] for x, h in zip(run, lcp))
    assert suffixes.decoded(lcp, sizes, rest)[0] == run


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_equal_windows_have_the_anchor_at_the_same_place(monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(2)
    data = bytes(rng.choices(b"ab", k=4000)) + b"a" * 200
    offsets = {}
    at, lo, hi, _ = suffixes.anchors(np.frombuffer(data, dtype=np.uint8), 50)
    covered = 0
    for a, first, last in zip(at, lo, hi):
        for p in range(first, last + 1):
            assert 0 <= a - p <= 34
            assert offsets.setdefault(data[p : p + 50], a - p) == a - p
            covered += 1
    assert covered == len(data) - 49


def test_clashing_columns_and_empty_table(messy, nothing):
    clashing = messy.select("*", *(F.lit(x).alias(x) for x in ("doc", "tag", "slot", "keys", "spans", "first", "h", "row2", "kept")))
    rows = [(i, text) for i, text, _ in MESSY]
    found = suffixes.dedupe(clashing)
    assert plain(found) == expected(rows, 50)
    names = ("size", "score", "row", "j", "`odd.name`", "doc", "tag", "spans")
    assert found.select(*names).distinct().collect() == clashing.select(*names).distinct().collect()
    assert suffixes.dedupe(nothing).collect() == []


def test_texts_are_shuffled_once(messy):
    frame = suffixes.dedupe(messy.select("doc_id", "text"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange [doc_id") == 1


def test_query_digest(spark):
    text = "0123456789" * 12
    docs = spark.createDataFrame([(1, text), (2, "start " + text)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffixes.dedupe(docs).collect()}
    assert bytes(rows[2]["kept"]) == b"start " and rows[1]["removed"] == []
    assert hashlib.sha256(bytes(rows[1]["kept"])).digest() == hashlib.sha256(text.encode()).digest()


def random_texts(spark, n, size, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop", k=size))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return docs.selectExpr("doc_id AS doc", "xxhash64(text) AS tag", "text").sortWithinPartitions("doc", "tag")


def test_names_of_anchors_do_not_grow_with_the_slots(spark):
    """Four bytes and a part of one for each half, however many slots share them out."""
    texts = random_texts(spark, 300, 3_000, 1)
    halves = sum(len(suffixes.anchors(np.frombuffer(r["text"].encode(), np.uint8), 50)[0]) for r in texts.collect())
    sizes = []
    for slots in (8, 200):
        rows = suffixes.dealt_anchors(texts, 50, slots).collect()
        sizes.append(sum(len(x) for row in rows for x in row[2:] if x) / halves)
    assert sizes[1] < 6 and sizes[1] - sizes[0] < 1.2


def test_strings_of_sixteen_bytes_that_repeat_by_chance_make_no_record(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=20)) for _ in range(40)]
    fresh = lambda: "".join(rng.choices("qrstuvwxyz", k=25))
    rows = [(i, "".join(rng.choice(words) + fresh() for _ in range(20))) for i in range(40)]
    passage = "".join(rng.choices("ABCDEFGH", k=60))
    rows += [(50, fresh() + passage), (51, fresh() + passage + fresh())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.selectExpr("doc_id AS doc", "xxhash64(text) AS tag", "text").sortWithinPartitions("doc", "tag")
    found = suffixes.of_documents(suffixes.shared_anchors(suffixes.dealt_anchors(docs, 50, 4), 1000, 4)).collect()
    assert sorted(row["doc"] for row in found) == [50, 51]


def test_a_string_is_hot_by_its_part_of_a_slot():
    """3,000 places of one string are many in a small slot and few in a large one."""
    rng = np.random.default_rng(5)
    for others, is_hot in ((10_000, True), (1_000_000, False)):
        half, string = rng.integers(0, 3, 3_000), np.uint32(77 << suffixes.HALF_BITS)  # in three wordings
        lone = np.arange(others, dtype=np.uint32) + np.uint32(100 << suffixes.HALF_BITS)
        names = np.concatenate([string + half.astype(np.uint32), lone])
        shared, hot = suffixes.held_by_others(names, np.arange(len(names)), 1_000)
        assert shared[:3_000].all() and not shared[3_000:].any()
        assert (hot == (shared & is_hot)).all()
    assert not suffixes.held_by_others(np.zeros(5_000, np.uint32), np.zeros(5_000, np.int64), 1)[0].any()
