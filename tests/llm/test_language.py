"""The interpolated model against plain dictionaries."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from undertow.llm import language

from llm.conftest import MESSY


def role(i):
    return -1 if i is None else zlib.crc32(str(i).encode()) % 5


def tokens(text):
    return (text or "").encode().translate(language.LOWER).split() + [b""]


def counted(rows):
    words, pairs = Counter(), Counter()
    for _, text in rows:
        words.update(tokens(text))
        pairs.update(zip([b"", *tokens(text)], tokens(text)))
    return words, pairs


def of_order_3(text, rows, weights):
    """The mix of four estimates, every run and context counted by its tokens."""
    runs, contexts = Counter(), Counter()
    for _, other in rows:
        line = [b"", b"", *tokens(other)]
        for at in range(2, len(line)):
            for n in (1, 2, 3):
                runs[tuple(line[at - n + 1 : at + 1])] += 1
                contexts[tuple(line[at - n + 1 : at])] += 1
    line, total = [b"", b"", *tokens(text)], 0.0
    distinct = len({run for run in runs if len(run) == 1})
    for at in range(2, len(line)):
        two, one = contexts[line[at - 2], line[at - 1]], contexts[line[at - 1],]
        bucket = 64 + two.bit_length() if two else one.bit_length()
        parts = [
            runs[tuple(line[at - 2 : at + 1])] / max(two, 1), runs[tuple(line[at - 1 : at + 1])] / max(one, 1),
            runs[line[at],] / contexts[()], 1 / (distinct + 1),
        ]
        total += math.log10(sum(w * p for w, p in zip(weights[bucket], parts)))
    return total


def scores(text, words, pairs, weights):
    n, v = sum(words.values()), len(words)
    base = model = 0.0
    for context, word in zip([b"", *tokens(text)], tokens(text)):
        c = words[context]
        after, alone, flat = weights[c.bit_length()]
        base += math.log10((words[word] + 0.5) / (n + 0.5 * (v + 1)))
        model += math.log10(after * pairs[context, word] / max(c, 1) + alone * words[word] / n + flat / (v + 1))
    return base, model


def test_against_dictionaries(documents, monkeypatch):
    weights = []
    maximise = language.maximise
    monkeypatch.setattr(language, "maximise", lambda *a: weights.append(maximise(*a)) or weights[0])
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["The", "cat", "sat", "on", "é", "mat\n"], k=rng.randrange(40)))) for i in range(120)]
    rows += [(i, text) for i, text, _ in MESSY]
    found = language.score(documents([(*row, "a") for row in rows]), block=2000, hash_range=1500).collect()
    train = [row for row in rows if role(row[0]) != 1]
    words, pairs = counted(train)
    assert len(found) == len(rows) and {r["train_tokens"] for r in found} == {sum(words.values())}
    want = Counter()
    for i, text in rows:
        known = sum(words[t] > 0 for t in tokens(text))
        want[(i, role(i), len(tokens(text)), known, *(round(s, 6) for s in scores(text, words, pairs, weights[0])))] += 1
    keys = ("doc_id", "fold", "n_tokens", "n_known")
    got = Counter(
        (*(r[k] for k in keys), round(r["base_score"], 6), round(r["score"], 6)) for r in found
    )
    assert got == want


def test_order_3_against_dictionaries(documents, monkeypatch):
    weights = []
    maximise = language.maximise
    monkeypatch.setattr(language, "maximise", lambda *a: weights.append(maximise(*a)) or weights[0])
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["The", "cat", "sat", "é", "mat\n"], k=rng.randrange(30)))) for i in range(120)]
    rows += [(i, text) for i, text, _ in MESSY]
    found = language.score(documents([(*row, "a") for row in rows]), block=2000, hash_range=1500, order=3).collect()
    train = [row for row in rows if role(row[0]) != 1]
    assert weights[0].shape == (128, 4) and len(found) == len(rows)
    want = Counter((i, len(tokens(text)), round(of_order_3(text, train, weights[0]), 6)) for i, text in rows)
    assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in found) == want


def test_repeated_rows_are_dealt_over_blocks(documents):
    docs = documents([(7, "the same row " * 20, "a")] * 400).repartition(4).select(
        "doc_id", language.fold(language.F.col("doc_id")).alias("fold"), "text"
    )
    blocks = language.packed(docs, 4000).collect()
    least = 400 * 260 // 6000  # a block has half its size more at most
    assert len(blocks) >= least and len({r["block"] for r in blocks}) == len(blocks)


@pytest.mark.parametrize("order", [2, 3])
def test_blocks_do_not_matter(documents, order):
    docs = documents([(i, f"a b c {i % 7} d e {i % 3}", "a") for i in range(60)])
    one = {r["doc_id"]: r["score"] for r in language.score(docs, order=order).collect()}
    many = {r["doc_id"]: r["score"] for r in language.score(docs, block=100, hash_range=60, order=order).collect()}
    assert one == pytest.approx(many)


def test_maximisation_finds_the_weights():
    """Tokens drawn half from the bigram, half from the unigram estimate."""
    near, far = 8, 64  # 2**-1 and 2**-8
    cells = np.array([(3 * 512 + near) * 512 + far, (3 * 512 + language.NONE) * 512 + far])
    weights = language.maximise(cells, np.array([1000, 1000]), 10**9)
    assert weights.shape == (64, 3) and np.allclose(weights.sum(1), 1)
    assert weights[3][0] == pytest.approx(0.5, abs=0.01) and (weights[9] == weights[0]).all()


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = language.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held_out = [r for r in rows if r["fold"] == language.HELD_OUT]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_tables_without_training_texts(documents, nothing):
    assert language.score(nothing).collect() == []
    held_out = next(i for i in range(100) if role(i) == 1)
    row = language.score(documents([(held_out, "only this", "a")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert math.isfinite(row["score"]) and math.isfinite(row["base_score"])
