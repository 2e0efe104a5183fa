"""Quality rules against plain Python, and the ledger's policies."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from llm.conftest import MESSY

from undertow.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {window for window, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_measures(spark, messy):
    rng = random.Random(5)
    texts = [text for _, text, _ in MESSY]
    texts += [" ".join(rng.choices("abcd", k=rng.randrange(40))) + "\n" + rng.choice("a&*") for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row["doc_id"]: row.asDict() for row in rules.measure(docs).collect()}
    for number, text in enumerate(texts):
        want = expected(text)
        assert {k: found[number][k] for k in want} == want
    assert rules.measure(messy).count() == len(MESSY)


def test_empty_table(nothing):
    assert rules.judge(rules.measure(nothing)).collect() == []
    assert {r["n_failed"] for r in rules.ablation(rules.measure(nothing)).collect()} <= {0}


def test_policies_and_ablation(documents):
    good = " ".join(f"word{i}" for i in range(80))
    shout = " ".join(f"WORDS{'ABCDEFGH'[i % 8]}{'XYZ'[i % 3]}{i}" for i in range(80))
    symbols = " ".join(f"word{i}###" for i in range(80))
    docs = documents([(1, good, "a"), (2, "few words", "a"), (3, shout, "a"), (4, symbols, "a"), (5, "### ###", "a")])
    ledger = rules.measure(docs)
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.judge(ledger).collect()}
    assert kept == {1: (False, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, False)}
    base = {r["doc_id"]: r["kept"] for r in rules.judge(ledger, "base").collect()}
    assert base == {1: True, 2: False, 3: True, 4: True, 5: False}
    counts = {r["rule"]: tuple(r)[1:] for r in rules.ablation(ledger).collect()}
    assert counts["few_words"] == (2, 1, 2)
    assert counts["symbols"] == (2, 1, 2)
    assert counts["shouting"] == (1, 1, 2)


@pytest.mark.parametrize("policy", ["v1", "base"])
def test_masks_name_known_rules(policy):
    assert set(rules.POLICIES[policy]) <= {rule.name for rule in rules.RULES}
