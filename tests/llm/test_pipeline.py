"""The stages of the pipeline on rows that each stage must catch, and on odd tables."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from undertow.session import written

from llm.conftest import MESSY

DATA = "/root/testdata/sf0.001"


def test_names_and_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "line", "SimHash", "mixing", "BPE"]


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, stage, messy, nothing):
    found = stage(spark, messy, DATA)
    assert found.dtypes == messy.dtypes
    assert {r["odd.name"] for r in found.collect()} <= {"j"}
    assert stage(spark, nothing, DATA).collect() == []


def test_each_stage(spark, documents, tmp_path):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."

    junk, passage = range(200, 240), prose(60)
    clean = [(i, "\n".join(prose(40) for _ in range(4)), "src" + "ab"[i % 2]) for i in range(40)]
    rows = [
        *clean,
        *((i, " ".join(f"ZX{rng.randrange(99)}### QW$$$" for _ in range(60)), "srca") for i in junk),
        (101, clean[0][1], "srca"),
        (102, prose(70) + "\n" + passage, "srca"),
        (103, passage + "\n" + prose(70), "srcb"),
        (104, clean[1][1].replace("\n", " "), "srcb"),
    ]
    folder = str(tmp_path)
    marks = [(i, int(i not in junk), 0) for i, _, _ in rows]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, steps = documents(rows), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        steps.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, deduped, single, mixed = steps
    ids = {i for i, _, _ in rows}
    assert good.keys() == ids - set(junk)
    assert deduped.keys() == good.keys() - {101}
    assert passage in deduped[102] and passage not in deduped[103]
    assert all(deduped[i] == text for i, text, _ in clean)
    assert single.keys() == deduped.keys() - {104}
    assert mixed.keys() <= single.keys()
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    want = []
    for row in docs.collect():
        ids = library.encode(row["text"], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((ids, hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((r["ids"], r["decoded_sha256"]) for r in encoded) == sorted(want)


def test_messy_rows_pass(spark, messy):
    docs = messy
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA))
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and docs.count() <= 3 * len(MESSY)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)
