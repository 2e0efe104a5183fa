"""Spliced token counts against the library on whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from undertow.llm import token_counts

from llm.conftest import MESSY

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk, overlap", [(token_counts.CHUNK, token_counts.OVERLAP), (50, 4), (40, 1)])
def test_whole_texts(spark, documents, chunk, overlap):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(chunk)
    texts = [" ", "   x", "▁ a", "a" * 3000, " " * 2500, "=-" * 2000, *(text for _, text, _ in MESSY)]
    for _ in range(150):
        letters = rng.choice(["abc  \n", "aeiouth ", "日本é語🙂 x", "ab", "  ", "<s></s><0x41> q"])
        texts.append("".join(rng.choices(letters, k=rng.randrange(1, 900))))
    docs = documents([(i, text, "a") for i, text in enumerate(texts)])
    rows = token_counts.count(docs, PATH, chunk, overlap).collect()
    found = {row["doc_id"]: (row["n_bytes"], row["n_tokens"]) for row in rows}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert found[i] == (len((text or "").encode()), len(library.encode(text or "")))


def test_messy_ids_and_empty_table(messy, nothing):
    rows = token_counts.count(messy, PATH, 2000, 16).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _, _ in MESSY)
    assert token_counts.count(nothing, PATH).collect() == []


def test_stable_places_stand_in_no_piece():
    pieces = token_counts.Pieces(PATH)
    assert {"th", "▁t"} <= pieces.inside
    text = "the end\nof it"
    assert all(text[at - 1 : at + 1].replace(" ", "▁") not in pieces.inside for at in pieces.stable(text, 0, 99))
