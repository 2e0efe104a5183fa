"""Guess-and-verify encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from undertow.llm import bpe

from llm.conftest import MESSY

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "x<|endoftext|>y <|startoftext|>", "\x1c\x1d a\x85b᠎ c​d ﻿",
    "don't I'll 'S we'VE", "日本語 123 ½ Ⅷ ²", "é é ẛ̣ ﬁ", "a" * 700, "\0abc \0<|endoftext|>", "👍🏽 !!!! ????",
    "ǅ ß ẞ ſ K Ⴀ", "<|ENDOFTEXT|>", "­؀ ‮", "⮖ Ɤ ₝", "é" * 300,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def random_texts():
    rng = random.Random(1)
    ranges = [(32, 127), (128, 592), (592, 0x3000), (0x3000, 0xD7FF), (0x1F300, 0x1F700)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(30)) for _ in range(400)]
    return texts + ["".join(rng.choices("aeioutnsr lh", k=60)) for _ in range(400)]


def test_whole_texts(spark, library, documents):
    texts = [*ODD, *(text for _, text, _ in MESSY), *random_texts()]
    docs = documents([(i, text, "a") for i, text in enumerate(texts)])
    rows = bpe.encode(docs, PATH, ("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == decoded
        joined = " ".join(map(str, ids)).encode()
        assert row["ids_sha256"] == hashlib.sha256(joined).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_seams_agree_with_exact_merging(codec):
    """A pair of tokens holds exactly if merging its letters gives the pair back."""
    rng = random.Random(2)
    by_id = {number: text for text, number in codec.ids.items()}
    inner = [n for n, text in by_id.items() if not text.endswith(bpe.END) and len(text) < 6]
    ends = [n for n, text in by_id.items() if text.endswith(bpe.END) and len(text) < 6]
    a, b = np.array(rng.choices(inner, k=3000)), np.array(rng.choices(ends, k=3000))
    merged = codec.exact([by_id[x] + by_id[y] for x, y in zip(a.tolist(), b.tolist())])
    assert codec.holds(a, b).tolist() == [m == [x, y] for m, x, y in zip(merged, a.tolist(), b.tolist())]


def test_long_and_short_merging_agree(codec):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randrange(2, 40))) + bpe.END for _ in range(300)]
    first = [[codec.ids[x] for x in (*word[:-2], word[-2:])] for word in words]
    assert codec.exact(words) == [codec.merge_long(list(tokens)) for tokens in first]


def test_kept_words_are_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    for text in random_texts()[-40:]:
        words = codec.split_words(text)
        codec.keep(set(words))
        ids = " ".join(codec.words[word][0] for word in words)
        assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_empty_table(nothing):
    assert bpe.encode(nothing, PATH).collect() == []


def test_memory_of_new_words_is_bounded(codec, monkeypatch):
    """What encoding needs besides the kept words does not grow with the new words of a batch."""
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcdeinorst", k=rng.randrange(4, 20))) for _ in range(60_000)})

    def peak(count):
        fresh = bpe.Codec.of(dict(vars(codec), words={}, older={}))
        tracemalloc.start()
        fresh.keep(set(words[:count]))
        kept, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return most - kept

    assert peak(60_000) < 2 * peak(15_000)


def test_words_in_use_outlive_a_generation(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    fresh = bpe.Codec.of(dict(vars(codec), words={}, older={}))
    fresh.keep({"one", "two", "three", "four"})
    seen = []
    monkeypatch.setattr(fresh, "encode_words", lambda spelt: seen.extend(spelt) or codec.encode_words(spelt))
    fresh.keep({"one", "five", "\0<|endoftext|>"})
    assert seen == ["five" + bpe.END]
    assert fresh.words["one"] == codec_entry(codec, "one") and fresh.words.keys() == {"one", "five", "\0<|endoftext|>"}


def codec_entry(codec, word):
    codec.keep({word})
    return codec.words[word]
