"""Alignments against the libraries' own tokens and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from llm.conftest import MESSY
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from undertow.llm import alignment

PATH_A, PATH_B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def tokens(text, libraries):
    """(id, bytes) of both tokenizers, or nothing."""
    if not text:
        return [], []
    a, b = libraries
    byte_of = {letter: byte for byte, letter in alignment.byte_spelling().items()}
    side_a = [(i, bytes(byte_of[x] for x in a.id_to_token(i)))
              for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    for side in (side_a, side_b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
    return side_a, side_b


def groups(side_a, side_b):
    found, a, b, at_a, at_b = [], [], [], 0, 0
    rest = iter(side_b)
    for i, spelling in side_a:
        a.append(i)
        at_a += len(spelling)
        while at_b < at_a:
            j, other = next(rest)
            b.append(j)
            at_b += len(other)
        if at_a == at_b:
            found.append((a, b))
            a, b = [], []
    return found


def expected(rows, libraries):
    both = [tokens(text, libraries) for _, text in rows]
    cut = [groups(*sides) for sides in both]
    links = [Counter((a, b) for x, y in doc for a in x for b in y) for doc in cut]
    held = Counter(pair for doc in links for pair in doc)
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (
            doc_id, len(sides[0]), len(sides[1]), len(doc), sum(found.values()),
            sum(n for pair, n in found.items() if held[pair] == most[pair[0]]),
            sum(n * held[pair] for pair, n in found.items()),
            ";".join("|".join(",".join(map(str, x)) for x in group) for group in doc),
        )
        for (doc_id, _), sides, doc, found in zip(rows, both, cut, links)
    ]


def plain(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("block, large", [(alignment.BLOCK_BYTES, 256), (500, 3)])
def test_random_texts(spark, libraries, monkeypatch, block, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    rng = random.Random(block)
    texts = [None, "", " ", "   x", "▁ a", "a▁b", "x" * 3000, " " * 2500, "=-" * 900, "\x1c a\x85b",
             "<|endoftext|> <s></s> <unk> <0x41>", *(text for _, text, _ in MESSY)]
    alphabets = ["abc  \n", "aeiouth ", "日本é語🙂 x", "12 34,.", "\t\r\n x", "i̇ßΣς'sé ", " ​᠎a b"]
    for _ in range(120):
        texts.append("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 400))))
    rows = list(enumerate(texts)) + [(3, "   x"), (3, "   x"), (None, "one two"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(expected(rows, libraries), key=str)
    assert plain(alignment.align(docs, PATH_A, PATH_B, block_bytes=block)) == want
    hashed = [(*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "") for row in want]
    assert plain(alignment.align(docs, PATH_A, PATH_B, True, block)) == sorted(hashed, key=str)


def test_clashing_columns_and_empty_table(messy, nothing, libraries):
    clashing = messy.select("*", F.lit("x").alias("pair"), F.lit("y").alias("block"), F.lit(1).alias("docs"))
    rows = [(i, text) for i, text, _ in MESSY]
    assert plain(alignment.align(clashing, PATH_A, PATH_B)) == sorted(expected(rows, libraries), key=str)
    assert alignment.align(nothing, PATH_A, PATH_B).collect() == []


def test_the_faster_library_agrees_on_settled_texts(libraries):
    mine, rng = alignment.ByteLevel(PATH_A), random.Random(8)
    letters = [chr(x) for x in [*range(0x20, 0x2100), *range(0x3000, 0x3100), *range(0x4E00, 0x4E80)] if chr(x).isprintable()]
    for _ in range(600):
        text = "".join(rng.choices(rng.choice([letters, letters[:700], "ab's 1²½\n\t "]), k=rng.randrange(60)))
        assert mine.encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_a_group_over_many_ids_is_not_expanded_by_occurrence(libraries):
    aligner = alignment.Aligner(PATH_A, PATH_B, False)
    block = aligner.block(0, [1], ["͸" * 20_000 + "a" * 50_000])
    docs = alignment.from_bytes(block.column("docs")[0].as_py())
    assert docs.column("n_pairs")[0].as_py() < 5_000
