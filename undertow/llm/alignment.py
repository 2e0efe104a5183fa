"""Align the tokens of two tokenizers over the same bytes, and count which ids stand for each other.

Tokenizer A is a byte-level BPE that sees a space and the text, tokenizer B a model of pieces with byte
fallback that puts the space there itself, so both spell the same bytes. Per text the byte offsets at
which tokens end go into one dictionary per tokenizer, from end to number of tokens. The keys that both
hold, sorted, cut the two id lists into groups of the same bytes; a group links each of its A tokens
with each of its B tokens. Links are expanded per group; a large group is expanded over its distinct
ids with their multiplicities, so a text that shares few ends costs what its distinct pairs cost.

Counting over the corpus: texts are encoded once, in blocks of some megabytes. A block keeps a dictionary
of its id pairs, with the number of its documents that hold each, and per document the places of its
pairs there. Only (pair, block, documents) is shuffled by pair, summed before and after, and what the
whole corpus says of a pair goes back to the blocks that asked. A pair found everywhere has one row per
block, and rows of such pairs are split by Spark's skew join.

Texts that are null, empty, or not spelt by both tokenizers byte for byte (U+2581 comes back as a space)
have no tokens: zeros and an empty alignment. Rows are documents of their own: repeated rows, equal
and null ids count each. Columns other than `doc_id` and `text` are not read. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from undertow.llm.bpe import byte_spelling
from undertow.llm.words import pieces
from undertow.session import written

SPACE = "▁"  # how the model of pieces spells a space
BLOCK_BYTES = 2 << 20
#: Groups with more links than this are expanded over their distinct ids.
LARGE_GROUP = 256
B_BITS = 16
#: First and last code points that regular expressions of different libraries may see differently.
ODD_CODES = (
    (0x1C, 0x1F), (0x85, 0x85), (0x180E, 0x180E), (0x200B, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064),
    (0xFEFF, 0xFEFF),
)
ODD = {chr(code) for first, last in ODD_CODES for code in range(first, last + 1)}
#: Runs of white space or of anything else that regular expressions might stumble over.
LONG_RUN = 2_000
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")

NO_IDS = np.zeros(0, dtype=np.int32)
BLOCKS = "block long, pairs binary, in_docs binary, docs binary, links binary"
DOC_FIELDS = [
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_pairs", pa.int64()), ("groups", pa.string()),
]
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " {groups} string"
)


class ByteLevel:
    """Byte-level BPE of a tokenizers file: ids of a text, and the bytes of each id.

    Merges come in the order of the ids they make, so the ids serve as ranks for the faster library;
    texts with characters that its regular expressions might class otherwise go to the file's own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: byte for byte, letter in byte_spelling().items()}
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        plain = {
            bytes(map(byte_of.__getitem__, token)): number
            for token, number in spec["model"]["vocab"].items() if token not in special
        }
        size = max([*plain.values(), *special.values()]) + 1
        self.spelling = [b""] * size
        for token, number in plain.items():
            self.spelling[number] = token
        self.fast = tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={}
        )
        self.path, self.exact = path, None
        self.settled = set(map(chr, range(128))) - ODD

    def is_settled(self, text: str) -> bool:
        """Whether all characters have been assigned since Unicode 3.2, and none is odd."""
        fresh = set(text) - self.settled
        self.settled |= {x for x in fresh if x not in ODD and unicodedata.ucd_3_2_0.category(x) != "Cn"}
        if not fresh <= self.settled:
            return False
        if len(text) < LONG_RUN:
            return True
        return max(map(len, text.split()), default=0) < LONG_RUN and not LONG_SPACE.search(text)

    def encode(self, text: str) -> np.ndarray:
        if self.is_settled(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.exact is None:
            self.exact = Tokenizer.from_file(self.path)
            self.exact.encode_special_tokens = True
        return as_array(self.exact.encode(text, add_special_tokens=False).ids)


class PieceModel:
    """A model of pieces with byte fallback: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelling = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(number)
            else piece.replace(SPACE, " ").encode("utf-8")
            for number, piece in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        ]

    def encode(self, text: str) -> np.ndarray | None:
        """None if the ids do not spell a space and the text."""
        ids = self.model.encode(text)
        if b"".join(map(self.spelling.__getitem__, ids)) != b" " + text.encode("utf-8"):
            return None
        return as_array(ids)


def as_array(ids: list[int]) -> np.ndarray:
    return np.frombuffer(array("i", ids), dtype=np.int32)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of A and of B tokens up to each byte offset where tokens of both end."""
    upto_a, upto_b = dict(zip(ends_a.tolist(), count(1))), dict(zip(ends_b.tolist(), count(1)))
    shared = sorted(upto_a.keys() & upto_b.keys())
    return list(map(upto_a.__getitem__, shared)), list(map(upto_b.__getitem__, shared))


def spelt(sides: list[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]) -> list[str]:
    """The ids of both sides group by group: each id with the mark behind it.

    A side has its ids, the size of every group, and the ids spelt with each mark: a comma within the
    group, the side's own mark behind its last.
    """
    sizes = [size for _, size, _ in sides]
    before = [np.cumsum(sizes[1]) - sizes[1], np.cumsum(sizes[0])]  # ids of the other side
    parts = np.empty(sum(len(ids) for ids, _, _ in sides), dtype=object)
    for (ids, size, names), other in zip(sides, before):
        within, behind = names.values()
        marked = within[ids]
        last = np.cumsum(size) - 1
        marked[last] = behind[ids[last]]
        parts[np.repeat(other, size) + np.arange(len(ids))] = marked
    return parts.tolist()


def expand(
    starts_a: np.ndarray, sizes_a: np.ndarray, starts_b: np.ndarray, sizes_b: np.ndarray,
    ids_a: np.ndarray, ids_b: np.ndarray, docs: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, id pair and multiplicity of the links of every group."""
    links = sizes_a * sizes_b
    small = np.flatnonzero(links <= LARGE_GROUP)
    group = np.repeat(small, links[small])
    inner = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    width = sizes_b[group]
    a = ids_a[starts_a[group] + inner // width]
    b = ids_b[starts_b[group] + inner % width]
    found = [(docs[group], (a << B_BITS) | b, np.ones(len(group), dtype=np.int64))]
    for g in np.flatnonzero(links > LARGE_GROUP):
        a, n_a = np.unique(ids_a[starts_a[g] : starts_a[g] + sizes_a[g]], return_counts=True)
        b, n_b = np.unique(ids_b[starts_b[g] : starts_b[g] + sizes_b[g]], return_counts=True)
        pairs = ((a[:, None] << B_BITS) | b[None, :]).ravel()
        found.append((np.full(len(pairs), docs[g]), pairs, (n_a[:, None] * n_b[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


class Aligner:
    """Encodes and aligns texts, block by block."""

    def __init__(self, path_a: str, path_b: str, digest: bool):
        self.a, self.b, self.digest = ByteLevel(path_a), PieceModel(path_b), digest
        self.sizes = [np.array([len(x) for x in side.spelling]) for side in (self.a, self.b)]
        self.names = [
            {mark: np.array([f"{n}{mark}" for n in range(len(side.spelling))], dtype=object) for mark in marks}
            for side, marks in ((self.a, ",|"), (self.b, ",;"))
        ]
        self.zstd = zstandard.ZstdCompressor(level=3)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, if both spell the text. Bytes are only grouped by A, so their number tells."""
        ids_b = self.b.encode(text) if text else None
        if ids_b is not None:
            ids_a = self.a.encode(" " + text)
            if self.sizes[0][ids_a].sum() == self.sizes[1][ids_b].sum():
                return ids_a, ids_b
        return NO_IDS, NO_IDS

    def block(self, number: int, doc_ids: list, texts: list) -> pa.RecordBatch:
        """One row for some documents: their pairs, and per document its counts and pairs."""
        ids, cuts, per_doc = ([], []), ([], []), []
        n_tokens = [0, 0]
        for text in texts:
            both = self.tokens(text)
            upto = common_ends(*(np.cumsum(size[x]) for size, x in zip(self.sizes, both)))
            for side in (0, 1):
                cuts[side].append(as_array(upto[side]) + np.int64(n_tokens[side]))
                ids[side].append(both[side])
                n_tokens[side] += len(both[side])
            per_doc.append((len(both[0]), len(both[1]), len(upto[0])))
        n_a, n_b, n_groups = map(np.array, zip(*per_doc))
        ids_a, ids_b = (np.concatenate(x).astype(np.int64) for x in ids)
        ends_a, ends_b = map(np.concatenate, cuts)
        starts_a, starts_b = (np.concatenate([[0], x])[:-1] if len(x) else x for x in (ends_a, ends_b))
        sizes_a, sizes_b = ends_a - starts_a, ends_b - starts_b
        docs = np.repeat(np.arange(len(texts)), n_groups)
        parts = spelt([(ids_a, sizes_a, self.names[0]), (ids_b, sizes_b, self.names[1])])
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(parts[end - n : end])[:-1] for end, n in zip(ends, (n_a + n_b).tolist())]
        if self.digest:
            groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
        doc, pair, times = expand(starts_a, sizes_a, starts_b, sizes_b, ids_a, ids_b, docs)
        pairs, place = np.unique(pair, return_inverse=True)
        held, where = np.unique(doc * max(1, len(pairs)) + place, return_inverse=True)
        times = np.bincount(where, times, len(held)).astype(np.int64) if len(held) else np.zeros(0, np.int64)
        doc, place = held // max(1, len(pairs)), held % max(1, len(pairs))
        table = pa.table({
            "doc_id": pa.array(doc_ids, pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": n_groups,
            "n_links": np.bincount(docs, sizes_a * sizes_b, len(texts)).astype(np.int64),
            "n_pairs": np.bincount(doc, minlength=len(texts)), "groups": pa.array(groups, pa.string()),
        }, schema=pa.schema(DOC_FIELDS))
        links = np.concatenate([place, times]).astype(np.int64)
        links = links.view(np.uint8).reshape(-1, 8).T.tobytes()  # bytes of equal weight side by side
        row = [
            number, pairs.tobytes(), np.bincount(place, minlength=len(pairs)).astype(np.int64).tobytes(),
            as_bytes(table), self.zstd.compress(links),
        ]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = [field.split()[0] for field in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)


def as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def encode_blocks(docs: DataFrame, path_a: str, path_b: str, digest: bool, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, digest)
        first = TaskContext.get().partitionId() << 32
        number, ids, texts, held = count(first), [], [], 0
        for batch in pieces(batches, size):
            ids += batch.column("doc_id").to_pylist()
            texts += batch.column("text").to_pylist()
            held += batch.nbytes
            if held >= size:
                yield aligner.block(next(number), ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield aligner.block(next(number), ids, texts)

    return docs.mapInArrow(run, BLOCKS)


def pairs_of_blocks(blocks: DataFrame) -> DataFrame:
    """pair, block and the number of the block's documents that hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n = (np.frombuffer(row[x], dtype=np.int64) for x in ("pairs", "in_docs"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs), pa.array(np.full(len(pairs), row["block"])), pa.array(n)],
                    names=["pair", "block", "n"],
                )

    return blocks.select("block", "pairs", "in_docs").mapInArrow(run, "pair long, block long, n long")


def answers(asked: DataFrame) -> DataFrame:
    """block, pair, `held` (documents that hold the pair) and `best` (no pair of its A id is held by more)."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("held"))
    counts = counts.withColumn("a", F.shiftright("pair", B_BITS))
    most = counts.groupBy("a").agg(F.max("held").alias("most"))
    known = counts.join(most, "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best"))
    return asked.select("pair", "block").join(known.hint("merge"), "pair").select("block", "pair", "held", "best")


def finish(blocks: DataFrame, told: DataFrame, column: str) -> DataFrame:
    schema = RESULT.format(groups=column)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        held = found.column("held").to_numpy()[order].astype(np.int64)
        best = found.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        done = []
        for row in mine.to_pylist():
            docs = from_bytes(row["docs"])
            links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["links"]), dtype=np.uint8)
            place, times = links.reshape(8, -1).T.copy().view(np.int64).reshape(2, -1)
            ends = np.cumsum(docs.column("n_pairs").to_numpy())
            totals = []
            for value in (best, held):
                upto = np.concatenate([[0], np.cumsum(value[place] * times)])
                totals.append(pa.array(np.diff(upto[np.concatenate([[0], ends])])))
            plain = [docs.column(x).combine_chunks() for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            done.append(pa.table([*plain, *totals, docs.column("groups").combine_chunks()], names=names))
        return pa.concat_tables(done) if done else pa.table({n: [] for n in names})

    return blocks.select("block", "docs", "links").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def align(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document its tokens, groups and links, `n_best`, `count_sum` and the alignment itself.

    `groups` lists the groups as `a1,a2|b1;a3|b2,b3`; with `digest` there is `groups_sha256` instead.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = written(encode_blocks(docs, path_a, path_b, digest, block_bytes), "aligned-blocks")
    told = answers(pairs_of_blocks(blocks))
    return finish(blocks, told, "groups_sha256" if digest else "groups")
