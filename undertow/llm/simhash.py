"""SimHash near-duplicates by covering all fingerprints with anchors.

A text is lower-cased (A-Z), cut into words, and its shingles of consecutive words (repeats included)
vote on 64 bits by their XXH64. Two fingerprints are linked if they differ in at most two bits.

Anchors are the code words of a covering code: 64 bits are three blocks, padded to 23 bits each, and
a block's anchor is the word of the perfect Golay code within three bits of it. So every fingerprint
has one home among 2**36 anchors. A fingerprint is also sent to every other anchor that is home to
anything within two bits of it (about 120, all within covering radius plus threshold). Which ones
follows from its three syndromes by table. At each anchor the guests are compared with those at home,
the smaller of a pair as guest; so every pair within the threshold meets exactly once.

Copies share a fingerprint and are combined first; links are only sought between different ones. A
fingerprint has at most 2,080 links. If more than `HOT` fingerprints are at home at one anchor (many
near copies of one text), the finest code takes over there, in which every point is its own anchor:
guests are sent to all 2,080 points within two bits, and meet by equality. So no anchor compares a
number of pairs that grows with the square of its fingerprints.

Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows and ties
share a component; a component's id is its smallest doc_id, null only if all its ids are null. Other
columns are not read by `link` and kept by `dedupe`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.components import components
from undertow.llm.words import columns, spare
from undertow.session import written

SHINGLE, SEED = 3, 42
HOT = 4_096
VOTES = 1 << 16  # hashes whose bits are counted at once
BATCH = 2_048  # fingerprints whose anchors are made at once

GOLAY = 0b110001110101  # generator polynomial of the perfect code of 23 bits and 12 free ones
LENGTH, CHECKS = 23, 11
BLOCKS = ((0, 23), (23, 23), (46, 18))  # first bit and number of bits
MASKS = [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def vote(text: bytes | None, shingle: int) -> int:
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    parts = map(joined.__getitem__, map(slice, starts.tolist(), ends[width - 1 :].tolist()))
    hashes = np.fromiter(
        map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), dtype="<u8", count=len(starts)
    )
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), VOTES):
        octets = hashes[at : at + VOTES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64 bits as a signed long."""

    @F.arrow_udf("long")
    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(
                [vote(x.as_py(), shingle) for x in batch.cast(pa.large_binary())], pa.int64()
            )

    return votes(text.cast("string"))


def remainders(words: np.ndarray) -> np.ndarray:
    """What is left of each 23-bit word modulo the generator: zero for words of the code."""
    words = words.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - CHECKS), 0)
    return words


class Anchors:
    """Tables by syndrome of what must be flipped to get from a fingerprint's home to its anchors."""

    def __init__(self):
        flips = [0] + [sum(1 << b for b in x) for n in (1, 2, 3) for x in combinations(range(LENGTH), n)]
        errors = np.zeros(1 << CHECKS, dtype=np.int64)
        errors[remainders(np.array(flips))] = flips
        self.errors = errors
        self.one, self.two = zip(*(self.offsets(width) for _, width in BLOCKS))

    def offsets(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """By syndrome: other homes after one flip, and further ones after two; 0 fills up."""
        singles = [1 << bit for bit in range(width)]
        doubles = [a | b for a, b in combinations(singles, 2)]

        def homes(flips: list[int]) -> np.ndarray:
            flip = np.array(flips)
            syndromes = np.arange(1 << CHECKS)[:, None]
            moved = flip ^ self.errors[syndromes ^ remainders(flip)] ^ self.errors[syndromes]
            return np.sort(moved >> CHECKS, axis=1)

        def table(rows: list[np.ndarray]) -> np.ndarray:
            filled = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
            for row, values in enumerate(rows):
                filled[row, : len(values)] = values
            return filled

        one = [np.setdiff1d(row, [0]) for row in homes(singles)]
        two = [np.setdiff1d(row, [0, *first]) for row, first in zip(homes(doubles), one)]
        return table(one), table(two)

    def of(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each fingerprint's home, and its other anchors as a row (the home fills up)."""
        home = np.zeros(len(prints), dtype=np.int64)
        ones, twos = [], []
        for (first, width), one, two in zip(BLOCKS, self.one, self.two):
            block = (prints >> first) & ((1 << width) - 1)
            syndrome = remainders(block)
            free = (LENGTH - CHECKS) * len(ones)
            home |= (block ^ self.errors[syndrome]) >> CHECKS << free
            ones.append(one[syndrome] << free)
            twos.append(two[syndrome] << free)
        offsets = ones + twos
        for a, b in combinations(ones, 2):
            both = a[:, :, None] ^ b[:, None, :]
            both[(a == 0)[:, :, None] | (b == 0)[:, None, :]] = 0
            offsets.append(both.reshape(len(prints), -1))
        return home, home[:, None] ^ np.concatenate(offsets, axis=1)


def homes_and_guests(prints: DataFrame) -> DataFrame:
    """fp to anchor, fp, guest: one row at home and one per other anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                prints = batch.column("fp").slice(at, BATCH).to_numpy(zero_copy_only=False)
                home, others = anchors.of(prints)
                row, column = np.nonzero(others != home[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, others[row, column]])),
                        pa.array(np.concatenate([prints, prints[row]])),
                        pa.array(np.arange(len(home) + len(row)) >= len(home)),
                    ],
                    names=["anchor", "fp", "guest"],
                )

    return prints.mapInArrow(run, "anchor long, fp long, guest boolean")


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs a, b of different fingerprints within two bits, each once."""
    placed = homes_and_guests(prints.select("fp").distinct())
    home = placed.where(~F.col("guest"))
    crowded = written(
        home.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "crowded-anchors"
    )
    guests = placed.select("anchor", F.col("fp").alias("a"))
    home = home.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    if crowded.isEmpty():
        return guests.join(home, "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")
    calm = guests.join(crowded, "anchor", "left_anti").join(home, "anchor").where(
        (F.col("a") < F.col("b")) & near
    )
    masks = F.array(*[F.lit(np.uint64(mask).astype(np.int64).item()) for mask in MASKS])
    points = (
        guests.join(crowded, "anchor", "left_semi").select("a").distinct()
        .select("a", F.explode(masks).alias("mask"))
        .select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("b"))
        .where("a < b")
    )
    fine = points.join(home.join(crowded, "anchor", "left_semi").select("b"), "b")
    return calm.select("a", "b").union(fine.select("a", "b"))


def grouped(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Add `root` to rows with `fp`: the smallest fingerprint reachable over links."""
    root = components(links(prints, hot)).toDF("fp", "root")
    return prints.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def link(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document."""
    prints = docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp"))
    prints = written(prints, "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = written(grouped(least, hot), "components")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(roots.select("fp", "root").join(ids, "root"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def dedupe(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """Keep one row of each component: that with the smallest doc_id (null last).

    Rows that repeat both id and text count as one. Only ids and hashes are kept aside; the rows meet
    what is kept in a join that shuffles at any size.
    """
    h, known, mark = spare(docs, "_h", "_id", "_mark")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(h).alias("h"))
    rows = docs.withColumn(h, F.md5(F.coalesce("text", F.lit(""))))
    prints = rows.select(key.alias("key"), fingerprint(F.col("text"), shingle).alias("fp"))
    prints = written(prints, "fingerprints")
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    kept = grouped(least, hot).groupBy("root").agg(F.min("least").alias("key"))
    kept = written(kept.select(F.col("key.doc_id").alias(known), F.col("key.h").alias(mark)), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(known)) & (F.col(h) == F.col(mark))
    return (
        rows.join(kept.hint("merge"), same, "left_semi")
        .dropDuplicates(["doc_id", h])
        .select(*columns(docs))
    )
