"""Token counts of whole texts, huge ones by encoding overlapping chunks and splicing them.

A text of up to `CHUNK` characters is encoded at once. A longer one is cut into chunks that overlap;
chunks are dealt out over the cluster and encoded with the offsets of their tokens. Two neighbours
are spliced where both have a token boundary at the same place of their overlap and that place is
proven to be stable: the two characters around it stand next to each other in no piece of the
vocabulary. Pieces are merged from adjacent ones, so no merge ever crosses such a place, in the chunk
as in the whole text, and what stands on either side of it is encoded independently. If a pair of
neighbours has no such place, all chunks of that document are encoded anew with a wider overlap, at
last with one chunk that is the whole text. So every count is that of the whole text.

This holds for vocabularies of merged pieces (BPE) that leave texts as they are but for a space put
before the first character, as the public 32k model does.

Null texts count as empty and have no tokens. Rows are independent: repeated rows, ties and null ids
give a row each; columns other than `doc_id` and `text` are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.words import pieces
from undertow.session import written

CHUNK = 32_768  # characters
OVERLAP, WIDER = 256, 8
BATCH_BYTES = 4 << 20
SPACE = "▁"  # how the vocabulary spells a space

POINTS = "array<struct<at: long, before: long>>"
CHUNKS = "uid long, chunk long, start long, last boolean, text string"
ENCODED = f"uid long, chunk long, last boolean, n_tokens long, head {POINTS}, tail {POINTS}"


class Pieces:
    """A vocabulary with what is needed to cut texts safely."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(number) for number in range(size)]
        spelt = [not (self.model.is_byte(n) or self.model.is_control(n)) for n in range(size)]
        self.inside = {
            name[at : at + 2] for n, name in enumerate(names) if spelt[n] for at in range(len(name) - 1)
        }
        # A character that is spelt in bytes counts at its first byte.
        self.length = np.array([
            len(name) if spelt[n]
            else int(self.model.is_byte(n) and int(name[3:5], 16) & 0xC0 != 0x80)
            for n, name in enumerate(names)
        ])

    def stable(self, text: str, start: int, end: int) -> list[int]:
        plain = text.replace(" ", SPACE)
        return [
            at for at in range(max(1, start), min(end, len(text)))
            if plain[at - 1 : at + 1] not in self.inside
        ]

    def encode(self, text: str) -> tuple[int, np.ndarray]:
        """Number of tokens, and the place in the text where each ends.

        The library puts a space before every chunk; what that changes ends at the first stable place.
        """
        ids = self.model.encode(text)
        return len(ids), np.cumsum(self.length[ids]) - 1 if ids else np.zeros(0, dtype=int)

    def points(self, text: str, start: int, end: int, ends: np.ndarray) -> list[tuple[int, int]]:
        """Stable token boundaries from `start` to `end`, each with the tokens before it."""
        at = np.array(self.stable(text, start, end), dtype=np.int64)
        before = np.searchsorted(ends, at, side="right")
        here = (before > 0) & (ends[np.maximum(before - 1, 0)] == at) if len(ends) else before > 0
        return list(zip(at[here].tolist(), before[here].tolist()))


def count_short(docs: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in pieces(batches, BATCH_BYTES):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            counts = [len(ids) for ids in library.encode(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of each text: `chunk` characters and the first `overlap` of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                rows, start = [], 0
                while True:
                    end = start + chunk + overlap
                    rows.append((uid, start // chunk, start, end >= len(text), text[start:end]))
                    if end >= len(text):
                        break
                    start += chunk
                columns = [pa.array(column) for column in zip(*rows)]
                names = ["uid", "chunk", "start", "last", "text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, CHUNKS)


def encode_chunks(chunks: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    points = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(model)
        for batch in pieces(batches, BATCH_BYTES):
            counts, heads, tails = [], [], []
            for row in batch.to_pylist():
                text, start = row["text"], row["start"]
                count, ends = vocabulary.encode(text)
                counts.append(count)
                for column, skip, wanted in ((heads, 0, start > 0), (tails, chunk, not row["last"])):
                    found = vocabulary.points(text, skip, skip + overlap, ends) if wanted else []
                    column.append([{"at": start + at, "before": n} for at, n in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"), batch.column("chunk"), batch.column("last"),
                    pa.array(counts, pa.int64()), pa.array(heads, points), pa.array(tails, points),
                ],
                names=["uid", "chunk", "last", "n_tokens", "head", "tail"],
            )

    return chunks.mapInArrow(run, ENCODED)


def splice(encoded: DataFrame) -> DataFrame:
    """uid and n_tokens of each document; null where two neighbours have no common stable place."""
    order = Window.partitionBy("uid").orderBy("chunk")
    common = F.filter("head", lambda mine: F.exists("_tail", lambda theirs: theirs["at"] == mine["at"]))
    theirs = F.get(F.filter("_tail", lambda point: point["at"] == F.col("_seam.at")), F.lit(0))
    return (
        encoded.withColumn("_tail", F.lag("tail").over(order))
        .withColumn("_seam", F.when(F.col("chunk") > 0, F.get(common, F.lit(0))))
        .withColumn(
            "n",
            F.when(F.col("chunk") == 0, 0).otherwise(theirs["before"] - F.col("_seam.before"))
            + F.when(F.col("last"), F.col("n_tokens")).otherwise(0),
        )
        .groupBy("uid")
        .agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))
    )


def count_long(docs: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = written(docs.withColumn("uid", F.monotonically_increasing_id()), "long-texts")
    left, done = docs, None
    while not left.isEmpty():
        chunks = cut(left.select("uid", "text"), chunk, overlap).repartition(tasks, "uid", "chunk")
        counted = written(splice(encode_chunks(chunks, model, chunk, overlap)), "spliced")
        found = counted.where("n_tokens is not null")
        done = found if done is None else done.unionByName(found)
        left = left.join(counted.where("n_tokens is null").select("uid"), "uid", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, overlap)  # so that a round encodes each text twice at most
    keys = docs.select("uid", "doc_id", "n_bytes")
    if done is None:
        return keys.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"))
    return keys.join(done, "uid").select("doc_id", "n_bytes", "n_tokens")


def count(docs: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
    )
    long = F.length("text") > chunk
    return count_short(docs.where(~long), model).unionByName(
        count_long(docs.where(long), model, chunk, overlap)
    )
