"""From raw documents to token ids: the stages that a training corpus passes, in their order.

Each stage works on what the one before kept. Rows are packed before an operator sees them, so extra
columns keep their names and values whatever they are called. Where a stage changes a text, `n_chars`
follows it. Null and empty texts pass the stages as empty ones; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import bpe, lines, mixing, quality, simhash
from undertow.llm.words import columns, word_count
from undertow.session import written


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """`row` holds the document but for its text; only what an operator reads stands beside it."""
    return docs.select(F.struct(*columns(docs, "text")).alias("row"), "doc_id", "text", *more)


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with the text that stands beside the row."""
    text = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(text.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(packed(docs), quality.learn(docs, labels))
    return unpacked(scored.where("predicted = 1"), docs)


def without_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of long runs of lines, and documents of which nothing else is left."""
    deduped = lines.dedupe_lines(packed(docs))
    return unpacked(deduped.where("n_deleted = 0 or n_deleted < n_lines"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints of three-word runs differ in two bits or fewer."""
    return unpacked(simhash.dedupe(packed(docs)), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source by its target: a row per use of a document, the last one cut at the budget."""
    rows = packed(docs, F.col("source"), word_count(F.col("text")).alias("size"))
    return unpacked(mixing.copies(mixing.mix(rows)), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids of every text, and the digest of the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, ("ids", "decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_copied_lines),
    ("SimHash near-dedup", one_of_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL has neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written once, for the next reads it often."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage-{number}")
    return docs
