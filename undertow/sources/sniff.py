"""Tell file formats apart by their first bytes and their names, for a folder of mixed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import vocabulary as words
from undertow.functions.cells import strip

HEAD_BYTES = 2048


def extension(name: Column) -> Column:
    """The lower-case extension without its dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def file_format(name: Column, head: Column) -> Column:
    """Zip and Parquet signatures win over the name; then a known extension; then the content."""
    ending = extension(name)
    first = F.substring(head, 1, 4)
    opening = F.substring(strip(F.substring(head, 1, HEAD_BYTES).cast("string")), 1, 1)
    return (
        F.when(first == F.unhex(F.lit("504B0304")), F.lit("xlsx"))
        .when(first == F.unhex(F.lit("50415231")), F.lit("parquet"))
        .when(ending.isin(*words.KNOWN_EXTENSIONS), ending)
        .when(opening.isin("{", "["), F.lit("json"))
        .when(ending != "", ending)
        .otherwise(F.lit("csv"))
    )


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        heads = []
        for path in batch["path"]:
            uri = path if "://" in path else path.replace("file:/", "file:///", 1)
            store, inner = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(inner) as stream:
                heads.append(stream.read(HEAD_BYTES))
        yield batch.assign(head=heads)


def folder_formats(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, format, supported) of every file under a folder.

    Listing leaves the contents alone; tasks then open only the first bytes of each file.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
    found = listed.mapInPandas(_heads, "path string, length long, head binary")
    return found.select(
        "path", "length", file_format(F.col("path"), F.col("head")).alias("format")
    ).withColumn("supported", F.col("format").isin(*words.KNOWN_EXTENSIONS))
