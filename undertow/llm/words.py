"""Words, hashes and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)).cast("long"), F.lit(0).cast("long"))


def fold(doc_id: Column) -> Column:
    """Remainder of the CRC-32 of the id as text by `FOLDS`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


def columns(docs: DataFrame, *but: str) -> list[Column]:
    """All columns by name, however they are called."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns if name not in but]


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names for working columns: the given ones, longer where `docs` has a column of that name."""
    taken = {name.lower() for name in docs.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `size` bytes, or a single row."""
    for batch in batches:
        rows, most = batch.num_rows, max(1, batch.nbytes // size + 1)
        step = max(1, rows // most)
        for start in range(0, rows, step):
            yield batch.slice(start, step)
