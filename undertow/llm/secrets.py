"""Secret scans with a ledger of blobs, so that no text is scanned twice by the same rules.

A blob is a text named by its SHA-256. The ledger keeps a row per blob and rule version: the spans of
all findings, none included. A scan hashes every version of every path, finds the blobs that the
ledger lacks for the current rules, scans one copy of each, adds them to the ledger, and joins the
findings back to all paths and versions that hold the blob. New rules get a new version, and then
every blob is scanned once more by that version only.

Copies are combined before the shuffle (one text per task and blob) and again after it, so a blob
that a third of all rows hold is scanned once and no task gathers its copies. The findings join back
on the hash, where Spark splits a hot blob over several tasks.

Null texts count as empty; the empty blob has no findings. Rows are independent: repeated rows, ties
and null ids give a row each. An empty table gives an empty result and adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.words import pieces
from undertow.session import new_path, written

VERSION = 1
BATCH_BYTES = 4 << 20

# The base kinds of the contract, in its order.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
}
#: Further kinds, whose shape alone gives a secret away.
MORE = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "host_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{20,}",
}
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Kinds with a beginning that long texts may repeat without end. They are searched from the sign in
#: their middle: what follows it (group 1), the characters before it, and how those must begin.
#: So a text is read a fixed number of times, where a search from the left would start anew at each.
INSIDE = {
    "web_token": (
        r"\.(?=(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}))",
        LOWER.upper() + LOWER + DIGITS + "_-",
        r"\beyJ[A-Za-z0-9_-]{10}",
    ),
    "url_password": (r":(?=(//[^\s/:@]+:[^\s/:@]{4,}@))", LOWER + DIGITS + "+.-", r"\b[a-z]"),
}
KINDS = (*BASE, *MORE, *INSIDE)
#: A text without any of these (in lower case) has no match of the kind.
NEEDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "private_key": ("private key",),
    "web_token": ("eyj",),
    "host_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "chat_token": ("xox",),
    "url_password": ("://",),
}
SPANS = "array<struct<kind: string, start: int, end: int>>"


def accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 12
    return kind != "access" or len(match[0]) >= 18


def from_inside(text: str, middle: re.Pattern, letters: str, opening: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping spans of letters, the middle and what follows it."""
    low = 0
    for match in middle.finditer(text):
        at = match.start()
        if at < low:
            continue
        run = low + len(text[low:at].rstrip(letters))
        first = opening.search(text, run, at)
        if first:
            yield first.start(), match.end(1)
        low = match.end(1) if first else at + 1


def compiled() -> dict[str, Callable[[str], Iterable[tuple[int, int]]]]:
    """A search for the spans of each kind."""

    def plain(kind: str, pattern: str) -> Callable[[str], Iterable[tuple[int, int]]]:
        search = re.compile(pattern, re.ASCII)
        return lambda text: (m.span() for m in search.finditer(text) if accepted(kind, m))

    def inside(middle: str, letters: str, opening: str) -> Callable[[str], Iterable[tuple[int, int]]]:
        parts = re.compile(middle, re.ASCII), letters, re.compile(opening, re.ASCII)
        return lambda text: from_inside(text, *parts)

    found = {kind: plain(kind, pattern) for kind, pattern in (BASE | MORE).items()}
    return found | {kind: inside(*parts) for kind, parts in INSIDE.items()}


def scan_text(text: str, searches: dict[str, Callable[[str], Iterable[tuple[int, int]]]]) -> list[dict]:
    """Findings by start, then kind as listed; places are code points, the end exclusive."""
    low = text.lower()
    found = [
        {"kind": kind, "start": start, "end": end}
        for kind, search in searches.items()
        if kind not in NEEDS or any(word in low for word in NEEDS[kind])
        for start, end in search(text)
    ]
    return sorted(found, key=lambda span: (span["start"], KINDS.index(span["kind"])))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, text to blob, version, spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = compiled()
        for batch in pieces(batches, BATCH_BYTES):
            spans = [scan_text(text, searches) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("blob"),
                    pa.array([VERSION] * batch.num_rows, pa.int32()),
                    pa.array(spans, kind),
                ],
                names=["blob", "version", "spans"],
            )

    return blobs.select("blob", "text").mapInArrow(run, f"blob binary, version int, spans {SPANS}")


class Ledger:
    """Findings by blob and rule version, in a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "secret-ledger")
        empty = spark.createDataFrame([], f"blob binary, version int, spans {SPANS}")
        empty.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def add(self, blobs: DataFrame) -> None:
        """Scan the blobs (blob, text; copies allowed) that this rule version has not seen."""
        seen = self.rows().where(F.col("version") == VERSION).select("blob")
        fresh = blobs.dropDuplicates(["blob"]).join(seen, "blob", "left_anti")
        scan_blobs(fresh).write.mode("append").parquet(self.path)


def scan(versions: DataFrame, ledger: Ledger) -> DataFrame:
    """The rows without their text, with `blob` and the `spans` of their findings.

    `versions` has a `text` column and whatever names a path and its version; columns called `blob`
    and `spans` are replaced.
    """
    named = versions.drop("blob", "spans").withColumn("text", F.coalesce("text", F.lit("")))
    named = named.withColumn("blob", F.unhex(F.sha2("text", 256)))
    ledger.add(named.select("blob", "text"))
    known = ledger.rows().where(F.col("version") == VERSION).select("blob", "spans")
    with_findings = written(known.where(F.size("spans") > 0), "secret-findings")
    nothing = F.from_json(F.lit("[]"), SPANS)
    return (
        named.drop("text")
        .join(with_findings, "blob", "left")
        .withColumn("spans", F.coalesce("spans", nothing))
    )
