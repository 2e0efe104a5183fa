"""Line dedup: delete later copies of long runs of lines.

The corpus is one sequence of line ids, broken at the ends of documents. A run of consecutive lines
with at least `LEAST` words in all that stands, line for line, at an earlier place too is deleted;
its first copy stays. Earlier means a smaller doc_id (null first), then text hash, then line.

How: a suffix array by prefix doubling. Line ids are 128-bit hashes; each round names the runs of
twice the length by hashing the names of their halves, so after k rounds the names of suffixes sort
into the classes of equal prefixes of 2**k lines. These classes are the LCP intervals; only those
matter whose common prefix has `LEAST` words, and no deeper ones: every deleted run is the union of
its shortest prefixes and shortest suffixes of that many words, taken at each of its lines. So each
line begins one such window and ends one, a window is named by its length and the names of the first
and last 2**k of its lines, and an interval is all windows of one name. Its first place stays, the
lines of all others go. Names need no global order: intervals come from one hash aggregate instead of
a sort of all suffixes, and a document's lines only meet each other in a doubling round.

A suffix whose line stands nowhere else is an interval of its own, so lines that occur once are
dropped before the first round and break the sequence. Lines without a word are not part of it and
stay. Counts and first places are combined before the shuffle; a line or run that a third of all
documents hold is one row per task there, and its places are joined back, where Spark splits them. What is
joined back grows with the corpus, so all joins shuffle, at any size.

Null texts stay null and have no lines. Rows that repeat both id and text count as one document and
get the same result. Only `doc_id` and `text` are read; other columns stay as they are. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.words import WORD, columns, let, spare, words
from undertow.session import written

LEAST = 50  # words
NAMES = ("doc_id", "h")


def name(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def numbered(text: Column) -> Column:
    """The lines that hold a word, each with its place in the text."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    return F.filter(lines, lambda row: row["line"].rlike(WORD))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, j (number among lines with a word), line (its id) and n (words), if not unique."""
    rows = docs.where("text is not null").select(
        "doc_id", name(F.col("text")).alias("h"), F.posexplode(numbered(F.col("text"))).alias("j", "row")
    )
    rows = rows.select(
        *NAMES, "j", name(F.col("row.line")).alias("line"),
        F.size(words(F.col("row.line"))).cast("long").alias("n"),
    )
    often = written(rows.groupBy("line").count().where("count > 1").select("line"), "repeated-line-ids")
    return written(rows.join(often.hint("merge"), "line", "left_semi"), "repeated-lines")


def windows(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, h, start, size and name of every shortest run of `least` words, from each end."""
    document = Window.partitionBy(*NAMES).orderBy("j")
    rows = rows.repartition(*NAMES).dropDuplicates([*NAMES, "j"])
    rows = rows.withColumn("run", F.col("j") - F.row_number().over(document))
    run = Window.partitionBy(*NAMES, "run")
    rows = rows.withColumn("until", F.sum("n").over(run.orderBy("j")))
    rows = rows.withColumn("since", F.col("until") - F.col("n"))
    levels = least.bit_length()
    rows = rows.withColumn("name0", F.col("line"))
    for k in range(levels - 1):
        half = F.col(f"name{k}")
        other = F.lead(half, 1 << k).over(run.orderBy("j"))
        rows = rows.withColumn(f"name{k + 1}", F.unhex(F.md5(F.concat(half, other))))
    heads = F.array(*(f"name{k}" for k in range(levels)))
    tails = F.array(*(F.lag(f"name{k}", (1 << k) - 1).over(run.orderBy("j")) for k in range(levels)))
    rows = rows.select(*NAMES, "run", "j", "n", "since", "until", heads.alias("heads"), tails.alias("tails"))
    on = run.orderBy("since").rangeBetween(0, least - 1)
    back = run.orderBy("until").rangeBetween(1 - least, 0)

    def window(start: Column, size: Column, words: Column, first: Column, last: Column) -> Column:
        level = F.floor(F.log2(size) + F.lit(1e-9)).cast("int")
        parts = F.concat(size.cast("string").cast("binary"), F.get(first, level), F.get(last, level))
        whole = words >= least
        return F.when(
            whole,
            F.struct(start.cast("long").alias("start"), size.alias("size"), name(parts).alias("name")),
        )

    rows = rows.select(
        *NAMES, "j", "heads", "tails",
        F.count("*").over(on).alias("size_on"), F.sum("n").over(on).alias("words_on"),
        F.last("tails").over(on).alias("last"),
        F.count("*").over(back).alias("size_back"), F.sum("n").over(back).alias("words_back"),
        F.first("heads").over(back).alias("first"),
    )
    both = F.array(
        window(F.col("j"), F.col("size_on"), F.col("words_on"), F.col("heads"), F.col("last")),
        window(
            F.col("j") - F.col("size_back") + 1, F.col("size_back"), F.col("words_back"),
            F.col("first"), F.col("tails"),
        ),
    )
    return rows.select(*NAMES, F.explode(F.array_compact(both)).alias("w")).select(*NAMES, "w.*")


def later_copies(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, h and `gone`: the numbers of the lines to delete."""
    place = F.struct("doc_id", "h", "start")
    found = written(windows(repeated_lines(docs), least).withColumn("place", place), "runs")
    intervals = (
        found.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("name", "first")
    )
    intervals = written(intervals, "intervals")
    later = found.join(intervals.hint("merge"), "name").where(F.col("place") > F.col("first"))
    return (
        later.select(*NAMES, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("j"))
        .groupBy(*NAMES)
        .agg(F.collect_set("j").alias("gone"))
    )


def dedupe_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows with `text` less the later copies, `n_lines` (with a word) and `n_deleted`."""
    docs = docs.drop("n_lines", "n_deleted")
    known, h, deleted, mark = spare(docs, "_id", "_h", "_gone", "_name")
    copies = written(later_copies(docs, least), "line-copies").toDF(known, h, deleted).hint("merge")
    marked = docs.withColumn(mark, name(F.col("text"))).join(
        copies,
        F.col("doc_id").eqNullSafe(F.col(known)) & F.col(mark).eqNullSafe(F.col(h)),
        "left",
    )
    text, gone = F.col("text"), F.col(deleted)
    lines = F.split(text, "\n", -1)

    def without(rows: Column) -> Column:
        places = F.transform(gone, lambda j: F.get(rows, j.cast("int"))["at"])

        def join(found: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), places)
            return F.array_join(F.transform(stay, lambda at: F.get(found, at)), "\n")

        return let(lines, join)

    return marked.select(
        *columns(docs, "text"),
        F.when(gone.isNull(), text).otherwise(let(numbered(text), without)).alias("text"),
        F.coalesce(F.size(numbered(text)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_deleted"),
    ).select(*columns(docs), "n_lines", "n_deleted")
