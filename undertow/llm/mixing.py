"""Mix sources to target weights by cutting a random order of each source at its exact budget.

Every document gets a key that is as good as random but depends on its id alone, so reruns agree.
Within a source documents are ranged by key, prefix sums of their sizes give each its place, and the
source's budget cuts that order: whole epochs first, then documents up to the cut, and the document
on the cut counts with the words that still fit.

Prefix sums are distributed: keys are uniform, so equal key ranges hold about equal numbers of rows,
however large a source is. Ranges are summed first, their totals are added up per source, and only
then is each range sorted and added up by itself. The number of ranges follows the counted rows;
the result does not depend on it. Documents are read twice and nothing but range totals is kept aside.

Null ids share the key of the empty text, null sources are a source of their own, a null size counts
as 0. Ties of key, id and size are broken by nothing: such rows are interchangeable in the result.
An empty table, or one without words, gives targets of 0. Columns other than `doc_id`, `source` and
`size` pass through, except that the names this operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.words import WORD, spare
from undertow.session import written

WEIGHTS = (3, 1, 2)
#: The mix takes SHARE of all words, and no source more than CAP times its own.
SHARE, CAP = (3, 2), 2
ROWS_PER_RANGE = 4_096
KEY_BITS = 16
BROADCAST_SOURCES = 20_000
ADDED = ("source_size", "target", "start", "taken", "epochs", "cut")


def targets(totals: DataFrame) -> DataFrame:
    """Add `place` and `target` to one row per source with its `source_size`.

    Shares go by weight; a source whose share exceeds its cap gets the cap, and the rest is shared
    again. In the order of cap per weight the capped sources come first, so whether one is capped
    follows from what those before it have taken. Products are decimals and thus exact.
    """
    exact = "decimal(38,0)"
    numerator, denominator = SHARE
    place = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(
        F.array(*map(F.lit, WEIGHTS)), F.col("place") % F.lit(len(WEIGHTS)) + F.lit(1)
    )
    before = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()

    def total(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0)).cast(exact)

    budget = F.lit(numerator).cast(exact) * F.col("all")
    return (
        totals.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", (CAP * F.col("source_size")).cast("long"))
        .withColumn("all", total("source_size", everything))
        .withColumn("left", budget - denominator * total("limit", before))
        .withColumn(
            "open", (F.sum("weight").over(everything) - total("weight", before)).cast(exact)
        )
        .withColumn(
            "capped",
            F.col("limit").cast(exact) * F.col("open") * denominator
            <= F.col("left") * F.col("weight"),
        )
        .withColumn("held", F.when(F.col("capped"), F.col("limit")).otherwise(0))
        .withColumn("free", F.when(F.col("capped"), 0).otherwise(F.col("weight")))
        .withColumn("left", budget - denominator * total("held", everything))
        .withColumn("open", F.sum("free").over(everything))
        .select(
            "source", "source_size", "place",
            F.when(F.col("capped"), F.col("limit").cast("double"))
            .otherwise(
                (F.col("weight") * F.col("left")).cast("double")
                / (denominator * F.col("open")).cast("double")
            )
            .alias("target"),
        )
    )


def mix(docs: DataFrame) -> DataFrame:
    """Add source_size, target, start (words before it in its source), epochs, cut and taken.

    `epochs` counts whole uses of the document, `cut` the words of one further use; `taken` is
    epochs * size + cut.
    """
    docs = docs.drop(*ADDED)
    place, part, key, before, left, named = spare(
        docs, "place", "_range", "_key", "_before", "_rest", "_source"
    )
    docs = docs.withColumns({
        "size": F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")),
        key: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
    })
    finest = F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("int")
    ranges = docs.groupBy("source", finest.alias(part)).agg(
        F.sum("size").alias("range_size"), F.count("*").alias("n")
    )
    ranges = written(ranges, "mix-ranges")
    rows = ranges.agg(F.sum("n")).first()[0] or 0
    wider = KEY_BITS - min(KEY_BITS, (rows // ROWS_PER_RANGE).bit_length())
    docs = docs.withColumn(part, F.shiftright(finest, wider))
    ranges = ranges.groupBy("source", F.shiftright(part, wider).alias(part)).agg(
        F.sum("range_size").alias("range_size")
    )
    sources = written(
        targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))), "mix-sources"
    ).withColumnsRenamed({"source": named, "place": place})
    few = sources.count() <= BROADCAST_SOURCES

    def of_source(table: DataFrame, sources: DataFrame) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col(named))
        return table.join(F.broadcast(sources) if few else sources, same).drop(named)

    ranges = of_source(ranges, sources).select(
        place, "source_size", "target", part,
        F.coalesce(
            F.sum("range_size").over(
                Window.partitionBy(place).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias(before),
    )
    placed = of_source(docs, sources.select(named, place))
    within = (
        Window.partitionBy(place, part)
        .orderBy(key, F.asc_nulls_first("doc_id"), "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = F.floor("target").cast("long")
    size, source_size = F.col("size"), F.col("source_size")
    rest = whole - F.col("epochs") * source_size
    return (
        placed.join(ranges, [place, part])
        .withColumn("start", F.col(before) + F.sum("size").over(within) - size)
        .withColumn(
            "epochs",
            F.when(source_size > 0, F.floor(whole / source_size)).otherwise(0).cast("long"),
        )
        .withColumn(left, rest)
        .withColumn("cut", F.greatest(F.lit(0).cast("long"), F.least(size, F.col(left) - F.col("start"))))
        .withColumn("taken", F.col("epochs") * size + F.col("cut"))
        .drop(place, part, key, before, left)
    )


def copies(mixed: DataFrame) -> DataFrame:
    """One row per use of a document; the last may hold only its first `cut` words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    short = F.array_join(F.slice(words, 1, F.greatest(F.col("cut"), F.lit(1)).cast("int")), "")
    uses = F.col("epochs") + F.when(F.col("cut") > 0, 1).otherwise(0)
    (use,) = spare(mixed, "_use")
    return (
        mixed.where(uses > 0)
        .withColumn(use, F.explode(F.sequence(F.lit(1).cast("long"), uses)))
        .withColumn(
            "text",
            F.when(
                (F.col(use) > F.col("epochs")) & (F.col("cut") < F.col("size")), short
            ).otherwise(F.col("text")),
        )
        .drop(use)
    )
