"""Quality rules as a ledger of failure bits.

`measure` evaluates every rule once on every document and keeps the measurements and one bit per
failed rule. A policy is a version and the rules it rejects by: `judge` applies one to a ledger
without touching the texts again, and `ablation` says what each rule of a policy decides alone.

Null and empty texts have no words and fail the rule on few words. Rows are independent: repeated
rows, ties and null ids each give their own row. Only the columns `doc_id` and `text` are read, so
other columns, whatever their names, do not matter. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.words import WORD, let, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements; false where they are null


#: A rule's place is its bit. New rules go to the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "100 * n_upper > 60 * word_chars"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": tuple(rule.name for rule in RULES),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words",
)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << place for place, rule in enumerate(RULES) if rule.name in rules)


def characters(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def repeated_words(found: Column) -> Column:
    """How many words lie in a window of three words that the text holds twice or more.

    Windows are sorted by a 64-bit hash, so a repeated one stands next to its like. The starts of
    the repeated ones, in order, then cover three words each, less what the next start covers.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(
                starts,
                lambda start, at: F.least(F.coalesce(F.get(starts, at + 1) - start, F.lit(3)), F.lit(3)),
            ),
            F.lit(0).cast("long"),
            lambda total, step: total + step,
        )

    def starts_of_repeated(windows: Column) -> Column:
        def start(window: Column, at: Column) -> Column:
            before, after = F.get(windows, at - 1)["hash"], F.get(windows, at + 1)["hash"]
            alike = window["hash"].eqNullSafe(before) | window["hash"].eqNullSafe(after)
            return F.when(alike, window["at"])

        return F.sort_array(F.array_compact(F.transform(windows, start)))

    windows = F.transform(
        F.slice(found, 1, F.greatest(F.size(found) - 2, F.lit(0))),
        lambda word, at: F.struct(
            F.xxhash64(word, F.get(found, at + 1), F.get(found, at + 2)).alias("hash"), at.alias("at")
        ),
    )
    return let(F.sort_array(windows), lambda w: let(starts_of_repeated(w), covered))


def measure(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, the measurements, and `failed`, whose bit k is set if rule k fails."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def facts(found: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.aggregate(
                found, F.lit(0).cast("long"), lambda total, word: total + F.length(word)
            ).alias("word_chars"),
            characters(text, SYMBOLS).alias("n_symbols"),
            let(
                lines,
                lambda kept: F.struct(
                    F.size(kept).cast("long").alias("n_lines"),
                    (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
                ),
            ).alias("lines"),
            characters(text, r"\p{Lu}").alias("n_upper"),
            repeated_words(found).alias("n_repeat_words"),
        )

    measured = docs.select("doc_id", let(words(text), facts).alias("m")).select(
        "doc_id",
        *(
            F.col(f"m.lines.{name}" if name in ("n_lines", "n_dup_lines") else f"m.{name}")
            for name in MEASURES
        ),
    )
    bits = [
        F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)).cast("long")
        for place, rule in enumerate(RULES)
    ]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def judge(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Add `base_failed` and `kept`: no rule of the base and none of the policy failed."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    rejected = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0
    return ledger.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected)


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents it fails, those it alone rejects, and those kept without it.

    Documents are first counted by their bits (at most 2 to the number of rules groups).
    """
    chosen = mask(POLICIES[policy])
    sets = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(chosen)).alias("bits")).count()
    rules = [
        F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << place).alias("bit"))
        for place, rule in enumerate(RULES)
        if rule.name in POLICIES[policy]
    ]

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0)).cast("long")

    bits, bit = F.col("bits"), F.col("rule.bit")
    return (
        sets.select("bits", "count", F.explode(F.array(*rules)).alias("rule"))
        .groupBy(F.col("rule.rule").alias("rule"))
        .agg(
            total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
            total(bits == bit).alias("n_alone"),
            total((bits == 0) | (bits == bit)).alias("n_kept_without"),
        )
    )
