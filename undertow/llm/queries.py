"""The queries of the operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import alignment, bpe, interactions, language, lines, mixing, neighbours, quality, rules, secrets, simhash, suffixes, token_counts
from undertow.llm.words import fold, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RULES_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(length(regexp_replace(text, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END)
         + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
         + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
         + (CASE WHEN 100 * n_upper > 60 * word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       failed = 0 AS kept, failed
FROM judged
"""


@register("op10_quality_rules", RULES_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's measurements, failed rules as bits, and the verdict of policy v1."""
    return rules.judge(rules.measure(load(spark, folder, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed",
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
pairs AS (  -- a source is capped if capping it and all with less room per weight leaves no less
  SELECT a.source, a.s, a.w, sum(b.s) AS everything, sum(b.w) AS weights,
         sum(CASE WHEN b.s * a.w < a.s * b.w THEN 2 * b.s ELSE 0 END) AS taken,
         sum(CASE WHEN b.s * a.w < a.s * b.w THEN b.w ELSE 0 END) AS out
  FROM totals a, totals b GROUP BY a.source, a.s, a.w),
capped AS (
  SELECT *, 4 * s * (weights - out) <= (3 * everything - 2 * taken) * w AS held FROM pairs),
shared AS (
  SELECT source, CAST(s AS BIGINT) AS source_size,
         CASE WHEN held THEN CAST(2 * s AS DOUBLE)
              ELSE CAST(w * (3 * everything - sum(CASE WHEN held THEN 4 * s ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(2 * sum(CASE WHEN held THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM capped),
ordered AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                         ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized d JOIN shared t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE whole // source_size * size
                 + greatest(0, least(size, whole % source_size - start)) END AS BIGINT) AS taken
FROM ordered
"""


@register("op2_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = load(spark, folder, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register("op9_bpe_encoding")
def bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's token ids and of the text they decode to."""
    docs = load(spark, folder, "documents")
    model = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, model, ("ids_sha256", "decoded_sha256"))


#: Documents with more tokens than this do not fit a training sequence.
TOKEN_LIMIT = 4_096


@register("op5_token_counts")
def token_counts_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = load(spark, folder, "documents")
    counted = token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@register("op7_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each base kind of secret in every document, and where the findings stand."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda span: span["kind"].isin(*secrets.BASE))

    def joined(found: Column) -> Column:
        parts = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long")

    return secrets.scan(docs, secrets.Ledger(spark)).select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@register("op6_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the component of near copies it belongs to."""
    return simhash.link(load(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@register("op1_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's chance of being marked as good."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    trees = quality.learn(docs, load(spark, folder, "labels"))
    scored = quality.score(docs, trees)  # the texts are read for their statistics only
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


# An independent way: pairs of equal lines, followed along their diagonals.
LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS nr, unnest(lines) AS line FROM split),
worded AS (
  SELECT doc_id, nr, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS j
  FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.j AS i, b.j AS j, b.n, b.nr
  FROM worded a JOIN worded b
  ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.j < b.j)),
islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY a, b, j - i ORDER BY i) AS island FROM pairs),
gone AS (
  SELECT DISTINCT b AS doc_id, nr FROM (
    SELECT b, nr, sum(n) OVER (PARTITION BY a, b, j - i, island) AS words FROM islands)
  WHERE words >= 50),
marked AS (
  SELECT n.doc_id, n.nr, n.line, g.nr IS NOT NULL AS deleted,
         regexp_matches(n.line, '[^\x20\x09-\x0D]') AS worded
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.nr = g.nr)
SELECT doc_id, CAST(count(*) FILTER (worded) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (deleted) AS BIGINT) AS n_deleted,
       coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT deleted), '') AS text
FROM marked GROUP BY doc_id
"""


@register("op4_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the later copies of runs of at least 50 words."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return lines.dedupe_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


@register("op3_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.nearest(load(spark, folder, "embeddings"))


@register("op8_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability under a unigram base and the interpolated bigram model."""
    scored = language.score(load(spark, folder, "documents"))
    return scored.select(
        "doc_id", (F.col("fold") == language.HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score",
    )


INTERACTIONS_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failing AS (
  SELECT s.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)
             THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN s.doc_id > min(s.doc_id) OVER (PARTITION BY md5(text)) THEN 'E' ELSE '' END) AS fails
  FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id),
classes AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
joined AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails = own AS only_this,
         contains(fails, own) AS failed,
         before <> '' AND regexp_matches(fails, '[' || before || '_]') AS earlier
  FROM classes, steps),
summed AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN NOT failed AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN failed AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN failed AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN only_this THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN failed AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN failed AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM joined GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""


@register("op13_filter_interactions", INTERACTIONS_SQL)
def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove at every step of all their orders, per language."""
    return interactions.audit(load(spark, folder, "documents"), load(spark, folder, "labels"))


@register("op12_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How two tokenizers' tokens line up in every document, and how usual its links are."""
    models = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(load(spark, folder, "documents"), *models, digest=True)


@register("op11_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document less the passages of 50 bytes and more that stand in earlier ones."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return suffixes.dedupe(docs).select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
