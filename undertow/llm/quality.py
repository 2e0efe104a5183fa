"""A quality classifier: histogram gradient-boosted trees over statistics of each text.

Spark computes the statistics (shares of symbols, capitals, distinct words and lines, ...); they look
at the text alone. The trees are fitted with numpy on at most `SAMPLE` labelled rows, those with the
smallest hash of their id; this is the only bound, and scoring covers every row. Fitting bins each
statistic by quantiles, and grows each tree level by level from histograms of gradients per node and
bin. All trees lie in one set of flat arrays: a node has a statistic, a threshold and the place of
its left child, its right child stands next to it, and a leaf is its own child. A batch of rows
descends all trees at once, a level per step.

Null texts count as empty; empty texts have statistics of 0 and get a score like any other. Without
labels, or with labels of one kind, every score is the share of label 1 (0.5 if there are none).
Rows are independent: repeated rows, ties and null ids give a row each. Null labels are left out. An
empty table gives an empty result. Columns named like the ones added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.words import WORD, fold, let, pieces, words

SAMPLE = 20_000
KEEP_FROM = 0.3
BATCH_BYTES = 16 << 20
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 60, 4, 64, 0.2, 1.0, 10
STATISTICS = (
    "n_words", "word_length", "distinct_words", "symbols", "capitals", "digits", "marks", "letters",
    "distinct_lines", "line_words",
)


def statistics(text: Column) -> Column:
    """An array of doubles in the order of `STATISTICS`."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))

    def share(kind: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{kind}]+", "")) / chars

    def of_words(found: Column) -> Column:
        n = F.greatest(F.size(found), F.lit(1))
        length = F.aggregate(found, F.lit(0).cast("long"), lambda total, x: total + F.length(x))
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
        return F.concat(
            F.array(
                F.log1p(F.size(found)), length / n, F.size(F.array_distinct(found)) / n,
                share("#*$%&|<>"), share(r"\p{Lu}"), share(r"\p{Nd}"), share(".,;:!?"), share(r"\p{L}"),
            ),
            let(
                lines,
                lambda kept: F.array(
                    F.size(F.array_distinct(kept)) / F.greatest(F.size(kept), F.lit(1)),
                    F.size(found) / F.greatest(F.size(kept), F.lit(1)),
                ),
            ),
        )

    return let(words(text), of_words)


@dataclass
class Trees:
    """All trees in flat arrays; `roots` are the places of their first nodes."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for a matrix of statistics."""
        total = np.full(len(rows), self.base)
        if len(self.roots) and len(rows):
            node = np.tile(self.roots, (len(rows), 1))
            at = np.arange(len(rows))[:, None]
            for _ in range(DEPTH):
                node = self.child[node] + (rows[at, self.feature[node]] > self.threshold[node])
            total += self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-6), 1 - 1e-6)
        empty = np.zeros(0, dtype=np.int64)
        return Trees(empty, empty, np.zeros(0), empty, np.zeros(0), float(np.log(share / (1 - share))))
    width = rows.shape[1]
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f]) for f in range(width)], 1)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(rows), base)
    roots, feature, threshold, child, value = [], [], [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = chance - labels, chance * (1 - chance)
        roots.append(len(feature))
        node = np.full(len(rows), len(feature))
        frontier = [len(feature)]
        feature.append(0), threshold.append(np.inf), child.append(len(child)), value.append(0.0)
        for depth in range(DEPTH + 1):
            at = np.searchsorted(frontier, node)
            alive = (at < len(frontier)) & (np.take(frontier, np.minimum(at, len(frontier) - 1)) == node)
            at, rest = at[alive], np.flatnonzero(alive)
            size = len(frontier)
            key = (at[:, None] * width + np.arange(width)) * BINS + binned[rest]

            def histogram(weights: np.ndarray | None) -> np.ndarray:
                weights = None if weights is None else np.repeat(weights[rest], width)
                counted = np.bincount(key.ravel(), weights, size * width * BINS)
                return counted.reshape(size, width, BINS).cumsum(2)

            g, h, n = histogram(slope), histogram(bend), histogram(None)
            all_g, all_h, all_n = g[:, :1, -1:], h[:, :1, -1:], n[:, :1, -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(n < LEAST) | (all_n - n < LEAST)] = -1
            best = gain.reshape(size, -1).argmax(1)
            next_frontier = []
            for place, parent in enumerate(frontier):
                f, cut = divmod(int(best[place]), BINS)
                if depth < DEPTH and gain[place, f, cut] > 1e-6 and cut < len(cuts[f]):
                    feature[parent], threshold[parent] = f, cuts[f][cut]
                    child[parent] = len(child)
                    for leaf in (len(child), len(child) + 1):
                        next_frontier.append(leaf)
                        feature.append(0), threshold.append(np.inf), child.append(leaf), value.append(0.0)
                else:
                    value[parent] = float(-RATE * all_g[place, 0, 0] / (all_h[place, 0, 0] + SHRINK))
            places = node[rest]
            split = np.array(child)[places] != places
            rest, places = rest[split], places[split]
            right = rows[rest, np.array(feature)[places]] > np.array(threshold)[places]
            node[rest] = np.array(child)[places] + right
            frontier = next_frontier
            if not frontier:
                break
        total += np.array(value)[node]
    return Trees(
        np.array(roots), np.array(feature), np.array(threshold), np.array(child), np.array(value), base
    )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on the labelled rows outside the held-out fold, at most `sample` of them."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_label"))
        .where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id")) != 0))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    table = chosen.select("_id", statistics(F.col("text")).alias("x"), "_label").toArrow()
    rows = np.array(table["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    wanted = np.array(table["_label"].to_pylist(), dtype=float)
    order = np.lexsort((*rows.T, wanted))  # the fit does not depend on the order rows arrive in
    return fit(rows[order], wanted[order])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """Add `score` and `predicted` to every row, whose other columns stay."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    # Names with dots do not pass an Arrow function, so columns travel by number.
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    with_x = docs.withColumn("_x", statistics(F.col(f"c{names.index('text')}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            rows = batch.column("_x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            scores = pa.array(trees.scores(rows), pa.float64())
            yield batch.drop_columns(["_x"]).append_column("score", scores)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    scored = with_x.mapInArrow(run, schema).toDF(*names, "score")
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
