"""The classifier: traversal against single trees, held-out accuracy, and odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.llm import quality
from undertow.llm.words import fold

from llm.conftest import MESSY

DATA = "/root/testdata/sf0.01"


def slow_score(trees, row):
    total = trees.base
    for node in trees.roots:
        while trees.child[node] != node:
            node = trees.child[node] + (row[trees.feature[node]] > trees.threshold[node])
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_learn_and_descend():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 4)).round(1)
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] > 0)).astype(float)
    trees = quality.fit(rows[:2000], labels[:2000])
    scores = trees.scores(rows)
    assert np.allclose(scores[:50], [slow_score(trees, row) for row in rows[:50]])
    assert ((scores[2000:] >= 0.5) == labels[2000:]).mean() > 0.97


@pytest.mark.parametrize("labels, share", [([], 0.5), ([1.0] * 5, 1.0), ([0.0] * 5, 0.0)])
def test_labels_of_one_kind(labels, share):
    trees = quality.fit(np.zeros((len(labels), 10)), np.array(labels))
    assert trees.scores(np.zeros((3, 10))) == pytest.approx([share] * 3, abs=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    trees = quality.learn(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), trees).where(fold(F.col("doc_id")) == 0)
    rows = scored.join(labels, "doc_id").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(rows) > 50 and np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_only_the_training_fold_and_the_text_count(spark, messy):
    """Labels of held-out rows do not move the fit, and neither does anything but the text a score."""
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 2 = 0, 'plain words', '### $$$') as text")
    labels = docs.select("doc_id", F.when(F.col("text") == "plain words", 1).otherwise(0).alias("quality"))
    turned = labels.withColumn(
        "quality", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = quality.learn(docs, labels), quality.learn(docs, turned)
    assert (one.value == two.value).all() and (one.threshold == two.threshold).all()
    few = quality.learn(docs, labels, sample=50)
    assert few.scores(np.zeros((1, 10))).shape == (1,)
    scored = quality.score(messy, one)
    assert scored.count() == len(MESSY) and "odd.name" in scored.columns
    by_text = scored.groupBy("text").agg(F.countDistinct("score").alias("n")).collect()
    assert {row["n"] for row in by_text} == {1}
    assert scored.where("score is null or score < 0 or score > 1").count() == 0


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    trees = quality.learn(nothing, labels)
    assert quality.score(nothing, trees).collect() == []
    unlabelled = quality.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), trees)
    assert unlabelled.first()["score"] == 0.5
