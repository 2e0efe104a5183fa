"""Connected components of a graph that is given as links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.session import written


def hang(edges: DataFrame) -> DataFrame:
    """Large star: hang every neighbour above a node on the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def lift(edges: DataFrame) -> DataFrame:
    """Small star: hang a node and its neighbours below it on the smallest of them (a > b here)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least, "a")
    return (
        met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node but the roots.

    The two star steps alternate until nothing changes, after a number of rounds that grows with the
    logarithm of the nodes. A round keeps at most as many links as it got, aggregates minima before
    it shuffles, and writes its links, so that the plan stays short. Null links are ignored.
    """
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    mark = None
    while True:
        last, mark = mark, now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == last or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = written(lift(hang(now)), "links")
