"""Nearest neighbours by inner product with multi-index hashing.

Codes: vectors are extended by one component that makes all norms equal (so that the largest inner
product is the smallest angle), rotated by learned rotations (iterative quantisation), and the signs
make `BITS` bits. Rotations and the search radius are learned on at most `SAMPLE` vectors, those with
the smallest hash of their id; every vector is indexed. The radius is the one within which `AIM` of
the sample's own nearest neighbours lie; in more data they are nearer.

Index: a code is cut into substrings of 8 bits, and a block of vectors has, for every substring and
value, a bitmap of the vectors with it. If a code is within radius r = m * a + c of the query's, then
one of its first c + 1 substrings is within a, or one of the others within a - 1. So joining the
bitmaps of all such values retrieves every code within r; these are checked against r, and the rest
is ranked by the inner product in double precision.

Blocks of vectors meet blocks of queries, a pair a task at a time, and each gives the best of its
block. That is every query against all rows: the work grows with their product, as the query set does
with the table, while memory is that of one pair of blocks. Queries that find fewer than asked for
within the radius are searched again without one.

Equal vectors are one entry with the smallest of their ids, as many as can be in any result, and one
query, so a vector that a third of all rows hold is searched and scored once.

Rows whose vec_id is null, or whose vector is null, empty, zero, of a rarer length than most, or
holds null or non-finite components take no part. Rows that repeat both id and vector count once.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.session import written

SAMPLE, AIM, PROBES = 20_000, 0.97, 256
BITS, PART = 128, 8
VECTORS, QUERIES = 8_192, 2_048  # in a block
ROUNDS = 20
ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


class Code:
    """Learned rotations; `most` is the largest squared norm of all vectors."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most
        points = self.extended(sample)
        width, rng = points.shape[1], np.random.default_rng(7)
        turns = []
        while sum(turn.shape[1] for turn in turns) < BITS:
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(points.T @ np.sign(points @ turn))
                turn = left @ right
            turns.append(turn)
        self.turn = np.concatenate(turns, 1)[:, :BITS]

    def extended(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.maximum(self.most - (vectors**2).sum(1), 0)
        return np.concatenate([vectors, np.sqrt(np.zeros(len(vectors)) if query else rest)[:, None]], 1)

    def of(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        return np.packbits(self.extended(vectors, query) @ self.turn > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ONES[codes ^ code].sum(1, dtype=np.int64)


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (vectors * query).sum(1)


def radius(code: Code, sample: np.ndarray, k: int) -> int:
    """Within which `AIM` of the k nearest of some sample vectors lie, among the sample."""
    codes, found = code.of(sample), []
    queries = sample[:PROBES]
    for at, (query, bits) in enumerate(zip(queries, code.of(queries, query=True))):
        near = scores(sample, query)
        near[at] = -np.inf
        best = np.argsort(-near)[: min(k, len(sample) - 1)]
        found.append(distances(codes[best], bits))
    found = np.concatenate(found) if found else np.zeros(0)
    return int(np.quantile(found, AIM, method="higher")) if len(found) else BITS


class Block:
    """Bitmaps of a block's codes by substring and value."""

    def __init__(self, codes: np.ndarray, reach: int):
        self.codes, self.reach = codes, reach
        parts = BITS // PART
        near, extra = divmod(reach, parts)
        values = np.arange(256)
        apart = ONES[values[:, None] ^ values]
        self.maps = []
        for part in range(parts):
            within = near if part <= extra else near - 1
            own = np.packbits(values[:, None] == codes[:, part], axis=1)
            probes = [
                np.bitwise_or.reduce(own[apart[value] <= within], axis=0, initial=0)
                for value in values
            ]
            self.maps.append(np.stack(probes))

    def probe(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes within reach."""
        hits = self.maps[0][code[0]]
        for part, value in enumerate(code[1:], 1):
            hits = hits | self.maps[part][value]
        places = np.flatnonzero(np.unpackbits(hits, count=len(self.codes)))
        return places[distances(self.codes[places], code) <= self.reach]


def usable(table: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("vec_id is not null and size(vector) > 0")
    fine = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("vector").alias("width")).count()
    width = sizes.orderBy(F.desc("count"), F.desc("width")).head()
    return rows.where(F.size("vector") == F.lit(width["width"] if width else 0))


def search_blocks(index: DataFrame, queries: DataFrame, code: Code, width: int, reach: int, k: int) -> DataFrame:
    """The k best entries of each block of `index` (entry, vector, code) for each of `queries`."""
    vector_blocks = max(1, -(-index.count() // VECTORS))
    query_blocks = max(1, -(-queries.count() // QUERIES))

    def block(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = index.withColumn("v", block("entry", vector_blocks)).withColumn("q", every(query_blocks))
    right = queries.withColumn("q", block("entry", query_blocks)).withColumn("v", every(vector_blocks))

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        entries, vectors = rows["entry"].to_numpy(), matrix(rows["vector"].combine_chunks(), width)
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(vectors), -1)
        wanted = matrix(asked["vector"].combine_chunks(), width)
        held = Block(codes, reach) if reach < BITS and len(vectors) else None
        out = []
        for query, vector, bits in zip(asked["entry"].to_pylist(), wanted, code.of(wanted, query=True)):
            places = held.probe(bits) if held else np.arange(len(vectors))
            found = scores(vectors[places], vector)
            top = np.lexsort((entries[places], -found))[:k]
            out.append((np.full(len(top), query), entries[places[top]], found[top]))
        columns = [np.concatenate(column) for column in zip(*out)] if out else [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "entry", "score"])

    cells = right.groupBy("v", "q").cogroup(left.groupBy("v", "q"))
    return cells.applyInArrow(lambda asked, rows: best(rows, asked), "query long, entry long, score double")


def nearest(table: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest of each query, nearest first.

    Queries are the rows whose vec_id is divisible by `every`; a query's own id is no candidate. Ties
    go to the smaller vec_id.
    """
    rows = written(usable(table), "vectors")
    first = Window.partitionBy("vector").orderBy("vec_id")
    members = (
        rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("entry", F.get("ids", F.lit(0)))
    )
    members = written(members, "distinct-vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    most = members.agg(F.max(squares)).first()[0] or 0.0
    learned = members.select("vector").orderBy(F.xxhash64("entry"), "entry").limit(sample).toArrow()
    width = len(learned["vector"][0]) if len(learned) else 1
    points = matrix(learned["vector"].combine_chunks(), width)
    code = Code(points, most)
    reach = radius(code, points, k)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = code.of(matrix(batch.column("vector"), width))
            column = pa.array([row.tobytes() for row in bits], pa.binary())
            yield batch.append_column("code", column)

    index = members.select("entry", "vector").mapInArrow(
        codes, "entry long, vector array<double>, code binary"
    )
    index = written(index, "vector-index")
    asking = rows.where(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    asking = written(asking.join(members.select("vector", "entry"), "vector"), "queries")
    queries = asking.select("entry", "vector").distinct()
    found = written(search_blocks(index, queries, code, width, reach, k + 1), "found")
    enough = found.groupBy("query").count().where(F.col("count") > k).select(F.col("query").alias("entry"))
    short = written(queries.join(enough, "entry", "left_anti"), "short-queries")
    if reach < BITS and not short.isEmpty():
        again = search_blocks(index, short, code, width, BITS, k + 1)
        found = found.join(short.select(F.col("entry").alias("query")), "query", "left_anti").union(again)
    order = [F.desc("score"), F.asc("vec_id")]
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("entry"))
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ids = found.join(members.select("entry", "ids"), "entry").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    answers = (
        ids.where(F.col("n") <= k + 1).groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    )
    own = F.filter("list", lambda row: row["vec_id"] != F.col("query_id"))
    return (
        asking.select("query_id", F.col("entry").alias("query")).join(answers, "query")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "row"))
        .select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"),
            F.col("row.vec_id").alias("vec_id"), F.col("row.score").alias("score"),
        )
    )
