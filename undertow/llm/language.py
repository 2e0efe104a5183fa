"""A language model by deleted interpolation, and the scores it gives to every text.

The probability of a token after others is a mix of `order` + 1 estimates: how often it follows the
last `order` - 1 tokens among all that follows them, the same for each shorter context, how often the
token occurs at all (unigram), and the same for every word. Weights of the mix depend on the longest
context that occurs at all, its length and how often it does, in buckets of powers of two. They
are learned by expectation-maximisation: counts are taken without one fold of the training texts, and
the weights maximise that fold's likelihood under those counts. The scores then use all counts.

Text is lower-cased (A-Z), cut into words, and an end is added, which also stands before the first
word as often as a context needs; so a context occurs as often as its own run of tokens, and those
before a first word as often as there are texts. The unigram base score uses the same counts.

How: each task packs its documents into blocks of about `BLOCK` bytes, which are written once. So
rows stay where they are read, however often one repeats. A block asks for the counts of its
distinct runs of 1 to `order` tokens: sorted 64-bit hashes with the block's own counts, cut by hash
range. All requests for a range meet in one task, which adds them up and answers each with the totals
in the same order. So a run costs a few bytes per block instead of a row per occurrence, a frequent
word is one entry per block, and nothing is gathered that grows faster than the distinct runs. The
blocks then score their texts against the answers. Texts travel compressed, keys as steps from one to
the next, and numbers byte by byte of equal weight, so that the shuffle's own compression finds the
zeros. The number of ranges follows the counted bytes; a block only touches ranges it has keys in.
Of the model only the weights and four totals pass the driver.

For the maximisation the held-out tokens are counted by bucket and the estimates, rounded to an
eighth of a power of two: a table whose size is bounded (at most 64 * 512 * 512 cells for pairs, a few
thousand in practice), whatever the corpus.

Null texts count as empty and have one token, the end. A null id is in the training texts and not
held out. Repeated rows are scored and counted as often as they occur; ties do not matter. Without
training texts all counts are 0 and the mix is the uniform estimate. An empty table gives an empty
result. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.words import fold, pieces
from undertow.session import new_path, written

BLOCK = 2 << 20  # bytes of text
RANGE = 4 << 20  # bytes of text per hash range
HELD_OUT, TUNING = 1, 2  # remainders of the id's hash
STEPS = 8  # per power of two
ROUNDS = 100
NONE = 511  # rounded estimate of zero
WORDS = 0  # kind of request; runs of n tokens have kind n - 1
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def shrunk(values: np.ndarray) -> bytes:
    """64-bit numbers with their first bytes first, then their second bytes, and so on."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def grown(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def steps(keys: np.ndarray) -> bytes:
    return shrunk(np.diff(keys.view(np.int64), prepend=np.int64(0)))


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(grown(data)).view(np.uint64)


def packed(docs: DataFrame, size: int) -> DataFrame:
    """block and `rows`: its texts with their ids and folds, compressed. Tuning texts have odd blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        number = TaskContext.get().partitionId() << 32
        waiting: list[list[pa.RecordBatch]] = [[], []]

        def block(odd: int) -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[odd][0].schema, options=options) as stream:
                for some in waiting[odd]:
                    stream.write_batch(some)
            waiting[odd] = []
            number += 1
            columns = [pa.array([2 * number + odd], pa.int64()), pa.array([sink.getvalue().to_pybytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["block", "rows"])

        for batch in pieces(batches, size // 2):
            tuning = pc.equal(batch.column("fold"), TUNING)
            for odd, own in enumerate((pc.invert(tuning), tuning)):
                some = batch.filter(own)
                if some.num_rows:
                    waiting[odd].append(some)
                if sum(x.nbytes for x in waiting[odd]) >= size:
                    yield block(odd)
        for odd in (0, 1):
            if waiting[odd]:
                yield block(odd)

    return docs.mapInArrow(run, "block long, rows binary")


def unpacked(rows: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in rows["rows"].to_pylist())


def joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of the runs that begin with the runs `before` and end with the words."""
    key = before * np.uint64(0x9E3779B97F4A7C15) + word
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))


class Block:
    """Some texts' runs of 1 to `order` tokens as places in sorted distinct keys, and counts by role."""

    def __init__(self, texts: list[bytes | None], folds: np.ndarray, order: int):
        flat: list[bytes] = []
        sizes = np.empty(len(texts), dtype=np.int64)
        for at, text in enumerate(texts):
            words = (text or b"").translate(LOWER).split()
            words.append(b"")
            sizes[at] = len(words)
            flat += words
        self.sizes = sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.first = np.cumsum(sizes) - sizes
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        del flat
        distinct = [xxhash.xxh64_intdigest(word) for word in coded.dictionary.to_pylist()]
        distinct = np.array(distinct, dtype=np.uint64)
        by_key = np.argsort(distinct)
        place = np.empty(len(by_key), dtype=np.int64)
        place[by_key] = np.arange(len(by_key))
        self.end = place[coded.dictionary.index(b"").as_py()]
        word = place[coded.indices.to_numpy()]
        self.keys, self.runs = [distinct[by_key]], [word]
        own = key = self.keys[0][word]
        start = self.keys[0][self.end : self.end + 1]
        for _ in range(order - 1):
            key = joined(self.after(key, start), own)
            start = joined(start, self.keys[0][self.end])
            keys, at = np.unique(key, return_inverse=True)
            self.keys.append(keys)
            self.runs.append(at)
        role = np.repeat(folds, sizes)
        kept, tuned = (role != HELD_OUT) & (role != TUNING), role == TUNING
        self.counts = [
            [np.bincount(at, weights, len(keys)).astype(np.int64) for weights in (kept, tuned)]
            for at, keys in zip(self.runs, self.keys)
        ]

    def after(self, values: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each token the value of the one before it in its text, `start` for the first."""
        moved = np.concatenate([start, values[:-1]])
        moved[self.first] = start
        return moved

    def found(self, totals: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each token the totals of its runs, shortest first, and of their contexts."""
        runs = [total[at] for total, at in zip(totals, self.runs)]
        texts = totals[WORDS][self.end : self.end + 1]
        return runs, [self.after(run, texts) for run in runs[:-1]]


def block_of(table: pa.Table, order: int) -> Block:
    texts = table["text"].cast(pa.large_binary()).to_pylist()
    return Block(texts, table["fold"].to_numpy(), order)


def ask(texts: DataFrame, ranges: int, order: int) -> DataFrame:
    """A row per block, kind and hash range: the keys and the block's counts of them."""
    names = ["kind", "range", "block", "keys", "kept", "tuned"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def requests(number: int, block: Block, kind: int) -> pa.RecordBatch:
        keys, (kept, tuned) = block.keys[kind], block.counts[kind]
        part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            some = slice(start, end)
            rows.append(
                (kind, part[start], number, steps(keys[some]), shrunk(kept[some]), shrunk(tuned[some]))
            )
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(at, 1)])
                block = block_of(unpacked(row), order)
                for kind in range(order):
                    yield requests(row["block"][0].as_py(), block, kind)

    return texts.mapInArrow(run, "kind int, range int, block long, keys binary, kept binary, tuned binary")


def answer(requests: DataFrame) -> DataFrame:
    """The totals for each request in the order of its keys; one row of a range has its sums."""
    names = ["kind", "range", "block", "kept", "tuned", "n_kept", "v_kept", "n_all", "v_all"]

    def run(table: pa.Table) -> pa.Table:
        asked = [keys_of(x) for x in table["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        kept, tuned = (
            np.bincount(at, np.concatenate([grown(x) for x in table[c].to_pylist()]), len(keys)).astype(np.int64)
            for c in ("kept", "tuned")
        )
        every = kept + tuned
        sums = (kept.sum(), (kept > 0).sum(), every.sum(), (every > 0).sum())
        ends = np.cumsum([len(x) for x in asked])
        parts = [at[end - len(x) : end] for x, end in zip(asked, ends)]
        columns = [
            table["kind"], table["range"], table["block"],
            pa.array([shrunk(kept[x]) for x in parts], pa.binary()),
            pa.array([shrunk(tuned[x]) for x in parts], pa.binary()),
            *(pa.array([int(x)] + [0] * (len(parts) - 1), pa.int64()) for x in sums),
        ]
        return pa.table(columns, names=names)

    schema = "kind int, range int, block long, kept binary, tuned binary"
    return requests.groupBy("kind", "range").applyInArrow(
        run, schema + ", n_kept long, v_kept long, n_all long, v_all long"
    )


def totals(answers: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By kind, a block's answers in the order of its keys."""
    rows = sorted(answers.select(["kind", "range", "kept", "tuned"]).to_pylist(), key=lambda r: (r["kind"], r["range"]))
    return [
        tuple(np.concatenate([grown(r[c]) for r in rows if r["kind"] == kind]) for c in ("kept", "tuned"))
        for kind in range(order)
    ]


def buckets(counts: np.ndarray) -> np.ndarray:
    """0 for none, else one more than the power of two."""
    return np.where(counts > 0, np.frexp(counts.astype(float))[1], 0)


def bucket_of(contexts: list[np.ndarray]) -> np.ndarray:
    """The bucket of the longest context that occurs, 64 buckets a length; 0 if none does."""
    bucket = buckets(contexts[0])
    for longer, counts in enumerate(contexts[1:], 1):
        bucket = np.where(counts > 0, 64 * longer + buckets(counts), bucket)
    return bucket


def estimates(runs: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> list[np.ndarray]:
    """The estimates of each token from the longest context to none."""
    after = [run / np.maximum(context, 1) for run, context in zip(runs[1:], contexts)]
    return [*after[::-1], runs[0] / max(tokens, 1)]


@dataclass
class Model:
    """Weights per bucket, from the longest context to the uniform estimate, and the corpus totals."""

    weights: np.ndarray
    tokens: int
    distinct: int

    def chances(self, runs: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        weights = self.weights[bucket_of(contexts)]
        mix = weights[:, -1] / (self.distinct + 1)
        for at, estimate in enumerate(estimates(runs, contexts, self.tokens)):
            mix += weights[:, at] * estimate
        return mix


def rounded(chances: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        steps = np.rint(-STEPS * np.log2(chances))
    return np.where(chances > 0, np.minimum(steps, NONE - 1), NONE).astype(np.int64)


def tuning_table(docs: DataFrame, answers: DataFrame, tokens: int, order: int) -> DataFrame:
    """How many tuning tokens have which bucket and rounded estimates."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            cells, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        else:
            block = block_of(unpacked(table), order)
            runs, contexts = block.found([kept for kept, _ in totals(found, order)])
            cells = bucket_of(contexts).astype(np.int64)
            for estimate in estimates(runs, contexts, tokens):
                cells = cells * 512 + rounded(estimate)
            cells, n = np.unique(cells, return_counts=True)
        return pa.table([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    pairs = docs.groupBy("block").cogroup(answers.groupBy("block"))
    return pairs.applyInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def maximise(cells: np.ndarray, n: np.ndarray, distinct: int, order: int = 2) -> np.ndarray:
    """Weights per bucket; a bucket without tokens takes those of all together."""

    def estimate(steps: np.ndarray) -> np.ndarray:
        return np.where(steps == NONE, 0.0, 2.0 ** (-steps / STEPS))

    columns = []
    for _ in range(order):
        columns.append(estimate(cells % 512))
        cells = cells // 512
    chances = np.stack([*columns[::-1], np.full(len(cells), 1 / (distinct + 1))], axis=1)

    def fit(rows: np.ndarray) -> np.ndarray:
        weights = np.full(order + 1, 1 / (order + 1))
        for _ in range(ROUNDS):
            share = weights * chances[rows]
            share *= (n[rows] / share.sum(1))[:, None]
            weights = share.sum(0) / n[rows].sum()
        weights = np.maximum(weights, 1e-6)
        return weights / weights.sum()

    everything = fit(np.arange(len(cells))) if len(cells) else np.array([0.0] * (order - 1) + [0.5, 0.5])
    found = [np.flatnonzero(cells == b) for b in range(64 * (order - 1))]
    return np.stack([fit(rows) if len(rows) else everything for rows in found])


def score_blocks(docs: DataFrame, answers: DataFrame, model: Model, order: int) -> DataFrame:
    floor = model.tokens + 0.5 * (model.distinct + 1)
    names = ["doc_id", "fold", "n_tokens", "n_known", "base_score", "score"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], kind) for kind in kinds], names=names)
        table = unpacked(table)
        block = block_of(table, order)
        runs, contexts = block.found([kept + tuned for kept, tuned in totals(found, order)])
        own, chances = runs[WORDS], model.chances(runs, contexts)

        def each(values: np.ndarray) -> np.ndarray:
            return np.bincount(block.doc, values, len(block.sizes))

        columns = [
            table["doc_id"], table["fold"], block.sizes, each(own > 0).astype(np.int64),
            each(np.log10((own + 0.5) / floor)), each(np.log10(chances)),
        ]
        columns = [c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, kinds)]
        return pa.table(columns, names=names)

    schema = "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, block: int = BLOCK, hash_range: int = RANGE, order: int = 2) -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score and score of every text.

    Scores are sums of log10 probabilities; `order` (2 to 5) is the length of the longest runs counted.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // hash_range))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("fold"), "text"
    )
    path = new_path(docs.sparkSession, "text-blocks")
    few = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1"}  # long rows, packed already
    packed(docs, block).write.options(**few).parquet(path)
    texts = docs.sparkSession.read.parquet(path)
    answers = written(answer(ask(texts, ranges, order)), "counts")
    sums = answers.where(F.col("kind") == WORDS).agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_kept", "v_kept", "n_all", "v_all"))
    )
    n_kept, v_kept, n_all, v_all = sums.first()
    of_tuning = F.col("block") % 2 == 1
    table = tuning_table(texts.where(of_tuning), answers.where(of_tuning), n_kept, order).toArrow()
    weights = maximise(table["cell"].to_numpy(), table["n"].to_numpy(), v_kept, order)
    model = Model(weights, n_all, v_all)
    scored = score_blocks(texts, answers, model, order)
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))
