"""Remove passages that also stand in earlier documents, found in a sorted array of suffixes.

A byte goes if some string of `length` bytes that covers it also starts in a document with a smaller
doc_id; strings are judged on the texts as given and never cross documents.

The array is sparse. Of the 16-byte strings inside each window of `length` bytes the one of least hash is
its anchor: equal windows have their anchor at the same place, and neighbours mostly share one, so about
one suffix in eighteen stands for all windows. An anchor's record is the suffix that starts at it, as
far as its windows reach, and the bytes before it, read backwards.

1. An anchor's windows are parted by the side of it that they mostly lie on. All windows of a half hold one
   string about two thirds of `length` long, which in a large corpus seldom repeats by chance, while 16
   bytes mostly do. Hashes of these strings are dealt out over slots, and halves whose string stands in one
   document only are dropped: no window there can repeat. A slot gets four bytes a half and says back one
   bit; the documents of a block of texts are told by their number within it, so neither grows with the
   number of slots.
2. Each task sorts the suffixes of its documents, folds equal records into one (only the smallest
   document matters to others, later ones are settled at once) and writes one run per key range, front
   coded: length of the prefix shared with the suffix before, and the rest.
3. A range's runs are merged by a loser tree that carries, for each run, the length of the prefix its
   head shares with the last suffix put out. Heads are told apart by that length alone; only if it is
   equal do they compare bytes, from there on. The same lengths are the common prefixes (LCP) of the
   merged array. Where it is at least `length - o`, two windows that start `o` bytes before their anchors
   agree to the right; the same array of the bytes before, backwards, says so to the left. Both numbers
   name a window's class, whose smallest document keeps it.

Ranges are cut at strings drawn from a bounded sample of texts; it affects balance only. Anchors whose shared
halves stand in over `HOT` places, and in over a 64th of what their slot holds, are not ranged by their suffix:
each of their windows is a record of its own, dealt out by the hash of its bytes, so a passage found
everywhere is one record per task and window. A bound that did not grow with the slots would, in a large
corpus, turn anchors with a place or two in each task into some seventeen records each.
Texts meet the marks by (document, hash of text): they are shuffled once, and Spark reuses that. Equal
texts are told by a 128-bit hash; only the first takes part, the others go whole.

Null texts count as empty, and texts shorter than `length` bytes stay. Null ids count as one document
before all others. Rows that share an id do not remove each other's bytes; rows that repeat id and text
get the same result. An empty table gives an empty result. Other columns pass through, whatever their
names; only the columns that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.words import columns, pieces

LENGTH, GRAM = 50, 16
FIRST = -(1 << 63)  # stands for a null id
HOT, SLOT_SHARE = 1_000, 64  # places of one 16-byte string; and the part of a slot that they are
HALF_BITS = 20  # of a name, for the half; 12 more and the slot are for the 16-byte string
NAMES_AT_ONCE = 1_000_000
SLOT_BYTES = 64 << 20  # of texts, whose anchors or records one slot takes on average
MOST_RANGES, SAMPLES_PER_RANGE, SAMPLES_PER_TEXT = 4_096, 64, 8
BATCH_BYTES, CHUNK = 4 << 20, 1 << 20
RUN_RECORDS, RECORDS_AT_ONCE = 200_000, 20_000
ADDED = ("n_bytes", "removed", "kept")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window, and name of each half of every anchor of a text.

    One half are the windows that start over `half` bytes before the anchor, the other those that start
    nearer. The upper 44 bits of a name hash the anchor's string, the lower ones what all windows of the half hold.
    """
    half, found = (length - GRAM) // 2, []
    for start in range(0, len(data) - length + 1, CHUNK):
        part = data[start : start + CHUNK + length - 1]
        h, span = mixed(part.astype(np.uint64) + np.uint64(1)), 1
        while span < GRAM:
            h, span = paired(h[:-span], h[span:]), span * 2
        ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (least_of(ranked, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        near = np.arange(len(at)) >= at - half
        lo = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (near[1:] != near[:-1])]))
        hi = np.append(lo[1:], len(at)) - 1
        at, near = at[lo], near[lo]
        names = np.empty(len(at), dtype=np.uint64)
        for of, begin, end in ((near, 0, length - half), (~near, -half - 1, GRAM)):
            names[of] = spelled(h, at[of] + begin, end - begin, int(begin < 0))
        names >>= np.uint64(64 - HALF_BITS)
        names |= mixed(h[at] + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(-1 << HALF_BITS & (1 << 64) - 1)
        found.append((at + start, lo + start, hi + start, names))
    if not found:
        return (*(np.zeros(0, dtype=np.int64),) * 3, np.zeros(0, dtype=np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def spelled(h: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the strings of `size` bytes at these places, of those of `GRAM` bytes within them."""
    total = np.full(len(at), seed, dtype=np.uint64)
    for step in [*range(0, size - GRAM, GRAM), size - GRAM]:
        total = paired(total, h[at + step])
    return total


def slots_of(names: np.ndarray, slots: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(x) for x in arrays], dtype=np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(x.tobytes() for x in arrays)]), 1)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    at, found = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, dtype=np.int64, count=len(kinds)).tolist(), kinds):
        found.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
        at += found[-1].nbytes
    return found


def cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the end."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def text_bytes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for value in batch.column("text"):
        yield np.frombuffer(value.as_buffer() if value.is_valid else b"", dtype=np.uint8)


def document_cuts(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Where neighbours of one document begin, and the end."""
    new = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(doc)]]) if len(doc) else np.zeros(1, dtype=np.int64)


def united(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same spans of each document, with those that meet or overlap made one."""
    if not len(doc):
        return doc, tag, start, end
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    at = document_cuts(doc, tag)
    shift = np.repeat(np.arange(len(at) - 1), np.diff(at)) * (end.max() + 2)  # documents in a row
    far = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > far[:-1])
    last = np.append(new[1:], True)
    return doc[new], tag[new], start[new], (far - shift)[last]


def routed(doc: np.ndarray, tag: np.ndarray, values: tuple[np.ndarray, ...], buckets: int) -> pa.Table:
    """Packed rows, one for each bucket that some of the documents fall into."""
    bucket = (tag & np.int64(0x7FFFFFFFFFFFFFFF)) % buckets
    order = np.argsort(bucket, kind="stable")
    arrays = [x[order] for x in (doc, tag, *values)]
    at = cuts(bucket[order])
    blobs = [pack(*(x[begin:end] for x in arrays)) for begin, end in zip(at[:-1], at[1:])]
    return pa.table({
        "bucket": pa.array(bucket[order][at[:-1]], pa.int32()), "blob": pa.array(blobs, pa.binary()),
    })


def gathered(rows: DataFrame) -> DataFrame:
    """doc, tag and the united list of all spans that were routed for the document."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [unpack(x, *(np.int64,) * 4) for x in group.column("blob").to_pylist()]
        doc, tag, *values = united(*(np.concatenate(x) for x in zip(*blobs)))
        at = document_cuts(doc, tag)
        flat = np.stack(values, 1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(at * 2, pa.int32()), pa.array(flat, pa.int64()))
        return pa.table({"doc": doc[at[:-1]], "tag": tag[at[:-1]], "spans": lists})

    return rows.groupBy("bucket").applyInArrow(run, "doc long, tag long, spans array<long>")


# 1. Halves of anchors that stand in more than one document.


class Names:
    """Names of the halves of some documents' anchors, gathered to be dealt out as one block."""

    def __init__(self, slots: int):
        self.slots, self.task, self.blocks = slots, TaskContext.get().partitionId(), 0
        self.documents: list[tuple[int, int]] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, names: np.ndarray, doc: int, tag: int) -> None:
        self.documents.append((doc, tag))
        self.parts.append(names)
        self.size += len(names)

    def block(self) -> pa.RecordBatch:
        """A row for each slot, with the number of documents since the last name and 32 bits of each; and who they are."""
        names = np.concatenate(self.parts)
        which = np.repeat(np.arange(len(self.parts), dtype=np.uint32), [len(x) for x in self.parts])
        slot = slots_of(names, self.slots)
        order = np.argsort(slot, kind="stable")
        slot, which, names = slot[order], which[order], names[order].astype(np.uint32)
        at = cuts(slot)
        who = [pack(planes(np.diff(which[a:b], prepend=np.uint32(0)))) for a, b in zip(at[:-1], at[1:])]
        what = [pack(names[a:b]) for a, b in zip(at[:-1], at[1:])]
        directory = pack(*np.array(self.documents, dtype=np.int64).T)
        dealt = [*slot[at[:-1]].tolist(), (self.task + self.blocks) % self.slots]
        number = [(self.task << 32) + self.blocks] * len(dealt)
        self.documents, self.parts, self.size, self.blocks = [], [], 0, self.blocks + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(dealt, pa.int32()), pa.array(number, pa.int64()),
                pa.array([*who, directory], pa.binary()), pa.array([*what, None], pa.binary()),
            ],
            names=["slot", "block", "who", "names"],
        )


def planes(values: np.ndarray) -> np.ndarray:
    """The lowest bytes of all, then the next: small numbers pack well so."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def dealt_anchors(texts: DataFrame, length: int, slots: int) -> DataFrame:
    """Per slot and block of texts: the names of halves, and what tells their documents.

    Texts must come in the order of (doc, tag), so that a task that is run again numbers them as before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = Names(slots), None
        for batch in pieces(batches, BATCH_BYTES):
            doc, tag = (batch.column(x).to_pylist() for x in ("doc", "tag"))
            for i, data in enumerate(text_bytes(batch)):
                if len(data) < length or last == (last := (doc[i], tag[i])):
                    continue
                names.add(anchors(data, length)[3], doc[i], tag[i])
                if names.size >= NAMES_AT_ONCE:
                    yield names.block()
        if names.size:
            yield names.block()

    return texts.mapInArrow(run, "slot int, block long, who binary, names binary")


def shared_anchors(dealt: DataFrame, hot: int, slots: int) -> DataFrame:
    """Said back to each block: which halves others hold too, as bits, and which of them are hot."""

    def run(group: pa.Table) -> pa.Table:
        passed = group.filter(group.column("names").is_null())
        group = group.filter(group.column("names").is_valid())
        who = group.column("who").to_pylist()
        parts = [unpack(x, np.uint32)[0] for x in group.column("names").to_pylist()]
        at = np.cumsum([0, *(len(x) for x in parts)])
        bits = [[]] * len(parts)
        if parts:
            # Numbers over all blocks: no two documents share one.
            owner = np.concatenate([np.cumsum(unplaned(unpack(x, np.uint8)[0]), dtype=np.int64) for x in who])
            owner += np.repeat(np.cumsum([0, *(owner[at[1:-1] - 1] + 1)]), np.diff(at))
            shared, is_hot = held_by_others(np.concatenate(parts), owner, hot)
            flags = [(shared[a:b], is_hot[a:b]) for a, b in zip(at[:-1], at[1:])]
            bits = [pack(np.packbits(x), np.packbits(y) if y.any() else np.zeros(0, np.uint8)) for x, y in flags]
        slot = group.column("slot").to_pylist()
        return pa.table({
            "block": pa.array([*group.column("block").to_pylist(), *passed.column("block").to_pylist()], pa.int64()),
            "place": pa.array([*slot, *[-1] * len(passed)], pa.int32()),
            "who": pa.array([*who, *passed.column("who").to_pylist()], pa.binary()),
            "bits": pa.array([*bits, *[None] * len(passed)], pa.binary()),
        })

    return dealt.groupBy("slot").applyInArrow(run, "block long, place int, who binary, bits binary")


def held_by_others(names: np.ndarray, owner: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Which names of a slot stand in more than one document, and which of these are of a hot string; `owner` ascends."""
    ranked = np.sort(names.astype(np.uint64) << np.uint64(32) | np.arange(len(names), dtype=np.uint64))
    order = (ranked & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = cuts(ranked >> np.uint64(32))
    n = np.diff(at)
    several = owner[order[at[:-1]]] != owner[order[at[1:] - 1]]
    string = names[order[at[:-1]]] >> np.uint32(HALF_BITS)
    places = np.bincount(string, weights=n * several)
    is_hot = several & (places[string] > max(hot, len(names) // SLOT_SHARE))
    found = np.empty((2, len(names)), dtype=bool)
    found[:, order] = np.repeat(np.stack([several, is_hot]), n, axis=1)
    return found[0], found[1]


def of_documents(answers: DataFrame) -> DataFrame:
    """Each document with shared halves, once: a bit for each of its halves in the order of slots, then of places."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(x).to_pylist() for x in ("place", "who", "bits"))), key=lambda row: row[0])
        doc, tag = unpack(rows[0][1], np.int64, np.int64)
        which, flags = [], []
        for _, who, bits in rows[1:]:
            which.append(np.cumsum(unplaned(unpack(who, np.uint8)[0]), dtype=np.int64))
            n = len(which[-1])
            both = unpack(bits, np.uint8, np.uint8)
            flags.append(np.stack([np.unpackbits(x, count=n) if len(x) else np.zeros(n, np.uint8) for x in both]))
        which = np.concatenate(which)
        order = np.argsort(which, kind="stable")
        which, flags = which[order], np.concatenate(flags, axis=1)[:, order]
        n = np.bincount(which, minlength=len(doc))
        any_of = [np.bincount(which, weights=x, minlength=len(doc)) > 0 for x in flags]
        taken = np.flatnonzero(any_of[0])
        columns = []
        for flag, has in zip(flags, any_of):
            size = np.where(has, -(-n // 8), 0)  # whole bytes for each document
            end = np.cumsum(size)
            padded = np.zeros(8 * int(end[-1]), dtype=np.uint8)
            rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            here = has[which]
            padded[(8 * (end - size)[which] + rank)[here]] = flag[here]
            raw = np.packbits(padded).tobytes()
            columns.append(pa.array([raw[e - s : e] for s, e in zip(size[taken], end[taken])], pa.binary()))
        return pa.table({"doc": doc[taken], "tag": tag[taken], "shared": columns[0], "hot": columns[1]})

    found = answers.groupBy("block").applyInArrow(run, "doc long, tag long, shared binary, hot binary")
    return found.dropDuplicates(["doc", "tag"])  # rows that repeat a document are said the same


# 2. Sorted, front-coded runs.


class Records:
    """Suffixes of anchors with the bytes before them, gathered over some documents of one task."""

    def __init__(self, length: int, slots: int, splitters: np.ndarray):
        self.length, self.slots, self.splitters = length, slots, splitters
        self.left = length - GRAM
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, data: np.ndarray, doc: int, tag: int, shared: bytes, hot: bytes) -> Iterator[None]:
        """Take in the shared anchors of a text, some at a time."""
        at, lo, hi, names = anchors(data, self.length)
        order = np.argsort(slots_of(names, self.slots), kind="stable")
        flags = np.zeros((2, len(at)), dtype=bool)
        for flag, bits in zip(flags, (shared, hot)):
            if bits:
                flag[order] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(at))
        hot, plain = flags[1], flags[0] & ~flags[1]
        each = (hi - lo + 1)[hot]
        window = np.repeat(lo[hot] - np.cumsum(each) + each, each) + np.arange(each.sum())
        at, lo, hi = at[plain], lo[plain], hi[plain]
        new = np.append(True, (at[1:] != at[:-1]) | (lo[1:] != hi[:-1] + 1))[: len(at)]  # halves that meet are one
        at, lo, hi = at[new], lo[new], hi[np.append(new[1:], True)[: len(at)]]
        for at, lo, hi, is_hot in ((at, lo, hi, False), (window, window, window, True)):
            for begin in range(0, len(at), RECORDS_AT_ONCE):
                here = slice(begin, begin + RECORDS_AT_ONCE)
                rows = self.context(data, at[here], lo[here], hi[here])
                same = (np.full(len(rows), x) for x in (doc, tag, is_hot))
                self.parts.append((rows, lo[here], *same))
                self.size += len(rows)
                yield

    def context(self, data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A row of bytes each: suffix, its length, the bytes before backwards, their number."""
        room, left = self.length, self.left
        row = np.zeros((len(at), room + left + 2), dtype=np.uint8)
        n_right, n_left = hi + room - at, at - lo
        step = np.arange(room)
        right = data[np.minimum(at[:, None] + step, len(data) - 1)]
        row[:, :room] = np.where(step < n_right[:, None], right, 0)
        row[:, room] = n_right
        step = np.arange(left)
        before = data[np.maximum(at[:, None] - 1 - step, 0)]
        row[:, room + 1 : -1] = np.where(step < n_left[:, None], before, 0)
        row[:, -1] = n_left
        return row

    def runs(self) -> Iterator[tuple[int, bytes | None, bytes | None]]:
        """A run for every slot that these records fall into, and one row of spans that are settled here."""
        rows, lo, doc, tag, hot = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        room = self.length
        grams = np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").ravel()
        slot = np.searchsorted(self.splitters, grams, side="right")
        wide = -(-self.slots // (len(self.splitters) + 1))  # slots per range
        if wide > 1:
            slot = slot * wide + (folded(rows[:, :GRAM]) % np.uint64(wide)).astype(np.int64)
        slot[hot] = (folded(rows[hot, :room]) % np.uint64(self.slots)).astype(np.int64)
        order = np.lexsort((doc, rows.view(f"S{rows.shape[1]}").ravel(), slot))
        rows, lo, doc, tag, slot = rows[order], lo[order], doc[order], tag[order], slot[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1) | (slot[1:] != slot[:-1]))
        record = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        first = doc[heads]
        stays = doc == first[record]
        n_places = np.bincount(record[stays], minlength=len(heads)).astype(np.uint32)
        start, end = lo, lo + rows[:, room].astype(np.int64) + rows[:, -1]
        rows, head_slot = rows[heads], slot[heads]
        same = rows[1:, :room] == rows[:-1, :room]
        lcp = np.where(same.all(1), room, same.argmin(1))
        n_right, n_left = rows[:, room].astype(np.int64), rows[:, -1].astype(np.int64)
        lcp = np.append(0, np.minimum(lcp, np.minimum(n_right[1:], n_right[:-1])))
        lcp[1:][head_slot[1:] != head_slot[:-1]] = 0
        step = np.arange(room)
        rest = (step >= lcp[:, None]) & (step < n_right[:, None])
        before = np.arange(self.left) < n_left[:, None]
        at = cuts(head_slot)
        bounds = np.append(heads, len(lo))
        for begin, finish in zip(at[:-1], at[1:]):
            here, whole = slice(begin, finish), slice(bounds[begin], bounds[finish])
            kept = stays[whole]
            run = pack(
                lcp[here].astype(np.uint8), n_right[here].astype(np.uint8), n_left[here].astype(np.uint8),
                rows[here, :room][rest[here]], rows[here, room + 1 : -1][before[here]],
                first[here], n_places[here], tag[whole][kept], lo[whole][kept].astype(np.uint32),
            )
            yield int(head_slot[begin]), run, None
        gone = ~stays
        if gone.any():
            # Whatever slot takes them passes them on; the spans of a document are one by now.
            spans = united(doc[gone], tag[gone], start[gone], end[gone])
            yield int(spans[1][0] & 0x7FFFFFFF) % self.slots, None, pack(*spans)


RUN = (np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.uint32, np.int64, np.uint32)


def folded(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    total = np.zeros(len(rows), dtype=np.uint64)
    for column in range(rows.shape[1]):
        total = paired(total, rows[:, column].astype(np.uint64) + np.uint64(1))
    return total


def sorted_runs(
    texts: DataFrame, length: int, slots: int, splitters: np.ndarray, most: int = RUN_RECORDS
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = Records(length, slots, splitters)

        def flushed() -> Iterator[pa.RecordBatch]:
            for slot, blob, settled in records.runs():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([blob], pa.binary()), pa.array([settled], pa.binary())],
                    names=["slot", "run", "settled"],
                )

        for batch in pieces(batches, BATCH_BYTES):
            doc, tag = (batch.column(x).to_numpy() for x in ("doc", "tag"))
            for i, data in enumerate(text_bytes(batch)):
                for _ in records.add(data, doc[i], tag[i], *(batch.column(x)[i].as_py() for x in ("shared", "hot"))):
                    if records.size >= most:
                        yield from flushed()
        if records.size:
            yield from flushed()

    return texts.mapInArrow(run, "slot int, run binary, settled binary")


# 3. Merging runs, and what their common prefixes say.


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, place in the run and LCP with the one before, of all suffixes in their merged order.

    A run has its suffixes in order, and the LCP of each with the one before it.
    """
    k = len(runs)
    heads = [suffixes[0] for suffixes, _ in runs]
    shared = [0] * k  # with the last suffix put out; -1 when a run is used up
    place = [0] * k

    def loses(a: int, b: int) -> bool:
        """Whether a comes after b; the loser then holds the LCP with the winner."""
        if shared[a] != shared[b]:
            return shared[a] < shared[b]
        h = shared[a]
        if h < 0:
            return a > b
        x, y = heads[a], heads[b]
        n = min(len(x), len(y))
        if x[h:n] == y[h:n]:
            later = (len(x), a) > (len(y), b)
            h = n
        else:
            while x[h] == y[h]:
                h += 1
            later = x[h] > y[h]
        shared[a if later else b] = h
        return later

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if loses(a, b):
            a, b = b, a
        winners[node], losers[node] = a, b
    winner = winners[1] if k > 1 else 0
    total = sum(len(suffixes) for suffixes, _ in runs)
    out_run, out_place, out_lcp = [0] * total, [0] * total, [0] * total
    for i in range(total):
        suffixes, lcps = runs[winner]
        at = place[winner]
        out_run[i], out_place[i], out_lcp[i] = winner, at, shared[winner]
        at += 1
        place[winner] = at
        if at < len(suffixes):
            heads[winner], shared[winner] = suffixes[at], lcps[at]
        else:
            shared[winner] = -1
        node = (winner + k) >> 1
        while node:
            if loses(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node >>= 1
    return np.array(out_run), np.array(out_place), np.array(out_lcp)


def decoded(lcp: np.ndarray, sizes: np.ndarray, rest: bytes) -> tuple[list[bytes], list[int]]:
    """The suffixes of a front-coded run."""
    suffixes, last, at = [], b"", 0
    for h, size in zip(lcp.tolist(), sizes.tolist()):
        last = last[:h] + rest[at : at + size - h]
        at += size - h
        suffixes.append(last)
    return suffixes, lcp.tolist()


def repeated_windows(
    lcp: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, doc: np.ndarray, length: int
) -> np.ndarray:
    """[record, o]: whether the window `o` bytes before the record's anchor also stands in an earlier document.

    Records come in the order of their suffixes, `lcp` with the one before; `left` has the bytes before
    each anchor backwards.
    """
    n, room = left.shape
    order = np.argsort(left.view(f"S{room}").ravel(), kind="stable")
    back = left[order]
    same = back[1:] == back[:-1]
    left_lcp = np.append(0, np.where(same.all(1), room, same.argmin(1)))
    gone = np.zeros((n, room + 1), dtype=bool)
    of_left = np.empty(n, dtype=np.int64)
    for o in range(room + 1):
        here = np.flatnonzero((length - n_right <= o) & (o <= n_left))
        if not len(here):
            continue
        of_left[order] = np.cumsum(left_lcp < o) if o else 0
        name = (np.cumsum(lcp < length - o) * (n + 1) + of_left)[here]
        by_name = np.argsort(name)
        at = cuts(name[by_name])
        least = np.minimum.reduceat(doc[here][by_name], at[:-1])
        gone[here[by_name], o] = doc[here][by_name] > np.repeat(least, np.diff(at))
    return gone


def judged(group: pa.Table, length: int, slots: int) -> pa.Table:
    """The spans that the windows of one slot remove, routed to their documents."""
    found = [unpack(x, *(np.int64,) * 4) for x in group.column("settled").drop_null().to_pylist()]
    runs = [unpack(x, *RUN) for x in group.column("run").drop_null().to_pylist()]
    if runs:
        found.append(removed_by(runs, length))
    doc, tag, start, end = united(*(np.concatenate(x) for x in zip(*found)))
    return routed(doc, tag, (start, end), slots)


def removed_by(runs: list[list[np.ndarray]], length: int) -> tuple[np.ndarray, ...]:
    """doc, tag, start and end of every stretch of windows that stand in earlier documents too."""
    room = length - GRAM
    run, place, lcp = merge([decoded(x[0], x[1], x[3].tobytes()) for x in runs])
    starts = np.cumsum([0] + [len(x[0]) for x in runs])
    order = starts[run] + place
    n_right, n_left, doc, n_places = (
        np.concatenate([x[i] for x in runs]).astype(np.int64)[order] for i in (1, 2, 5, 6)
    )
    left = np.zeros((len(order), room), dtype=np.uint8)
    sizes = np.concatenate([x[2] for x in runs])
    filled = np.zeros_like(left)
    filled[np.arange(room) < sizes[:, None]] = np.concatenate([x[4] for x in runs])
    left = filled[order]
    gone = repeated_windows(lcp, n_right, left, n_left, doc, length)
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    record, near = np.nonzero(edges == 1)  # windows from `near` to `far` bytes before the anchor
    far = np.nonzero(edges == -1)[1] - 1
    tags, los = (np.concatenate([x[i] for x in runs]).astype(np.int64) for i in (7, 8))
    all_places = np.concatenate([x[6] for x in runs]).astype(np.int64)
    first_place = (np.cumsum(all_places) - all_places)[order]
    times = n_places[record]
    which = np.repeat(np.arange(len(record)), times)
    at = np.repeat(first_place[record] - np.cumsum(times) + times, times) + np.arange(len(which))
    anchor = los[at] + n_left[record[which]]
    return doc[record[which]], tags[at], anchor - far[which], anchor - near[which] + length


# Texts and their marks.


def sampled(docs: DataFrame, length: int) -> tuple[int, np.ndarray]:
    """The number of slots and the strings that cut their ranges, from a bounded sample of texts."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.count()
    wanted = MOST_RANGES * SAMPLES_PER_RANGE // SAMPLES_PER_TEXT
    share = min(1.0, min(wanted, max(2_000, least * SAMPLES_PER_RANGE // SAMPLES_PER_TEXT)) / max(1, total))
    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            sizes, grams = [], []
            for data in text_bytes(batch):
                at = anchors(data[: CHUNK], length)[0]
                sizes.append(len(data))
                spread = np.linspace(0, max(0, len(at) - 1), min(len(at), SAMPLES_PER_TEXT)).astype(int)
                grams.append([data[x : x + GRAM].tobytes() for x in at[spread]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.binary()))], names=["size", "grams"]
            )

    rows = few.select("text").mapInArrow(run, "size long, grams array<binary>").collect()
    mean = sum(row["size"] for row in rows) / max(1, len(rows))
    slots = max(least, int(mean * total) // SLOT_BYTES + 1)
    grams = np.sort(np.array([bytes(g) for row in rows for g in row["grams"]], dtype=f"S{GRAM}"))
    ranges = min(slots, MOST_RANGES, len(grams) + 1)
    splitters = grams[np.linspace(0, len(grams), ranges + 1).astype(int)[1:-1]] if len(grams) else grams
    return slots, np.unique(splitters)


def cut(texts: DataFrame, length: int, schema: T.StructType) -> DataFrame:
    """The removed spans, merged, and the bytes that stay; the text and what marked it go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            sizes, removed, kept = [], [], []
            spans, first = batch.column("spans"), batch.column("first").to_pylist()
            for i, data in enumerate(text_bytes(batch)):
                if not first[i]:
                    found = [(0, len(data))] if len(data) >= length else []
                elif spans[i].is_valid:
                    found = spans[i].values.to_numpy().reshape(-1, 2).tolist()
                else:
                    found = []
                raw, at, rest = data.tobytes(), 0, []
                for start, end in found:
                    rest.append(raw[at:start])
                    at = end
                sizes.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join([*rest, raw[at:]]))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            plain = [batch.column(name) for name in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays(
                [*plain, pa.array(sizes, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary())],
                names=schema.names,
            )

    return texts.mapInArrow(run, schema)


def dedupe(
    docs: DataFrame, length: int = LENGTH, hot: int = HOT, run_records: int = RUN_RECORDS
) -> DataFrame:
    """The rows without `text`, with `n_bytes`, `removed` (spans of bytes) and `kept` (the bytes that stay)."""
    if not GRAM < length < 200:
        raise ValueError(f"length must be between {GRAM + 1} and 199 bytes, not {length}")
    others = columns(docs, "doc_id", "text", *ADDED)
    base = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*others).alias("row")] if others else []),
    ).withColumn("tag", F.xxhash64("text"))
    slots, splitters = sampled(base, length)
    texts = base.repartition("doc", "tag")  # the one shuffle of texts: all reads below reuse it
    names = base.select("doc", "tag", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"))
    firsts = names.groupBy("h", "tag").agg(F.min("doc").alias("doc")).select("doc", "tag").distinct()
    alone = texts.join(firsts.hint("merge"), ["doc", "tag"])  # a semi join would be moved below the shuffle
    keys = of_documents(shared_anchors(dealt_anchors(alone, length, slots), hot, slots))
    with_keys = texts.join(keys.hint("merge"), ["doc", "tag"])
    runs = sorted_runs(with_keys, length, slots, splitters, run_records)
    spans = runs.groupBy("slot").applyInArrow(
        lambda group: judged(group, length, slots), "bucket int, blob binary"
    )
    spans = gathered(spans)
    marks = firsts.join(spans.hint("merge"), ["doc", "tag"], "left").withColumn("first", F.lit(True))
    marked = texts.join(marks.hint("merge"), ["doc", "tag"], "left")
    kinds = {field.name: field for field in base.schema.fields}
    added = T.StructType.fromDDL("n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
    whole = T.StructType([kinds["doc_id"], *([kinds["row"]] if others else []), *added.fields])
    done = cut(marked, length, whole)
    names = [name for name in docs.columns if name not in ("text", *ADDED)]
    return done.select(
        *(F.col("doc_id") if name == "doc_id" else F.col("row").getField(name).alias(name) for name in names), *ADDED
    )
