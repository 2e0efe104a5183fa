"""Byte-pair encoding and decoding of documents by guessing tokens and verifying them.

The vocabulary is the public one of a tokenizer file: lower-cased words, split by a pattern, spelt in
bytes, the last byte marked as a word's end, merged by rank. Words are encoded once per task and kept
(up to a bound). New words go through three steps, some 131,072 letters at a time, so that a worker's
memory depends neither on the batch nor on how many of its words are new:

1. Guess: from left to right take the longest token that the rest of the word starts with.
2. Verify: a sequence is the encoder's own exactly if each token is what its own letters encode to
   and no merge ever crosses the seam between two neighbours. Up to the time a merge of rank m runs,
   the tokens next to a seam are one of the right-hand parts the left token is built from, and one
   of the left-hand parts of the right token. A part x is there from its own rank until the rank of
   what it becomes. So the seam between a and b holds unless some right part x of a and left part y
   of b have a merge of rank m that comes before x has become something else (equal ranks: the left
   one goes first) and not after y has. All pairs of a batch are tested at once with numpy.
3. Words with a failing seam, or a tail that no token ends, are merged exactly, rank by rank: short
   ones all at once as rows of a matrix, long ones with a heap.

Null texts count as empty and give no tokens. The strings of added special tokens inside a text
become those tokens, as is the library's default. Rows are independent; repeated rows, ties and null
ids give a row each, in any order; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from undertow.llm.words import pieces

END = "\n"  # stands for the mark of a word's end; no byte is spelt so
MOST_WORDS = 100_000  # kept per Python worker, of each of two generations
MOST_LETTERS = 1 << 17  # encoded at once, or a single word
LONG_WORD = 64  # bytes
SYMBOLS = 512  # more than any character that spells a byte
BATCH_BYTES = 512 << 10
NEVER = np.iinfo(np.int64).max
LAST = np.iinfo(np.int32).max  # later than any rank: when a part stays

# Fixed by the tokenizer: what splits a text into words, and what counts as white space.
SPACE = r"[\t-\r \x85\xa0  -     　]"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|(?:(?!{SPACE})[^\p{{L}}\p{{N}}])+"


def byte_spelling() -> dict[int, str]:
    """Each byte's character: itself where printable, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Codec:
    """Tables of one vocabulary. They are as large as its file, so Spark may broadcast them.

    Each Python worker holds its own copy: `tables` leaves out what only building them needs, and the
    library comes without its vocabulary, for it only normalizes and splits.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]

        def spelt(token: str) -> str:
            return token.removesuffix(mark) + END if token.endswith(mark) else token

        self.ids = {spelt(token): number for token, number in model["vocab"].items()}
        self.letters = {text: n for text, n in self.ids.items() if len(text.removesuffix(END)) <= 1}
        names = {number: token for token, number in model["vocab"].items()}
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        names |= {number: token for token, number in self.special.items()}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        merges = np.array(
            [
                (self.ids[spelt(a)], self.ids[spelt(b)], self.ids[spelt(a) + spelt(b)])
                for a, b in pairs
            ],
            dtype=np.int64,
        ).reshape(-1, 3)
        self.products = merges[:, 2]
        self.size = max(names) + 1
        self.names = [names.get(number) for number in range(self.size)]
        keys = merges[:, 0] * self.size + merges[:, 1]
        self.ranks = {key: rank for rank, key in enumerate(keys.tolist())}
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order.astype(np.int64)
        self.set_parts(merges)
        self.set_trie(self.sound())
        self.spelling = byte_spelling()
        self.unspelt = {spelt: byte for byte, spelt in self.spelling.items()}
        self.split = regex.compile(SPLIT)
        self.settled = set(map(chr, range(128)))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None
        bare = {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.library = Tokenizer.from_str(json.dumps(spec | bare))
        self.words: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}

    def tables(self) -> dict:
        return {name: table for name, table in vars(self).items() if name != "ids"}

    @classmethod
    def of(cls, tables: dict) -> Codec:
        """A codec over the attributes of another: what Spark broadcasts is plain data."""
        codec = cls.__new__(cls)
        codec.__dict__ = tables
        return codec

    def set_parts(self, merges: np.ndarray) -> None:
        """Per token the parts at its right and left edge, itself first, and when each goes."""
        left, right, rank = (np.full(self.size, -1, dtype=np.int64) for _ in range(3))
        left[merges[:, 2]], right[merges[:, 2]] = merges[:, 0], merges[:, 1]
        rank[merges[:, 2]] = np.arange(len(merges))
        self.rank, self.left, self.right = rank, left, right

        def edge(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts, goes = [np.arange(self.size)], [np.full(self.size, LAST)]
            while (parts[-1] >= 0).any():
                now = parts[-1]
                parts.append(np.where(now >= 0, step[now], -1))
                goes.append(np.where(now >= 0, rank[now], -1))
            return np.stack(parts[:-1], 1).astype(np.int32), np.stack(goes[:-1], 1).astype(np.int32)

        self.right_parts, self.right_goes = edge(right)
        self.left_parts, self.left_goes = edge(left)

    def set_trie(self, usable: np.ndarray) -> None:
        """Nodes of all usable tokens' letters: children by (node, letter), and each node's token."""
        children: dict[int, int] = {}
        ends = [-1]
        for text, token in self.ids.items():
            if usable[token]:
                node = 0
                for letter in map(ord, text):
                    key = node * SYMBOLS + letter
                    if key not in children:
                        children[key] = len(ends)
                        ends.append(-1)
                    node = children[key]
                ends[node] = token
        keys = np.fromiter(children, dtype=np.int64, count=len(children))
        order = np.argsort(keys)
        self.child_keys = keys[order]
        self.child = np.fromiter(children.values(), dtype=np.int64, count=len(children))[order]
        self.ends = np.array(ends, dtype=np.int64)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def holds(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the seam of a and b (before rank `until`, if given)."""
        sound = np.ones(len(a), dtype=bool)
        for i in range(self.right_parts.shape[1]):
            x, x_goes = self.right_parts[a, i], self.right_goes[a, i]
            rows = np.flatnonzero((x >= 0) & sound)
            if not len(rows):
                break
            for j in range(self.left_parts.shape[1]):
                y = self.left_parts[b[rows], j]
                rows, y = rows[y >= 0], y[y >= 0]
                if not len(rows):
                    break
                rank = self.merge_rank(x[rows], y)
                end = LAST if until is None else until[rows]
                crosses = (rank < np.minimum(x_goes[rows], end)) & (
                    rank <= self.left_goes[b[rows], j]
                )
                sound[rows[crosses & (rank < NEVER)]] = False
        return sound

    def sound(self) -> np.ndarray:
        """Tokens that the encoder makes of their own letters: built of such, by their own merge."""
        made = np.flatnonzero(self.left >= 0)
        good = np.ones(self.size, dtype=bool)
        good[made] = self.holds(self.left[made], self.right[made], self.rank[made])
        for token in made[np.argsort(self.rank[made])]:  # parts come before what is built of them
            good[token] &= good[self.left[token]] & good[self.right[token]]
        return good

    def guess(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches through all words side by side: word, token and order of each token.

        `letters` holds the words one after another, each with its end mark, a 0 behind the last.
        A word that cannot go on gets the token -1 and stops.
        """
        found_word, found_token, found_order = [], [], []
        words, at = np.arange(len(starts) - 1), starts[:-1].copy()
        turn = 0
        while len(words):
            node, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
            best_end, here = at.copy(), at.copy()
            live = np.arange(len(words))
            while len(live):
                key = node[live] * SYMBOLS + letters[here[live]]
                place = np.minimum(np.searchsorted(self.child_keys, key), len(self.child_keys) - 1)
                goes = self.child_keys[place] == key
                live, place = live[goes], place[goes]
                node[live] = self.child[place]
                here[live] += 1
                token = self.ends[node[live]]
                is_token = token >= 0
                best[live[is_token]] = token[is_token]
                best_end[live[is_token]] = here[live[is_token]]
                live = live[here[live] < starts[words[live] + 1]]
            found_word.append(words)
            found_token.append(best)
            found_order.append(np.full(len(words), turn))
            at = best_end
            more = (best >= 0) & (at < starts[words + 1])
            words, at = words[more], at[more]
            turn += 1
        return np.concatenate(found_word), np.concatenate(found_token), np.concatenate(found_order)

    def merge_long(self, tokens: list[int]) -> list[int]:
        """Merge by lowest rank, leftmost first, with a heap over the pairs."""
        after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        ranks, size = self.ranks, self.size
        heap = [
            (ranks[a * size + b], at, a, b)
            for at, (a, b) in enumerate(zip(tokens, tokens[1:]))
            if a * size + b in ranks
        ]
        heapq.heapify(heap)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            right = after[at]
            if tokens[at] != a or right < 0 or tokens[right] != b:
                continue
            tokens[at], tokens[right] = int(self.products[rank]), -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    a, b = tokens[left], tokens[after[left]]
                    if a * size + b in ranks:
                        heapq.heappush(heap, (ranks[a * size + b], left, a, b))
        return [token for token in tokens if token >= 0]

    def merge_short(self, rows: np.ndarray) -> np.ndarray:
        """The same for many words: a row of tokens each, -1 behind the last."""
        rows = rows.copy()
        left, right = rows[:, :-1], rows[:, 1:]
        ranks = np.where(right >= 0, self.merge_rank(left, np.maximum(right, 0)), NEVER)
        live = np.arange(len(rows))
        column = np.arange(rows.shape[1])
        while len(live) and ranks.shape[1]:
            at = ranks[live].argmin(1)
            rank = ranks[live, at]
            live, at, rank = live[rank < NEVER], at[rank < NEVER], rank[rank < NEVER]
            if not len(live):
                break
            gone = (at + 1)[:, None]
            shift = np.minimum(column + (column >= gone), rows.shape[1] - 1)
            now = np.take_along_axis(rows[live], shift, 1)
            now[:, -1] = -1
            now[np.arange(len(live)), at] = self.products[rank]
            kept = np.take_along_axis(ranks[live], np.minimum(shift[:, :-1], ranks.shape[1] - 1), 1)
            kept[:, -1] = NEVER
            each = np.arange(len(live))
            for place in (at - 1, at):
                inside = (place >= 0) & (place < ranks.shape[1])
                who, where = each[inside], place[inside]
                a, b = now[who, where], now[who, where + 1]
                kept[who, where] = np.where(b >= 0, self.merge_rank(a, np.maximum(b, 0)), NEVER)
            rows[live], ranks[live] = now, kept
        return rows

    def exact(self, spelt: list[str]) -> list[list[int]]:
        first = [[self.letters[x] for x in (*word[:-2], word[-2:])] for word in spelt]
        done: dict[int, list[int]] = {}
        for width in (8, 12, 16, 24, LONG_WORD):
            chosen = [n for n, x in enumerate(first) if n not in done and len(x) <= width]
            if chosen:
                rows = np.full((len(chosen), width), -1, dtype=np.int64)
                for row, n in enumerate(chosen):
                    rows[row, : len(first[n])] = first[n]
                merged = self.merge_short(rows)
                lengths = (merged >= 0).sum(1)
                done |= {n: x[:k] for n, x, k in zip(chosen, merged.tolist(), lengths.tolist())}
        return [done[n] if n in done else self.merge_long(x) for n, x in enumerate(first)]

    def encode_words(self, spelt: list[str]) -> list[list[int]]:
        if not spelt:
            return []
        letters = np.frombuffer("".join(spelt).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum([len(word) for word in spelt])])
        word, token, turn = self.guess(np.append(letters, 0), starts)
        order = np.lexsort((turn, word))
        word, token = word[order], token[order]
        good = np.ones(len(spelt), dtype=bool)
        good[word[token < 0]] = False
        inner = np.flatnonzero((word[1:] == word[:-1]) & (token[1:] >= 0))
        pair, which = np.unique(token[inner] * self.size + token[inner + 1], return_inverse=True)
        held = self.holds(pair // self.size, pair % self.size)[which]
        good[word[inner[~held]]] = False
        bounds = np.searchsorted(word, np.arange(len(spelt) + 1))
        tokens, bounds = token.tolist(), bounds.tolist()
        failing = np.flatnonzero(~good).tolist()
        mended = dict(zip(failing, self.exact([spelt[n] for n in failing])))
        return [
            mended[n] if n in mended else tokens[bounds[n] : bounds[n + 1]] for n in range(len(spelt))
        ]

    def split_words(self, text: str) -> list[str]:
        """The words of a text; special strings stand as they are, after a NUL.

        Letters and numbers that Unicode has held since version 3.2 are the same to every library;
        a part with later characters is split by the tokenizers library itself.
        """
        found: list[str] = []
        for part in self.marks.split(text) if self.marks and "<|" in text else (text,):
            if part in self.special:
                found.append("\0" + part)
            elif part.isascii():
                found += self.split.findall(part.lower())
            elif self.is_settled(part):
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += self.split.findall(plain)
            else:
                plain = self.library.normalizer.normalize_str(part)
                found += [
                    bytes(map(self.unspelt.__getitem__, word)).decode("utf-8")
                    for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)
                ]
        return found

    def is_settled(self, text: str) -> bool:
        fresh = set(text) - self.settled
        self.settled |= {x for x in fresh if unicodedata.ucd_3_2_0.category(x) != "Cn"}
        return fresh <= self.settled

    def keep(self, words: set[str]) -> None:
        """Encode the words of a batch that are not kept yet.

        Once `words` is full it becomes the older generation, from which words in use come back.
        """
        if len(self.words) > MOST_WORDS:
            self.words, self.older = {}, self.words
        fresh = []
        for word in words:
            if word not in self.words:
                if word in self.older:
                    self.words[word] = self.older[word]
                elif word[0] == "\0" and word[1:] in self.special:
                    self.keep_tokens(word, [self.special[word[1:]]])
                else:
                    fresh.append(word)
        part, spelt, letters = 0, [], 0
        for place, word in enumerate(fresh, 1):
            spelt.append(word.encode("utf-8").decode("latin-1").translate(self.spelling) + END)
            letters += len(spelt[-1])
            if letters >= MOST_LETTERS or place == len(fresh):
                for known, tokens in zip(fresh[part:place], self.encode_words(spelt)):
                    self.keep_tokens(known, tokens)
                part, spelt, letters = place, [], 0

    def keep_tokens(self, word: str, tokens: list[int]) -> None:
        self.words[word] = (" ".join(map(str, tokens)), self.decode(tokens), len(tokens))

    def decode(self, tokens: list[int]) -> str:
        """Token strings joined by a space: the vocabulary's file names no decoder."""
        return " ".join(map(self.names.__getitem__, tokens))


OUTPUTS = {
    "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string",
}


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens and the wanted outputs of every whole text.

    `ids` are the tokens, `decoded` is the text they decode to; the digests are those of the decimal
    ids joined by one space, and of the decoded text.
    """
    tables = docs.sparkSession.sparkContext.broadcast(Codec(path).tables())

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def numbers(text: str) -> np.ndarray:
        return np.array(text.split(), dtype=np.int32)

    makers = {
        "ids": (1, numbers, pa.list_(pa.int32())),
        "decoded": (2, str, pa.string()),
        "ids_sha256": (1, digest, pa.string()),
        "decoded_sha256": (2, digest, pa.string()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tables.value)
        for batch in pieces(batches, BATCH_BYTES):
            texts = [codec.split_words(text or "") for text in batch.column("text").to_pylist()]
            codec.keep({word for text in texts for word in text})
            rows = []
            for text in texts:
                tokens = [codec.words[word] for word in text]
                rows.append((
                    sum([n for _, _, n in tokens]),
                    " ".join([ids for ids, _, _ in tokens]),
                    " ".join([names for _, names, _ in tokens]),
                ))
            columns = [batch.column("doc_id"), pa.array([row[0] for row in rows], pa.int64())]
            for name in outputs:
                place, make, kind = makers[name]
                columns.append(pa.array([make(row[place]) for row in rows], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *outputs])

    schema = "doc_id long, n_tokens long, " + ", ".join(f"{x} {OUTPUTS[x]}" for x in outputs)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)
