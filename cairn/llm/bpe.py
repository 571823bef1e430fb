"""Byte-level BPE, encoding by speculation: the greedy longest match proposes a word's tokens, a table check tests every adjacent pair of all words at once, and only words with a failing pair are merged exactly.

The check rests on a property of merge lists in which each token has one merge: a sequence is the encoding of its text if and only if each pair of neighbours is the encoding of its own text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Fixed: the pattern that byte-level pre-tokenizers split a text by; white space is Unicode's.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The same for a text of ASCII characters only.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r\x20A-Za-z0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+")
#: Letters and numbers that Unicode took in after the version that the tokenizers library knows; there they are neither.
LATER = regex.compile("[\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6]")
#: Words kept in a task's table; when it is full, it starts anew.
TABLE_WORDS = 800_000


def split(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORD.findall(text)
    if LATER.search(text):
        return [text[m.start() : m.end()] for m in WORD.finditer(LATER.sub("\u0378", text))]
    return WORD.findall(text)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 stands for itself, the others follow from 256 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBPE:
    """encode and decode as the vocabulary file's own tokenizer does, without special tokens added, truncation or padding."""

    def __init__(self, path: str, most_words: int = TABLE_WORDS):
        self.most_words = most_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in byte_characters().items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = {(s if s in self.special else bytes(of[c] for c in s)): i for s, i in spec["model"]["vocab"].items()}
        self.ids = {k: v for k, v in raw.items() if isinstance(k, bytes)}
        self.bytes = {i: k for k, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        part = lambda s: self.ids[bytes(of[c] for c in s)]
        self.size = max(self.bytes) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        made = np.full(self.size, -1)  # rank of the merge that makes a token; -1: a single byte
        for r, (a, b) in enumerate(merges):
            x, y = part(a), part(b)
            t = self.ids[self.bytes[x] + self.bytes[y]]
            self.rank[x, y] = (r, t)
            if made[t] < 0:
                made[t], self.left[t], self.right[t] = r, x, y
        self.made = made
        self.made_by = np.array([t for _, t in self.rank.values()], np.int64)  # by rank
        key = np.array([x * self.size + y for x, y in self.rank], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        #: Whether merging a token's own text leads to it.
        self.whole = made < 0
        joined = np.flatnonzero(made >= 0)
        joined = joined[np.argsort(made[joined])]
        kept = self.compatible(self.left[joined], self.right[joined], made[joined])
        for t, ok in zip(joined.tolist(), kept.tolist(), strict=True):
            self.whole[t] = ok and self.whole[self.left[t]] and self.whole[self.right[t]]
        cut = [regex.escape(s) for s in sorted(self.special, key=len, reverse=True)]
        self.cut = regex.compile("|".join(cut)) if cut else None
        self.reach: dict[bytes, int] = {}  # the longest token that begins with these three bytes
        for t in self.ids:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.forget()

    def forget(self) -> None:
        """Starts the table of words anew: a word's number, and by number where its ids begin in `flat` and how many they are."""
        self.table: dict[str, int] = {}
        self.begin, self.many, self.flat = (np.zeros(0, np.int32) for _ in range(3))

    def greedy(self, word: bytes) -> list[int]:
        out, at = [], 0
        while at < len(word):
            for end in range(min(len(word), at + max(2, self.reach.get(word[at : at + 3], 0))), at, -1):
                if (t := self.ids.get(word[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; as many as there are merges if there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours, whether merging their joined text keeps them apart (with limit: up to that rank).

        The pair is undone from its last merge backwards. The two pieces that face each other may not have a merge that comes before the one that takes one of them
        away; of equal ranks the left pair merges first.
        """
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), len(self.keys)) if limit is None else limit.copy()
        while len(live):
            x, y = a[live], b[live]
            bad = self.pair_rank(x, y) < limit[live]
            good[live[bad]] = False
            left, right = self.made[x], self.made[y]
            on = ~bad & ((left >= 0) | (right >= 0))
            live, x, y, left, right = live[on], x[on], y[on], left[on], right[on]
            later = left > right
            limit[live] = np.where(later, left, right + 1)
            a[live], b[live] = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return good

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The exact encodings: in each round, every word that has a merge left does its merge of lowest rank, the leftmost of equal ones."""
        byte = np.array([self.ids[bytes([c])] for c in range(256)])
        token = byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)

        def ranks(at: np.ndarray) -> np.ndarray:
            at = at[at + 1 < len(token)]
            return np.where(word[at] == word[at + 1], self.pair_rank(token[at], token[at + 1]), none)

        rank = np.append(ranks(np.arange(len(token))), none)[: len(token)]
        while len(token):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(token)))
            idle = np.repeat(least == none, sizes)
            if idle.any():
                done.append((word[idle], token[idle]))
                token, word, rank = token[~idle], word[~idle], rank[~idle]
                sizes, least = sizes[least < none], least[least < none]
                if not len(token):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            hits = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]
            token[hits] = self.made_by[rank[hits]]
            keep = np.ones(len(token), bool)
            keep[hits + 1] = False
            token, word, rank = token[keep], word[keep], rank[keep]
            hits -= np.arange(len(hits))
            rank[hits] = none
            at = np.unique(np.concatenate([hits, hits[hits > 0] - 1]))
            at = at[at + 1 < len(token)]
            rank[at] = ranks(at)
        all_words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        all_tokens = np.concatenate([t for _, t in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(all_words, kind="stable")
        cut = np.searchsorted(all_words[order], np.arange(1, len(words)))
        return [x.tolist() for x in np.split(all_tokens[order], cut)] if words else []

    def learn(self, words: set[str]) -> None:
        """Puts the words' encodings in the table: all proposed, all pairs tested in one call, the failing words merged."""
        new = [w for w in words if w not in self.table]
        if not new:
            return
        raw = [w.encode() for w in new]
        proposed = [self.greedy(b) for b in raw]
        sizes = np.array([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        pairs = np.flatnonzero(word[1:] == word[:-1])
        fails = np.union1d(word[pairs[~self.compatible(flat[pairs], flat[pairs + 1])]], word[~self.whole[flat]]).tolist()
        for k, ids in zip(fails, self.merged([raw[k] for k in fails]), strict=True):
            proposed[k] = ids
        many = np.array([len(p) for p in proposed], np.int32)
        self.table.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.flat = np.concatenate([self.flat, np.fromiter((t for p in proposed for t in p), np.int32, int(many.sum()))])

    def pieces(self, text: str) -> list[str]:
        """The text's words in order; special tokens are words of their own."""
        if self.cut is None or not self.cut.search(text):
            return split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*split(text[at : m.start()]), "\0" + m[0]]
            at = m.end()
        return out + split(text[at:])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        words = [self.pieces(t) for t in texts]
        if len(self.table) > self.most_words:
            self.forget()
        if not self.table:
            ids = list(self.special.items())
            self.table = {"\0" + s: k for k, (s, _) in enumerate(ids)}
            self.begin, self.many, self.flat = np.arange(len(ids), dtype=np.int32), np.ones(len(ids), np.int32), np.array([i for _, i in ids], np.int32)
        self.learn(set().union(*words))
        counts = [len(w) for w in words]
        number = np.fromiter(map(self.table.__getitem__, chain.from_iterable(words)), np.int64, sum(counts))
        many = self.many[number].astype(np.int64)
        before = np.cumsum(many) - many
        place = np.arange(many.sum()) - np.repeat(before - self.begin[number], many)
        totals = np.concatenate([[0], np.cumsum(many)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[place], np.diff(totals[edges])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str, most_words: int = TABLE_WORDS) -> ByteBPE:
    return ByteBPE(path, most_words)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, ids (array of int) and decoded (the text decoded from them), with the vocabulary file at `path`, which every executor has.

    One row for each row given, repeated ones too; a null or empty text has no ids and decodes to an empty text. Other columns are not read. No rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        t = tokenizer(path)
        for batch in slices(batches):
            flat, sizes = t.encode_batch([x or "" for x in batch.column("text").to_pylist()])
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            decoded = [t.decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(decoded, pa.string())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
