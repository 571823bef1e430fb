"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other, and in how many documents.

A byte-level BPE (A) encodes a space and the text, a sentencepiece model (B), which adds that space itself, the text. Each stretch of bytes without an end of a token inside is one link of an A and a B token; ends that both
have cut the text into groups. A text is encoded by segments that begin with a space after a character that is no white space: no token of either crosses such a place, so every new segment is encoded and
aligned once in a task and the rest is a table.

The index is inverted: for each pair of ids and block of documents, bitmaps of the documents that link it, as planes of the multiplicity's binary digits, each a sorted list of 16-bit places or, where that
is shorter, bits. The OR of a pair's planes is its documents, and its popcount, added up over blocks, the pair's count; planes weighted by their digit count its links. Counts go back to the blocks, where every posting adds its
pair's count to the score of its document. A block is BLOCK_BYTES of text of one task, so neither a hot pair nor a long corpus makes a group grow.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .shared import slices, written

#: Text of a block, and the documents that it has at most: places are 16 bits wide.
BLOCK_BYTES, BLOCK_DOCUMENTS = 8 << 20, 1 << 16
#: Segments kept in a task's table; a full one starts anew.
TABLE_SEGMENTS = 500_000
#: Fixed: the pattern by which such tokenizers split a text.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CROWDED = re.compile(r"\s ")
BEGIN = re.compile(r"(?<=\S) ")
#: Characters whose kind (letter, number, space) is the same in all versions of Unicode: for them any library that knows the ranks and the pattern will do.
STABLE = re.compile("[\0-\u024f]*").fullmatch


def ranks(path: str):
    """The tokenizer at `path` in the faster library for byte-level BPE by ranks, if ids are ranks and words are split as it expects; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: x for x, c in byte_characters().items()}
    vocabulary, special = spec["model"]["vocab"], {x["content"] for x in spec["added_tokens"]}
    own = {bytes(byte[c] for c in s): i for s, i in vocabulary.items() if s not in special}
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    pre = spec["pre_tokenizer"]
    if made != list(range(256, 256 + len(made))) or sorted(own.values()) != list(range(256 + len(made))) or pre["type"] != "ByteLevel" or pre.get("use_regex") is False or pre["add_prefix_space"] or spec["normalizer"]:
        return None
    return tiktoken.Encoding("ranks", pat_str=WORD, mergeable_ranks=own, special_tokens={})


def reordered(ids: np.ndarray, many: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of `many` ids each, one after another, in another order."""
    begin, size = (np.cumsum(many) - many)[order], many[order]
    return ids[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)], size


class Aligner:
    """Encodes segments with both tokenizers and keeps, by a segment's number, its links and groups."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.ranks = ranks(a)
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: x for x, c in byte_characters().items()}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.token_bytes = {i: s.encode() if s in special else bytes(byte[c] for c in s) for s, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece crosses the begin of a word: texts cannot be encoded by segments")
        self.space = self.b.piece_to_id("▁")
        self.piece_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.width = len(pieces)
        self.a_sizes = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, x in self.token_bytes.items():
            self.a_sizes[i] = len(x)
        self.b_sizes = np.array([len(x) for x in self.piece_bytes])
        told = lambda n, mark: np.array([f"{i}{mark}".encode() for i in range(n)], object)
        self.a_told, self.b_told = (told(len(self.a_sizes), ","), told(len(self.a_sizes), "|")), (told(self.width, ","), told(self.width, ";"))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.told: list[bytes] = []
        #: By number: where links begin in `links`, and how many links, A tokens, B tokens and groups there are; no A tokens: B's bytes are not the text's.
        self.begin, self.counts, self.links = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def a_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of segments (with their space), one after another, and how many each has. Segments that end in white space come last in their text only and are encoded alone, all others as one text, in which each begins a token."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        alone = [i for i, t in enumerate(texts) if t[-1].isspace()]
        if alone and len(texts) > 1:
            first = [t for t in texts if not t[-1].isspace()]
            parts = [self.a_ids(first), *(self.a_ids([texts[i]]) for i in alone)]
            place = np.concatenate([np.delete(np.arange(len(texts)), alone), np.array(alone)])
            return reordered(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.argsort(place))
        whole = "".join(texts)
        ids = self.ranks.encode_ordinary(whole) if self.ranks and STABLE(whole) else self.a.encode(whole, add_special_tokens=False).ids
        ids = np.array(ids, np.int64)
        ends = np.cumsum([len(t.encode()) for t in texts])
        return ids, np.diff(np.searchsorted(np.cumsum(self.a_sizes[ids]), ends, "right"), prepend=0)

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        new.sort(key=lambda s: STABLE(s) is None)
        later = next((i for i, s in enumerate(new) if not STABLE(s)), len(new))
        texts = [" " + s for s in new]
        a, n_a = (np.concatenate(x) for x in zip(self.a_ids(texts[:later]), self.a_ids(texts[later:]), strict=True))
        lists = [x or [self.space] for x in self.b.encode(new, num_threads=1)]
        good = np.array([b"".join([self.piece_bytes[i] for i in x]) == t.encode() for x, t in zip(lists, texts, strict=True)])
        n_b = np.array([len(x) for x in lists])
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.union1d(a_ends, b_ends)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        segment_ends = np.concatenate([[0], a_ends])[np.cumsum(n_a)]
        links = a[np.searchsorted(a_ends, ends)] * self.width + b[np.searchsorted(b_ends, ends)]
        upto = lambda x: np.diff(np.searchsorted(x, segment_ends, "right"), prepend=0)
        n_links, n_groups = upto(ends), upto(common)

        told = np.concatenate([np.where(np.isin(a_ends, common), self.a_told[1][a], self.a_told[0][a]), np.where(np.isin(b_ends, common), self.b_told[1][b], self.b_told[0][b])])
        group = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        told = told[np.argsort(group, kind="stable")].tolist()
        cut = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.told += [b"".join(told[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.links) + np.cumsum(n_links) - n_links])
        self.counts = np.concatenate([self.counts, np.stack([n_links, n_a, n_b, n_groups], 1)])
        self.links = np.concatenate([self.links, links])

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Links of all texts one after another (A's id times B's size plus B's id), the counts of each text (links, A tokens, B tokens, groups) and the digests of their groups."""
        parts = [segments(t) if t else [] for t in texts]
        if len(self.number) > TABLE_SEGMENTS:
            self.forget()
        self.learn(list(set().union(*parts).difference(self.number)))
        sizes = np.array([len(p) for p in parts])
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(self.counts[number, 1] == 0)])
        good = (np.diff(bad[cut]) == 0) & (sizes > 0)
        names = [[self.told[i] for i in number[x:y].tolist()] if g else None for x, y, g in zip(cut[:-1].tolist(), cut[1:].tolist(), good.tolist(), strict=True)]
        digests = [hashlib.sha256(b"".join(n)[:-1]).hexdigest() if n else "" for n in names]
        number = number[np.repeat(good, sizes)]
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[number], 0)])
        counts = np.diff(totals[np.concatenate([[0], np.cumsum(sizes * good)])], axis=0)
        many = self.counts[number, 0]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.begin[number], many)
        return self.links[place], counts, digests


def segments(text: str) -> list[str]:
    """The segments of a space and the text, without the space that each begins with."""
    if text[0] == " " or CROWDED.search(text):
        whole = " " + text
        cuts = [0, *(m.start() for m in BEGIN.finditer(whole)), len(whole)]
        return [whole[x + 1 : y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return text.split(" ")


@lru_cache(1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def bits_size(documents: int) -> int:
    return 2 * -(-documents // 16)


def planes(code: np.ndarray, place: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """From links (pair, place of the document) the pairs, ascending, the documents and links of each, and its planes."""
    key = np.sort(code << 16 | place)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    many = np.diff(np.append(first, len(key)))
    key = key[first]
    head = np.flatnonzero(np.append(True, (key[1:] >> 16) != (key[:-1] >> 16))[: len(key)])
    pairs, n = key[head] >> 16, np.diff(np.append(head, len(key)))
    of, at = np.repeat(np.arange(len(head)), n), (key & 0xFFFF).astype(np.uint16)
    top = np.maximum.reduceat(many, head) if len(head) else many
    depth = np.frexp(top.astype(float))[1].astype(np.int64)  # binary digits
    slot = np.concatenate([[0], np.cumsum(depth)])
    entry_slot, entry = [], []
    for k in range(int(depth.max()) if len(depth) else 0):
        there = np.flatnonzero(many >> k & 1)
        entry_slot.append(slot[of[there]] + k)
        entry.append(at[there])
    if not entry:
        return pairs, n, n, pa.array([], pa.list_(pa.binary()))
    entry_slot, entry = np.concatenate(entry_slot), np.concatenate(entry)
    order = np.argsort(entry_slot, kind="stable")
    entry_slot, entry = entry_slot[order], entry[order]
    size = np.bincount(entry_slot, minlength=slot[-1])
    dense = np.flatnonzero(2 * size >= bits_size(documents))
    begin = np.concatenate([[0], np.cumsum(size)])
    words = size.copy()
    words[dense] = bits_size(documents) // 2
    offsets = np.concatenate([[0], np.cumsum(words)])
    data = np.zeros(offsets[-1], np.uint16)
    sparse = np.ones(len(size), bool)
    sparse[dense] = False
    own = sparse[entry_slot]
    data[(np.arange(len(entry)) - np.repeat(begin[:-1] - offsets[:-1], size))[own]] = entry[own]
    for s in dense.tolist():
        bit = np.zeros(8 * bits_size(documents), bool)
        bit[entry[begin[s] : begin[s + 1]]] = True
        data[offsets[s] : offsets[s + 1]] = np.packbits(bit).view(np.uint16)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(data)])
    return pairs, n, np.add.reduceat(many, head), pa.ListArray.from_arrays(pa.array(slot.astype(np.int32)), blobs)


def postings(column: pa.ListArray, documents: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All postings of a column of planes: row, place and weight, lists first, then bits, plane by plane."""
    slot = column.offsets.to_numpy() - column.offsets[0].as_py()
    blobs = column.flatten()
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    row = np.repeat(np.arange(len(column)), np.diff(slot))
    weight = np.int64(1) << (np.arange(len(blobs)) - slot[:-1][row])
    size = np.diff(offsets)
    sparse = size < bits_size(documents)
    raw = blobs.buffers()[2]
    data = np.frombuffer(raw, np.uint16, offsets[-1] // 2) if raw else np.zeros(0, np.uint16)
    many = np.where(sparse, size // 2, 0)
    place = data[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - offsets[:-1] // 2, many)]
    yield np.repeat(row, many), place.astype(np.int64), np.repeat(weight, many)
    for s in np.flatnonzero(~sparse).tolist():
        at = np.flatnonzero(np.unpackbits(data[offsets[s] // 2 : offsets[s + 1] // 2].view(np.uint8)))
        yield np.full(len(at), row[s]), at, np.full(len(at), weight[s])


COUNTS = ("n_links", "n_a", "n_b", "n_groups")
INDEX = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("documents", pa.int64()), ("planes", pa.list_(pa.binary()))])
INDEX_DDL = "block long, place int, doc_id long, n_links long, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, documents long, planes array<binary>"


class Alignment(NamedTuple):
    """index: a row for each document (place >= 0) and for each pair of a block (place null); pairs: a, b, documents and links of all pairs; width: B's vocabulary size."""

    index: DataFrame
    pairs: DataFrame
    width: int


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in INDEX], schema=INDEX)


def align(docs: DataFrame, a: str, b: str) -> Alignment:
    """docs(doc_id, text, ...) to the inverted index of linked pairs, with the tokenizer files at `a` and `b`, which every executor has.

    One row of index for each row given, repeated ones too (each is a document of its own); doc_id may be null. A null or empty text, or one that B's pieces do not give back byte by byte, has no tokens: counts of 0 and an empty digest.
    Other columns are not read. No rows give an empty index.
    """

    def run(batches):
        from pyspark import TaskContext

        t, task, done = aligner(a, b), TaskContext.get().partitionId(), 0
        codes, places, used, n = [], [], 0, 0

        def close():
            pairs, documents, links, bitmaps = planes(np.concatenate(codes), np.concatenate(places), n)
            for x in range(0, len(pairs), 10_000):
                y = min(len(pairs), x + 10_000)
                yield _filled({"block": pa.array(np.full(y - x, task << 32 | done)), "pair": pa.array(pairs[x:y]), "documents": pa.array(documents[x:y]), "n_links": pa.array(links[x:y]), "planes": bitmaps[x:y]}, y - x)

        for batch in slices(batches):
            for x in range(0, batch.num_rows, BLOCK_DOCUMENTS):
                part = batch.slice(x, BLOCK_DOCUMENTS)
                texts = [s or "" for s in part.column("text").to_pylist()]
                size = sum(map(len, texts))
                if n and (used + size > BLOCK_BYTES or n + len(texts) > BLOCK_DOCUMENTS):
                    yield from close()
                    codes, places, used, n, done = [], [], 0, 0, done + 1
                links, counts, digests = t.align(texts)
                codes.append(links)
                places.append(np.repeat(np.arange(n, n + len(texts)), counts[:, 0]))
                row = {c: pa.array(np.ascontiguousarray(counts[:, k])) for k, c in enumerate(COUNTS)}
                yield _filled(row | {"block": pa.array(np.full(len(texts), task << 32 | done)), "place": pa.array(np.arange(n, n + len(texts), dtype=np.int32)), "doc_id": part.column("doc_id"), "groups_sha256": pa.array(digests, pa.string())}, len(texts))
                used, n = used + size, n + len(texts)
        if n:
            yield from close()

    width = aligner(a, b).width
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = written(own.mapInArrow(run, INDEX_DDL), "alignment")
    pairs = index.filter("place IS NULL").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("n_links").alias("links"))
    return Alignment(index, pairs.select(F.floor(F.col("pair") / width).cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "documents", "links"), width)


def scores(alignment: Alignment) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and, of each document's links, n_best (those whose pair is in the most documents of all with its A id) and count_sum (the documents of the links' pairs, added up)."""
    index = alignment.index
    pairs = alignment.pairs.select("a", (F.col("a").cast("long") * alignment.width + F.col("b")).alias("pair"), F.col("documents").alias("count"))
    top = pairs.groupBy("a").agg(F.max("count").alias("top"))
    rated = pairs.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    back = index.filter("place IS NULL").select("block", "pair").join(rated, "pair").select("block", "pair", "count", "best")
    both = index.unionByName(back, allowMissingColumns=True)

    def each(table: pa.Table) -> pa.Table:
        place, planes_at = table.column("place").combine_chunks(), table.column("planes").combine_chunks()
        docs = table.filter(place.is_valid())
        n = len(docs)
        order = np.argsort(docs.column("place").to_numpy())
        rows = table.filter(planes_at.is_valid())
        rated = table.filter(table.column("count").combine_chunks().is_valid())
        by = np.argsort(rated.column("pair").to_numpy())
        at = by[np.searchsorted(rated.column("pair").to_numpy()[by], rows.column("pair").to_numpy())]
        count, best = rated.column("count").to_numpy()[at], rated.column("best").to_numpy(zero_copy_only=False)[at]
        count_sum, n_best = np.zeros(n), np.zeros(n)
        if len(rows):
            for row, where, weight in postings(rows.column("planes").combine_chunks(), n):
                count_sum += np.bincount(where, weight * count[row], n)
                n_best += np.bincount(where, weight * best[row], n)
        got = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).take(pa.array(order))
        return got.append_column("n_best", pa.array(n_best.astype(np.int64))).append_column("count_sum", pa.array(count_sum.astype(np.int64)))

    return both.groupBy("block").applyInArrow(each, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
