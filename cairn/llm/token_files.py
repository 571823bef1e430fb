"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Every part, a range of doc_ids, is four files in the shared folder: NAME.bin (ids, of the smallest of uint16 and uint32 that holds the vocabulary), NAME.idx (int64: where each
document begins in the part, and the end), NAME.doc (int64 doc_ids) and NAME.nul (a byte for each that says whether it is null). Ids stream to their file as they are made. A part's base, the ids
of all parts before it, is a prefix sum over the parts' totals. Files get their name only when they are whole, so that a task that runs again or twice does no harm.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, slices, written

TABLE_WORDS = 1_000_000
#: Documents of a part, about, and documents that are read at a time.
PART_DOCUMENTS, READ_DOCUMENTS = 1 << 18, 4096
#: Marks that stand apart from a letter before them.
TAIL = ".,!?#%*&$"
#: Words of letters that stay one letter each in lower case: the library takes each of them as one word.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class WordTable:
    """Encodes as the tokenizers library does for this vocabulary: the library encodes every new word once, and a table of words gives the rest.

    Right for tokenizers that split at a space and at a newline and drop them, and that split final marks (TAIL) from a letter; new words are encoded as one text and told apart by
    their number, if they are plain, or their offsets.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.table: dict[str, int] = {}
        self.begin, self.many, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def learn(self, words: list[str], ids: np.ndarray, many: np.ndarray) -> None:
        self.table.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])

    def by_library(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.table]
        if not new:
            return
        plain = [w for w in new if PLAIN(w)]
        got = self.library.encode(" ".join(plain), add_special_tokens=False)
        self.learn(plain, np.array(got.ids, np.int64), np.bincount(np.array(got.word_ids, np.int64), minlength=len(plain)))
        other = [w for w in new if w not in self.table]
        starts = np.cumsum([0, *(len(w) + 1 for w in other)])[:-1]
        got = self.library.encode(" ".join(other), add_special_tokens=False)
        first = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
        self.learn(other, np.array(got.ids, np.int64), np.bincount(np.searchsorted(starts, first, "right") - 1, minlength=len(other)))

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.many[number]
        before = np.cumsum(many) - many
        return self.flat[np.arange(many.sum()) - np.repeat(before - self.begin[number], many)], many

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.table) > TABLE_WORDS:
            self.forget()
        new = set().union(*split).difference(self.table)
        two, heads, tails = [], [], []
        for w in new:
            head = w.rstrip(TAIL)
            if len(head) < len(w) and head and head[-1].isascii() and head[-1].isalpha():
                two.append(w)
                heads.append(head)
                tails.append(w[len(head) :])
        self.by_library(new.difference(two).union(heads, tails))
        if two:
            number = np.fromiter((self.table[x] for pair in zip(heads, tails, strict=True) for x in pair), np.int64, 2 * len(two))
            ids, many = self.gather(number)
            self.learn(two, ids, many[::2] + many[1::2])
        counts = [len(s) for s in split]
        number = np.fromiter(map(self.table.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        ids, many = self.gather(number)
        totals = np.concatenate([[0], np.cumsum(many)])
        return ids, np.diff(totals[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(2)
def word_table(path: str) -> WordTable:
    return WordTable(path)


class _File:
    """A file that is written in pieces and gets its name when it is closed."""

    def __init__(self, folder: str, name: str):
        self.where, path = fs.FileSystem.from_uri(folder)
        self.where.create_dir(path, recursive=True)
        self.path, self.temporary = f"{path}/{name}", f"{path}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.where.open_output_stream(self.temporary)

    def close(self) -> None:
        self.stream.close()
        self.where.move(self.temporary, self.path)


def _put(folder: str, name: str, data: bytes) -> None:
    file = _File(folder, name)
    file.stream.write(data)
    file.close()


def _reader(folder: str, name: str, dtype):
    """What gives the numbers from a to b of a file: memory-mapped where the folder is mounted, else read by ranges."""
    where, path = fs.FileSystem.from_uri(folder)
    path, size = f"{path}/{name}", np.dtype(dtype).itemsize
    if where.get_file_info(path).size == 0:
        return lambda a, b: np.zeros(0, dtype)
    if isinstance(where, fs.LocalFileSystem):
        mapped = np.memmap(path, dtype, "r")
        return lambda a, b: mapped[a:b]
    file = where.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * size, a * size), dtype)


class Parts:
    """The part of each row: doc_ids between two cuts share one; a doc_id of which several cuts came out is hot and has as many parts more, dealt by a hash of the ids; so are nulls, which come first."""

    def __init__(self, cuts: list[float], nulls: int):
        self.nulls = nulls
        self.cuts, many = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.more = np.append(np.where(many > 1, many, 0), 0)
        self.base = nulls + np.concatenate([[0], np.cumsum(1 + self.more)[:-1]])

    def of(self, doc_id: pa.Array, ids: list[bytes]) -> np.ndarray:
        null = doc_id.is_null().to_numpy(zero_copy_only=False)
        value = doc_id.fill_null(0).to_numpy()
        at = np.searchsorted(self.cuts, value)
        hot = (self.more[at] > 0) & (value == np.append(self.cuts, 0)[at])
        out = self.base[at]
        for i in np.flatnonzero(null | hot).tolist():
            mark = zlib.crc32(ids[i])
            out[i] = mark % self.nulls if null[i] else out[i] + 1 + mark % self.more[at[i]]
        return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, parts: int | None = None) -> list[tuple[str, str, int, int, str]]:
    """Writes the ids of all documents in ascending doc_id order (nulls first; rows of one doc_id by a hash of their ids) and returns the parts in order: (folder, name, base, documents, dtype).

    A null or empty text has no ids of its own. The list has an entry for each file, not for each document. There are about `parts` parts, by default one for each PART_DOCUMENTS documents
    and at least one for each shuffle partition. An empty table has no parts.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, known = own.agg(F.count("*"), F.count("doc_id")).first()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents // PART_DOCUMENTS))
    cuts = own.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if known else []
    dealt = Parts(cuts, -(-(documents - known) * parts // max(1, documents)))
    dtype = np.dtype(word_table(tokenizer).dtype).str
    row = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    schema = pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def encode(batches):
        table = word_table(tokenizer)
        end = np.array([] if end_id is None else [end_id], table.dtype)
        for batch in slices(batches):
            flat, sizes = table.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            ids = [np.append(flat[a:b], end).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(dealt.of(batch.column("doc_id"), ids), pa.int32()), batch.column("doc_id"), pa.array(ids, pa.binary())], schema=row)

    def write(batches):
        size, now = np.dtype(dtype).itemsize, None
        file, sizes, ids, nulls = None, [], [], []

        def close() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
            _put(folder, f"part-{now:06d}.idx", at.tobytes())
            _put(folder, f"part-{now:06d}.doc", np.concatenate(ids).astype("<i8").tobytes())
            _put(folder, f"part-{now:06d}.nul", np.concatenate(nulls).astype("u1").tobytes())
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(at) - 1], pa.int64()), pa.array([at[-1]], pa.int64())], schema=schema)

        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    if file:
                        yield close()
                    now, sizes, ids, nulls = int(part[a]), [], [], []
                    file = _File(folder, f"part-{now:06d}.bin")
                doc, flat = batch.column("doc_id").slice(a, b - a), batch.column("ids").slice(a, b - a)
                file.stream.write(b"".join(flat.to_pylist()))
                sizes.append(pc.binary_length(flat).to_numpy() // size)
                ids.append(doc.fill_null(0).to_numpy())
                nulls.append(doc.is_null().to_numpy(zero_copy_only=False))
        if file:
            yield close()

    rows = own.mapInArrow(encode, "part int, doc_id long, ids binary").repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    totals = written(rows.mapInArrow(write, "part int, documents long, tokens long"), "parts").orderBy("part").collect()
    bases = [0, *accumulate(r["tokens"] for r in totals)]
    return [(folder, f"part-{r['part']:06d}", base, r["documents"], dtype) for r, base in zip(totals, bases, strict=False)]


def read_token_files(spark: SparkSession, parts: list[tuple[str, str, int, int, str]]) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers). No part is in memory as a whole."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], ddl)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    table = spark.createDataFrame(parts, "folder string, name string, base long, documents long, dtype string").repartition(len(parts))

    def read(batches):
        for batch in batches:
            for p in batch.to_pylist():
                offsets, doc, null, ids = (_reader(p["folder"], p["name"] + end, t) for end, t in ((".idx", "<i8"), (".doc", "<i8"), (".nul", "u1"), (".bin", p["dtype"])))
                for a in range(0, p["documents"], READ_DOCUMENTS):
                    b = min(p["documents"], a + READ_DOCUMENTS)
                    at = offsets(a, b + 1)
                    crc = [zlib.crc32(ids(x, y).astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(doc(a, b)), pa.int64(), mask=null(a, b).astype(bool)), pa.array(p["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=schema)

    return table.mapInArrow(read, ddl)
