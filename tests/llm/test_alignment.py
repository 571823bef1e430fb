"""Aligned tokenizers against both libraries on whole texts and a search over all pairs of tokens."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import alignment
from cairn.llm.queries import QUERIES, vocabulary

DOC = "doc_id long, text string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PARTS = ["the ", "a", " ", "  ", "\n", "\n ", "\t", "é", "ß", "<s>", "</s>", "<unk>", "<|endoftext|>", "▁", "　", "\xa0", "日本", "🙂", "0", "12", "'s", "don't", "http://x.y", "_", "...", "<0x0A>", "A", "Zebra", "\r", "\x00", "\x1c", "ﬁ", "​", " x", ".", "\U00011de0"]


def texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@lru_cache(1)
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))


def plain(text):
    """Links as a Counter of (a, b), A's and B's ids, and groups."""
    a, b = libraries()
    t = alignment.aligner(vocabulary(A), vocabulary(B))
    if not text:
        return Counter(), [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xb = [t.token_bytes[i] for i in x]
    yb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
    if not b"".join(xb) == b"".join(yb) == (" " + text).encode():
        return Counter(), [], [], []
    xe, ye = np.cumsum([len(v) for v in xb]), np.cumsum([len(v) for v in yb])
    xs, ys = xe - [len(v) for v in xb], ye - [len(v) for v in yb]
    links = Counter((x[i], y[j]) for i in range(len(x)) for j in np.flatnonzero((ys < xe[i]) & (ye > xs[i])).tolist())
    groups, i, j = [], 0, 0
    for e in sorted(set(xe.tolist()) & set(ye.tolist())):
        k, m = int(np.searchsorted(xe, e)) + 1, int(np.searchsorted(ye, e)) + 1
        groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
        i, j = k, m
    return links, x, y, groups


def wanted(rows):
    found = [plain(t) for _, t in rows]
    count = Counter(p for links, *_ in found for p in links)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc_id, _), (links, x, y, groups) in zip(rows, found, strict=True):
        best = sum(n for p, n in links.items() if count[p] == top[p[0]])
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((doc_id, len(x), len(y), len(groups), links.total(), best, sum(n * count[p] for p, n in links.items()), sha))
    return out, count, found


@pytest.mark.parametrize("block", [None, 500])
def test_query_equals_plain(spark, tmp_path, monkeypatch, block):
    if block:
        monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
        monkeypatch.setattr(alignment, "BLOCK_DOCUMENTS", 40)
        monkeypatch.setattr(alignment, "TABLE_SEGMENTS", 50)
    given = [None, "", " ", "  ", "a ", "x" * 3000, "word " * 2000, "a\n" * 500, "ab " * 70_000, *texts(400)] + ["same text here"] * 60
    rows = [(i, t) for i, t in enumerate(given)] + [(3, given[20]), (3, given[21]), (None, given[22]), (None, None)]
    spark.createDataFrame(rows, DOC).repartition(3).withColumn("block", F.lit("other")).withColumn("pair", F.lit(1)).withColumn("n_links", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_alignment"](spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted(rows)[0], key=str)


def test_pairs_of_the_corpus(spark):
    rows = list(enumerate(texts(200, 9)))
    got = alignment.align(spark.createDataFrame(rows, DOC), vocabulary(A), vocabulary(B)).pairs
    _, count, found = wanted(rows)
    links = Counter()
    for x, *_ in found:
        links.update(x)
    assert {(r["a"], r["b"]): (r["documents"], r["links"]) for r in got.collect()} == {p: (n, links[p]) for p, n in count.items()}


@pytest.mark.parametrize("documents", [1, 16, 17, 1000, 65536])
def test_planes_give_back_every_posting(documents):
    rng = np.random.default_rng(documents)
    code = np.concatenate([rng.integers(0, 50, 5000), np.full(4000, 7), [3, 3, 3, 3]])
    place = np.concatenate([rng.integers(0, documents, 9000), np.zeros(4, np.int64)])
    pairs, n, links, column = alignment.planes(code, place, documents)
    want = Counter(zip(code.tolist(), place.tolist(), strict=True))
    for part, base in ((column, 0), (column[3:20], 3)):
        got = Counter()
        for row, at, weight in alignment.postings(part, documents):
            for r, p, w in zip(row.tolist(), at.tolist(), weight.tolist(), strict=True):
                got[int(pairs[base + r]), p] += w
        assert got == Counter({k: v for k, v in want.items() if k[0] in set(pairs[base : base + len(part)].tolist())})
    assert n.tolist() == [sum(k[0] == p for k in want) for p in pairs.tolist()] and links.sum() == len(code)
    assert len(alignment.planes(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)[0]) == 0


def test_texts_equal_the_libraries_whatever_the_table(monkeypatch):
    t = alignment.Aligner(vocabulary(A), vocabulary(B))
    for part in range(0, 3000, 300):
        given = texts(300, 100 + part)
        links, counts, digests = t.align(given)
        cut = np.concatenate([[0], np.cumsum(counts[:, 0])])
        for k, x in enumerate(given):
            want, a, b, groups = plain(x)
            assert Counter(divmod(c, t.width) for c in links[cut[k] : cut[k + 1]].tolist()) == want
            assert counts[k].tolist() == [want.total(), len(a), len(b), len(groups)]
            assert digests[k] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")


def test_without_ranks_the_library_encodes(monkeypatch):
    monkeypatch.setattr(alignment, "ranks", lambda path: None)
    given = texts(300, 77)
    slow = alignment.Aligner(vocabulary(A), vocabulary(B)).align(given)
    monkeypatch.undo()
    fast = alignment.Aligner(vocabulary(A), vocabulary(B)).align(given)
    assert slow[0].tolist() == fast[0].tolist() and slow[2] == fast[2]


def test_no_rows(spark):
    found = alignment.align(spark.createDataFrame([], DOC), vocabulary(A), vocabulary(B))
    assert alignment.scores(found).collect() == [] and found.pairs.collect() == []
    assert pa.array([], pa.list_(pa.binary())).type == alignment.planes(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)[3].type
