"""Runs of words against a plain search over all periods, and the query's digests against the rule of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import runs
from cairn.llm.queries import QUERIES, planted

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, least=6, times=4):
    """All runs (start, length, period), by trying every period."""
    found = set()
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= times * p and j > i:
                found.add((i, j + p - i, p))
            i = max(j, i + 1)
    smaller = lambda a, n, p: any(b <= a and b + m >= a + n and q < p and p % q == 0 for b, m, q in found)
    return sorted((a, n, p) for a, n, p in found if n >= max(least, times * p) and not smaller(a, n, p))


def repetitive(rng, letters, size):
    words = [rng.randrange(letters) for _ in range(size)]
    for _ in range(rng.randint(0, 3)):
        p = rng.randint(1, 20)
        block = [rng.randrange(letters) for _ in range(p)]
        at = rng.randint(0, len(words))
        words[at:at] = [block[i % p] for i in range(rng.randint(1, 6 * p))]
    return words


@pytest.mark.parametrize("times", [4, 5, 8])
def test_catchers_equal_all_periods(times):
    rng = random.Random(times)
    for _ in range(150):
        texts = [repetitive(rng, rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 3, 8, 20, 60, 150])) for _ in range(rng.randint(1, 6))]
        sizes = np.array([len(t) for t in texts])
        start, length, period = runs.catch(np.array([x for t in texts for x in t], np.int64), sizes, times)
        first = (np.cumsum(sizes) - sizes).tolist()
        want = sorted(((a + f, n, p) for t, f in zip(texts, first, strict=True) for a, n, p in plain(t, 0, times)), key=lambda r: (r[0], r[2]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError, match="four periods"):
        runs.catch(np.zeros(4, np.int64), np.array([4]), 3)


def test_names_that_are_equal_by_chance_are_told_apart(monkeypatch):
    monkeypatch.setattr(runs, "mix", lambda x: x % np.uint64(2))
    rng = random.Random(5)
    for _ in range(60):
        t = repetitive(rng, 3, 60)
        start, length, period = runs.catch(np.array(t, np.int64), np.array([len(t)]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == plain(t, 0)


def test_long_texts_take_little_time():
    for words in (np.zeros(400_000, np.int64), np.arange(400_000) % 7, np.repeat(np.arange(4), 100_000)):
        start, length, period = runs.catch(words, np.array([len(words)]))
        assert length.sum() == len(words)


def want(doc_id, text):
    words = WORD.findall(text or "")
    order = planted(doc_id, len(words)) if words else None
    words = words if order is None else [words[i] for i in order]
    found = plain(words)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_rule(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "x " * 3000, "a b " * 50 + "a", "ab abab ab" * 30, "\x0ba\x0ca\x1ca a\xa0a a　a", *(rng.choice([" ", "\n", " \t "]).join(f"w{x}é" for x in repetitive(rng, rng.choice([2, 3, 40]), rng.randint(0, 200))) for _ in range(150))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 9), (None, None), (7, texts[7]), (7, texts[5])]
    spark.createDataFrame(rows, DOC).withColumn("runs", F.lit("other")).withColumn("collapsed", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op11_runs"](spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    assert got == sorted((want(d, t) for d, t in rows), key=str)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows)


def test_no_rows(spark):
    assert runs.find_runs(spark.createDataFrame([], DOC)).collect() == []
