"""Block matrix join: wide vectors, several query blocks and tiles, ties across tiles, proven bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import ann


def brute(v, queries, k):
    x = v.astype(np.float64)
    norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    out = {}
    for q in queries:
        s = np.clip(np.cumsum(x * x[q], axis=1)[:, -1] / (norm * norm[q]), -1, 1)
        out[q] = sorted((j for j in range(len(x)) if j != q), key=lambda j: (-s[j], j))[:k]
    return out


def found(df, k):
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


@pytest.mark.parametrize("width", [3, 64, 1536, 4096])
def test_nearest_at_any_width_over_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(width)
    v = rng.normal(size=(250, width)).astype(np.float32)
    v[100:220:4] = v[3]  # many equal vectors over several blocks: ties go to the smaller id
    v[221:230] = v[5] * np.float32(2)
    v[230:240] = v[6] + rng.normal(size=(10, width)).astype(np.float32) * np.float32(1e-4)  # closer than the quantisation
    data = [(i, x.tolist(), "clash", 1) for i, x in enumerate(v)] + [(3, v[3].tolist(), "clash", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, q string, width int").repartition(5)
    assert found(df, 5) == brute(v, range(0, 250, 10), 5)


def test_products_are_exact_and_bounds_hold():
    rng = np.random.default_rng(1)
    for width in (5, 1023, 1024, 1025, 16384):
        a, b = (np.where(rng.random((6, width)) < 0.5, 127, -127).astype(np.int8) for _ in range(2))
        b[0] = a[0]
        assert (ann.products(a, b) == a.astype(np.int64) @ b.T.astype(np.int64)).all()
        u, v = rng.normal(size=(40, width)), rng.normal(size=(30, width)) * rng.random((30, 1)) * 100
        blocks = [(np.arange(len(x)) + at, *ann.quantised(x)) for x, at in ((u, 1000), (v, 0))]
        got = list(ann.tile(*blocks, 30, {}))
        q, c, low, high = (np.concatenate([x[i] for x in got]) for i in range(4))
        cosine = ann.cosines(u[q - 1000], v[c])
        assert len(q) == 1200 and (low <= cosine).all() and (cosine <= high).all() and (high - low).max() < 0.1


def test_lengths_from_the_smallest_to_the_largest_double(spark):
    """Only direction counts: vectors of extreme length are queries and candidates like all others."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 6))
    size = np.array([10.0 ** rng.integers(-300, 300) for _ in v])
    long = v * size[:, None]
    long[7] = [5e-324, 0, 0, 0, 0, 0]
    v[7] = [1, 0, 0, 0, 0, 0]
    long[10], v[10] = [1.7e308, -1.7e308, 0, 0, 0, 0], [1, -1, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(long)], "vec_id long, embedding array<double>")
    assert found(df, 5) == brute(v, range(0, 60, 10), 5)
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 5).collect()}
    for (q, c), s in scores.items():
        assert abs(s - v[q] @ v[c] / np.linalg.norm(v[q]) / np.linalg.norm(v[c])) < 1e-12


def test_scaling_changes_no_digit():
    v = np.random.default_rng(2).normal(size=(50, 9))
    plain = np.clip(ann.dots(v[:25], v[25:]) / (ann.norms(v[:25]) * ann.norms(v[25:])), -1, 1)
    assert (ann.cosines(v[:25], v[25:]) == plain).all() and (ann.cosines(v[:25] * 2.0**-700, v[25:] * 2.0**600) == plain).all()


def test_of_several_vectors_of_one_id_the_least_counts(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 4.0]), (1, [0.0, 1.0]), (1, None), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None)]
    for n in (1, 4):
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n), F.col("vec_id") == 0, 5).collect()
        assert [(r["vec_id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(2, round(0.5**0.5, 9)), (1, 0.0)]
