"""Raking under the bound that no probability is over 1, against a plain solver; topics against a plain assignment; targets that cannot be met."""

import math
import random

import numpy as np
import pyarrow as pa

from cairn.llm import mixing as m
from cairn.llm.words import Words

CELLS = "source string, lang string, topic int, tokens long"


def bisected(tokens, q, target):
    low, high = 0.0, 1e12
    if target >= sum(t for t, x in zip(tokens, q, strict=True) if x > 0):
        return high
    for _ in range(200):
        a = (low + high) / 2
        low, high = (a, high) if sum(t * min(1, a * x) for t, x in zip(tokens, q, strict=True)) < target else (low, a)
    return a


def plain(cells, targets, rounds=400):
    """Probabilities by turns: each source, language and topic in turn is solved for its own target, by bisection."""
    f = [{k: 1.0 for k in t} for t in targets]
    for _ in range(rounds):
        for axis in range(3):
            for k, goal in targets[axis].items():
                own = [c for c in cells if c[axis] == k]
                f[axis][k] = bisected([c[3] for c in own], [math.prod(f[x][c[x]] for x in range(3) if x != axis) for c in own], goal)
    return {c[:3]: min(1.0, math.prod(f[x][c[x]] for x in range(3))) for c in cells}


def test_raking_equals_a_plain_solver(spark):
    rng = random.Random(5)
    cells = [(s, lang, t, rng.randint(1, 400)) for s in "abcd" for lang in ("en", "de") for t in range(3)] + [("tiny", "de", 0, 5)]
    share = {"en": 0.2, "de": 0.8}  # more German than half of all tokens in proportion: cells reach 1
    got = m.rake(spark.createDataFrame(cells, CELLS), 0.5, 0.5, languages=share, rounds=400, close=1e-7)
    total = sum(c[3] for c in cells)
    sources = {r["source"]: r for r in got.sources.collect()}
    assert math.isclose(sum(r["target"] for r in sources.values()), total / 2, rel_tol=1e-9) and sources["tiny"]["target"] == 5.0
    raw = {s: sum(c[3] for c in cells if c[0] == s) ** 0.5 for s in sources}
    level = {sources[s]["target"] / raw[s] for s in sources if s != "tiny"}
    assert max(level) - min(level) < 1e-6 * max(level)  # all targets that are not lowered are raised alike
    probability = {(s, lang, t): min(1.0, sources[s]["factor"] * got.languages[lang] * got.topics[t]) for s, lang, t, _ in cells}
    targets = ({s: r["target"] for s, r in sources.items()}, {k: got.margins["lang", k][1] for k in share}, {k: got.margins["topic", k][1] for k in range(3)})
    for axis, goals in enumerate(targets):
        for k, goal in goals.items():
            assert math.isclose(sum(c[3] * probability[c[:3]] for c in cells if c[axis] == k), goal, rel_tol=1e-3)
    want = plain(cells, targets)
    assert any(p == 1.0 for k, p in want.items() if k[0] != "tiny") and all(abs(want[k] - probability[k]) < 5e-3 for k in want)


def test_targets_over_what_there_is_are_lowered_and_said(spark):
    cells = [("a", "en", 0, 900), ("a", "de", 1, 60), ("b", "en", 1, 40)]
    got = m.rake(spark.createDataFrame(cells, CELLS), 0.5, languages={"en": 0.5, "de": 0.5}, sources={"a": 1.0})
    asked, target, expected = got.margins["lang", "de"]
    assert (asked, target) == (250.0, 60.0) and math.isclose(expected, 60.0, rel_tol=0.01)
    assert math.isclose(got.margins["lang", "en"][1], 440.0) and {r["source"]: r["factor"] for r in got.sources.collect()}["b"] == 0.0
    none = m.rake(spark.createDataFrame([], CELLS))
    assert none.sources.count() == 0 and none.margins == {}


def test_hundreds_of_languages(spark, monkeypatch):
    cells = [(f"s{i % 3}", f"l{i}", i % 4, 10 + i) for i in range(400)]
    df = spark.createDataFrame(cells, CELLS)
    got = m.rake(df, 0.3, 1.0)
    assert all(math.isclose(x, y, rel_tol=0.01) for (kind, _), (_, y, x) in got.margins.items() if kind == "lang")
    monkeypatch.setattr(m, "MOST_LANGUAGES", 50)
    got = m.rake(df, 0.3, 1.0)
    assert len(got.languages) == 51 and math.isclose(got.margins["lang", m.OTHERS][1], 0.3 * sum(10 + i for i in range(350)))


def test_topics_equal_a_plain_assignment():
    rng = random.Random(6)
    themes = [[f"{k}word{i}" for i in range(30)] for k in ("sea", "law", "art")]
    texts = [" ".join(rng.choice(themes[i % 3]) for _ in range(40)) for i in range(120)] + ["", "a an it"]
    langs = ["en" if i % 2 else "de" for i in range(len(texts))]
    model = m.cluster(texts, langs, topics=3)
    got, counts = model.of(pa.array([*texts, None]), [*langs, "xx"])
    assert got[-3:].tolist() == [-1, -1, -1] and counts[-2] == 3
    for text, lang, topic in list(zip(texts, langs, got.tolist(), strict=False))[:120]:
        vector = np.zeros(m.BINS)
        for h in Words(pa.array([text]), lower=True).hashes().tolist():
            vector[h % m.BINS] += 1
        vector = np.where(vector > 0, 1 + np.log(np.maximum(vector, 1)), 0) * model.weights
        near = model.centres @ (vector / np.sqrt(vector @ vector)) - model.means[lang]
        assert near.argmax() == topic
    assert len({tuple(sorted(set(got[i:120:3].tolist()))) for i in range(3)}) == 3 and all(len(set(got[i:120:3].tolist())) == 1 for i in range(3))
