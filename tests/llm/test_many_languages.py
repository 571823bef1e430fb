"""Models of hundreds of labels: no label count is an error, and blocks of a text give what the whole text gives."""

import random

import numpy as np
import pyarrow as pa

from cairn.llm import langid


def test_marginals_in_blocks_equal_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(5)
    e, steps = rng.random((400, 20)), rng.random((20, 20)) + 0.1
    which, first = rng.integers(0, 400, 900), np.array([0, 0, 1, 30, 700, 700, 900])
    want = langid.marginals(e[which], first, steps)
    monkeypatch.setattr(langid, "BLOCK", 20 * 50)
    got = np.full_like(want, -1)
    for at, p in langid.marginals_in_blocks(e, which, first, steps):
        got[at : at + len(p)] = p
    assert np.allclose(got, want)


def test_three_hundred_languages(spark):
    rng = random.Random(2)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(25)] for i in range(300)}
    passage = lambda i, n: " ".join(rng.choice(words[f"l{i:03d}"]) for _ in range(n))
    data = [(300 * k + i, passage(i, 60), f"l{i:03d}") for k in range(4) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    samples = langid.training_samples(docs)
    assert len({lang for lang, _ in samples}) == 300
    model = langid.train(samples, rounds=40)
    found = [x for x, _ in langid.predict(model, pa.array([passage(i, 40) for i in range(300)]))]
    assert sum(x == f"l{i:03d}" for i, x in enumerate(found)) > 240
    assert langid.predict(model, pa.array([None, "", "12"])) == [("und", 0.0)] * 3
    assert {lang for lang, _ in langid.training_samples(docs, languages=20)} == {f"l{i:03d}" for i in range(20)}
    assert len(langid.training_samples(docs, most=600)) < 1300
