"""Topics are fitted on all texts, with all their words."""

import random

import numpy as np

from cairn.llm import mixing as m


def test_fit_equals_the_one_in_memory(spark):
    """More texts than any bounded sample took, of which the last third of words alone tells the topic."""
    rng = random.Random(8)
    themes = [[f"{k}word{i}" for i in range(40)] for k in ("sea", "law", "art")]
    rows = [(" ".join([*(f"plain{rng.randrange(60)}" for _ in range(10)), *(rng.choice(themes[i % 3]) for _ in range(20))]), ("en", "de", None)[i % 7 % 3]) for i in range(2500)]
    rows += [("", "en"), ("a an it", "de"), (None, "en"), *rows[:5]]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = m.fit_topics(df, topics=3)
    want = m.cluster([t or "" for t, _ in rows], [x or "" for _, x in rows], topics=3)
    assert np.allclose(got.weights, want.weights, atol=1e-12) and np.allclose(got.centres, want.centres, atol=1e-6)
    assert got.means.keys() == want.means.keys() and all(np.allclose(got.means[k], want.means[k], atol=1e-6) for k in got.means)


def test_no_texts_and_few(spark):
    empty = m.fit_topics(spark.createDataFrame([(None, "en"), ("", "en")], "text string, lang string"))
    assert len(empty.centres) == 0
    one = m.fit_topics(spark.createDataFrame([("letters words", "en")], "text string, lang string"))
    assert len(one.centres) == 1


def test_languages_beyond_the_largest_share_a_mean(spark, monkeypatch):
    monkeypatch.setattr(m, "MOST_LANGUAGES", 2)
    rows = [(f"letters word{i % 5} other{i % 3}", ("en", "de", "fr", "it")[i % 10 % 4]) for i in range(60)]
    got = m.fit_topics(spark.createDataFrame(rows, "text string, lang string"), topics=2)
    assert set(got.means) == {"en", "de", m.OTHERS, None} and np.array_equal(got.means[None], got.means[m.OTHERS])
