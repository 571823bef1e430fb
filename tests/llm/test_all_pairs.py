"""All pairs of words of a block count in the style tree."""

import math

from cairn.llm import site_tree as s


def test_features_are_all_pairs():
    words = [f"w{i}" for i in range(300)]
    got = s.features(" ".join([*words, *words[:2]]), False)
    assert sorted(got) == sorted({s._key(a, b) for a, b in zip([*words, words[0]], [*words[1:], words[0], words[1]], strict=False)}) and len(got) == 300


def test_importance_follows_all_pairs(spark):
    """A text of which few pairs change is about as important as their share, whichever hashes they have."""
    pages = [(i, "http://a.example.com/x", "<body><div>" + " ".join([*(f"same{k}" for k in range(31)), *(f"own{i}x{k}" for k in range(10))]) + "</div>") for i in range(20)]
    leaf = s.tree_nodes(spark.createDataFrame(pages, "page_id long, url string, html string")).filter("n > 0").collect()
    assert len(leaf) == 1 and math.isclose(leaf[0]["importance"], 10 / 40, abs_tol=1e-9)
