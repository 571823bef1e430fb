"""Large groups of near copies against brute force: most not linked with the text they come from, families within the group, lists with unlike texts."""

import random

import pytest

from cairn.llm import neardup

from test_llm import documents, shingle_set


def components(sets, percent):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in range(len(sets))}


def copies(rng, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(1, most)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [f"x{rng.randrange(10**6)}"], [], [words[at], f"y{rng.randrange(50)}"]])
        out.append(words)
    return out


@pytest.mark.parametrize("block", [16, 100_000])
def test_large_mixed_groups_equal_brute_force(spark, monkeypatch, block):
    """The same components whether groups are thinned and compared in blocks or compared at once."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PARTNERS", 8)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = copies(rng, base, 150, 9)
    for k in range(3):  # families, far from the base and near each other
        child = list(base)
        for at in range(5 + k, 120, 9):
            child[at] = f"c{k}_{at}"
        texts += copies(rng, child, 30, 4)
    passage = [f"p{i}" for i in range(40)]
    texts += [[f"own{i}_{j}" for j in range(rng.randint(3, 30))] + passage for i in range(60)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want = components([shingle_set(t, 3) for t in texts], 85)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert got == want and 20 < len(set(want.values())) < len(texts) - 50


def test_five_thousand_near_copies(spark, monkeypatch):
    """Most of 5,000 near copies are not linked with the centre: few of them are left to compare, and the components are those of links with the centre and of a brute-force check of the rest."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [base]
    for _ in range(5000):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 5, 6, 7, 8, 9, 12])):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t, 3) for t in texts]
    left = []
    able = neardup.able
    monkeypatch.setattr(neardup, "able", lambda *a: left.append(able(*a)) or left[-1])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), 3, 85).collect()}
    linked = {i for i, s in enumerate(sets) if 100 * len(s & sets[0]) >= 85 * len(s | sets[0])}
    rest = [i for i in range(len(sets)) if i not in linked]
    assert len(rest) > 2500 and all(got[i] == 0 for i in linked)
    holders = {}
    for i in rest:
        for e in sets[i] - sets[0]:
            holders.setdefault(e, []).append(i)
    for i in rest:  # a link needs as many common changes as this; none has them
        assert got[i] == i and len(sets[i] - sets[0]) > 0 and all(len(v) == 1 for v in (holders[e] for e in sets[i] - sets[0]))
    assert left[0][0].count() < 1500
