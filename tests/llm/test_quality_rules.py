"""Risk-controlled cutoffs against a brute-force version of the whole procedure."""

import math
import random

from pyspark.sql import functions as F

from cairn.llm import quality_rules as q


def upper_bound(k, n, delta):
    """The exact upper confidence bound of a rate, by bisection on the binomial distribution."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > delta:
            low = p
        else:
            high = p
    return high


def text(rng, bad):
    words = [f"w{rng.randrange(10**5)}" for _ in range(60)]
    return " ".join(words + ["#"] * bad)


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(8)
    data, labels = [], []
    for lang, n, share in (("en", 500, 0.01), ("de", 300, 0.03), (None, 260, 0.0), ("fr", 100, 0.0), *((f"x{i}", 3, 0.0) for i in range(300))):
        for _ in range(n):
            i = len(data)
            noisy = rng.randint(1, 40) if rng.random() < share else 0
            data.append((i, text(rng, noisy), lang, "clash", 1.5))
            labels.append((i, 1 if rng.random() < 0.95 else 0, lang))
    labels += [(0, 0, None), (1, None, None), (None, 1, None), (5, 1, None), (10**9, 1, None)]
    docs = spark.createDataFrame(data + data[5:6], "doc_id long, text string, lang string, stratum string, cutoff double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, lang string")
    out = q.quality_rules(docs, lab).collect()
    assert len(out) == len(data) + 1
    low = {}
    for i, y, _ in labels:
        if i is not None and y is not None:
            low[i] = min(y, low.get(i, 1))
    severity = {}
    for r in out:
        ratios = {"symbols": r["n_symbols"] / max(r["n_words"], 1), "dup_lines": r["n_dup_lines"] / max(r["n_lines"], 1), "repeats": r["n_repeat_words"] / max(r["n_words"], 1), "word_length": r["word_chars"] / max(r["n_words"], 1), "marks": r["n_marks"] / max(r["n_words"], 1), "upper": r["n_upper"] / max(r["word_chars"], 1)}
        severity[r["doc_id"]] = {rule: x / q.REFERENCE[rule] for rule, x in ratios.items()}
    good = {}
    for i, _, lang, *_ in data:
        if low.get(i) == 1:
            good.setdefault(lang or "", []).append(max(severity[i].values()))
    strata = sum(len(v) >= math.log(0.05) / math.log(0.98) for v in good.values())
    assert strata == 3
    want = {}
    for lang, values in good.items():
        for cutoff in q.GRID:
            if upper_bound(sum(x > cutoff for x in values), len(values), 0.05 / strata) > 0.02:
                break
            want[lang] = cutoff
    assert set(want) >= {"en", ""} and "fr" not in want and "x1" not in want
    by = {i: lang or "" for i, _, lang, *_ in data}
    for r in out:
        cutoff = want.get(by[r["doc_id"]])
        assert r["cutoff"] == cutoff
        assert sorted(r["rejected_by"]) == sorted(rule for rule, x in severity[r["doc_id"]].items() if cutoff is not None and x > cutoff)
        assert r["kept"] == (not r["base_failed"] and not r["rejected_by"])


def test_rules_are_on_and_within_risk(spark):
    """At sf0.1 every language with 300 good labels has a cutoff, and at most 2 % of its good documents are rejected."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = q.quality_rules(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("quality = 1")
    rates = out.groupBy("lang").agg(F.count("*").alias("n"), F.max("cutoff").alias("cutoff"), F.avg((F.size("rejected_by") > 0).cast("int")).alias("rate")).filter("n >= 300").collect()
    assert len(rates) >= 4 and all(r["cutoff"] is not None and r["rate"] <= 0.02 for r in rates)
