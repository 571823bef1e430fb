"""The whole classifier in plain Python: cross-fitted evidence, posteriors of hosts and paths without the document's own label, their combination."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import bayes_quality as b


def strength(groups):
    groups = [(n, k) for n, k in groups if n >= 2]
    n, k = sum(x for x, _ in groups), sum(y for _, y in groups)
    if len(groups) < 2 or k in (0, n):
        return b.STRONGEST
    p = k / n
    spread = sum(x * (y / x - p) ** 2 for x, y in groups)
    free = n - sum(x * x for x, _ in groups) / n
    variance = (spread - (len(groups) - 1) * p * (1 - p)) / max(1e-9, free - (len(groups) - 1))
    return b.STRONGEST if variance <= 0 else min(b.STRONGEST, max(b.WEAKEST, p * (1 - p) / variance - 1))


def test_score_equals_a_plain_version(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        source, lang = rng.choice(["a", "b", "c", None]), rng.choice(["en", "de", None])
        good = rng.random() < {"a": 0.9, "b": 0.4, "c": 0.6, None: 0.5}[source]
        words = [rng.choice(["clear", "plain", "text"] if good and rng.random() < 0.4 else [f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 40))]
        docs.append((i, " ".join(words) if i % 50 else None, lang, source, 1))
        if rng.random() < 0.7:
            labels.append((i, int(good)))
    docs += [(None, "clear text", "en", "a", 1), (7, docs[7][1], docs[7][2], docs[7][3], 1)]
    given = [*labels, (None, 1), (399, None), (3, 0), (3, 1), (10**6, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, quality int")
    lab = spark.createDataFrame(given, "doc_id long, quality int")
    got = b.score(df, lab).collect()
    assert len(got) == len(docs)

    known = {}
    for i, y in given:
        if i is not None and y is not None:
            known.setdefault(i, set()).add(y)
    known = {i: min(v) for i, v in known.items() if len(v) == 1}
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)), F.lit(0)).alias("f")).collect()}
    text = {i: t or "" for i, t, *_ in docs}
    weights = []
    for fold in (0, 1):
        rows = sorted((" ".join(text[i].split(" ")), y) for i, y in known.items() if i in text and folds[i] != fold)
        weights.append(b.train([t for t, _ in rows], [y for _, y in rows]))
    host, path, seen = {}, {}, [0, 0]
    where = {i: (s or "", lang or "") for i, _, lang, s, _ in docs}
    for i, y in known.items():
        if i in where:
            for table, key in ((host, where[i][0]), (path, where[i])):
                n, k = table.get(key, (0, 0))
                table[key] = (n + 1, k + y)
            seen = [seen[0] + 1, seen[1] + y]
    base = (seen[1] + 1) / (seen[0] + 2)
    s_host, s_path = strength(host.values()), strength(path.values())
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for r in got:
        i = r["doc_id"]
        _, key, value = b.features(pa.array([text[i]]))
        evidence = float(np.sum(weights[folds[i]].astype(np.float32)[key] * value))
        mine, y = int(i in known), known.get(i, 0)
        n, k = host.get(where[i][0], (0, 0))
        host_rate = (k - y + s_host * base) / (n - mine + s_host)
        n, k = path.get(where[i], (0, 0))
        path_rate = (k - y + s_path * host_rate) / (n - mine + s_path)
        p = 1 / (1 + math.exp(-(evidence + logit(path_rate) - logit(base))))
        assert math.isclose(r["evidence"], evidence, abs_tol=1e-4) and math.isclose(r["host_rate"], host_rate, rel_tol=1e-9)
        assert math.isclose(r["path_rate"], path_rate, rel_tol=1e-9) and math.isclose(r["probability"], p, abs_tol=1e-4)
        assert r["kept"] == (r["probability"] >= 0.25)


def test_own_label_has_no_part_in_the_evidence(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} same text", "en", "a") for i in range(60)], "doc_id long, text string, lang string, source string")
    one = [(i, int(i % 3 > 0)) for i in range(60)]
    other = [(i, 1 - y if i == 30 else y) for i, y in one]
    schema = "doc_id long, quality int"
    a, c = ({r["doc_id"]: r["evidence"] for r in b.score(docs, spark.createDataFrame(x, schema)).collect()} for x in (one, other))
    assert a[30] == c[30] and a != c
