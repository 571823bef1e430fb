"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on hashed words and counts gives each text's own evidence. Labels aggregated by host (source) and by path (source and language) give Beta posteriors: a path is shrunk
toward its host, a host toward the global prior, by strengths fitted from the labels' own spread (method of moments). A document's probability combines its evidence with its path's posterior.
Documents are in two folds by a hash of doc_id, and the evidence of one fold comes from weights fitted on the other, so that no document is judged by its own label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, written
from .words import SPACE, Words

DIMENSION = 1 << 13
WEAKEST, STRONGEST = 2.0, 1000.0
#: Labelled texts of which weights are fitted, about.
MOST = 4000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: (text, feature, value) with the root of each count, unit length, and a few ratios."""
    w = Words(column, lower=True)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    key = doc * DIMENSION + (w.hashes() % np.uint64(DIMENSION)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row, value = key // DIMENSION, np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value * value, len(w.counts)))
    value = value / np.maximum(norm[row], 1e-9)
    n = np.maximum(np.diff(w.at), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.at])
    letters = sums(((w.data >= 97) & (w.data <= 122)) | (w.data >= 0x80))
    digits = sums((w.data >= 48) & (w.data <= 57))
    spaces = sums(SPACE[w.data])
    s, first = w.shingles(3)
    repeats = np.array([1 - len(np.unique(s[a:b])) / max(1, b - a) for a, b in zip(first[:-1], first[1:], strict=True)])
    many = np.log1p(w.counts) / 10
    dense = np.stack([np.ones(len(n)), (n - letters - spaces - digits) / n, digits / n, repeats, many, many * many, (n - spaces) / np.maximum(w.counts, 1) / 20], 1)
    at, k = np.nonzero(dense)
    return np.concatenate([row, at]), np.concatenate([key % DIMENSION, DIMENSION + k]), np.concatenate([value, dense[at, k]])


def train(texts: list[str], labels: list[int], rounds: int = 150, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression; zero without both kinds of labels."""
    weights = np.zeros(DIMENSION + 7)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return weights
    parts = []
    for at in range(0, len(texts), 256):  # a few texts at a time, to keep the driver's memory low
        row, key, value = features(pa.array(texts[at : at + 256]))
        parts.append(((row + at).astype(np.int32), key.astype(np.int32), value.astype(np.float32)))
    row, key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[key] * value, len(y)), -30, 30)))
        g = np.bincount(key, (p - y)[row] * value, len(weights)) / len(y) + decay * weights
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST, words: int = 2000) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts, about `most`, by a hash of doc_id; of a long text a passage of `words` words, cut to 200 characters each, from a place that the hash chooses."""
    count = labels.count()
    share = int(min(1.0, most / max(1, count)) * (1 << 30))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    rows = docs.join(chosen, "doc_id").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))

    def cut(batches):
        for batch in batches:
            out = []
            for t, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                parts = (t or "").split(" ")
                a = at % max(1, len(parts) - words + 1)
                out.append(" ".join(p[:200] for p in parts[a : a + words]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("quality")], names=["text", "quality"])

    got = sorted(map(tuple, rows.select("text", F.col("quality").cast("int").alias("quality"), "at").mapInArrow(cut, "text string, quality int").limit(2 * most).collect()))
    return [t for t, _ in got], [y for _, y in got]


def _strength(groups: DataFrame) -> float:
    """Pseudo-counts of the prior that fits the spread of the groups' rates (method of moments), over groups of two labels or more."""
    r = groups.filter("n >= 2").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not r["g"] or r["g"] < 2 or r["k"] in (0, r["n"]):
        return STRONGEST
    p = r["k"] / r["n"]
    between = r["kk"] - r["n"] * p * p  # sum of n * (rate - p)**2
    free = r["n"] - r["nn"] / r["n"]
    variance = (between - (r["g"] - 1) * p * (1 - p)) / max(1e-9, free - (r["g"] - 1))
    return STRONGEST if variance <= 0 else float(min(STRONGEST, max(WEAKEST, p * (1 - p) / variance - 1)))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """docs(doc_id, text, lang, source, ...), labels(doc_id, quality, ...) to doc_id, evidence, host_rate, path_rate, probability (of good quality) and kept, one row for each row given.

    A document's own label never counts toward its evidence, its host or its path. Documents without doc_id are in one fold. kept: probability >= cutoff. A null text is empty; null languages and sources are groups of their own; labels
    that are null or contradict each other are none; without labels every rate is one half. Other columns are not read. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").select("doc_id", "quality")
    fold = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)), F.lit(0)).cast("int")
    own, known = own.withColumn("fold", fold), known.withColumn("fold", fold)
    texts = own.dropDuplicates(["doc_id"]).drop("fold")
    weights = np.stack([train(*training_rows(texts, known.filter(F.col("fold") != k).drop("fold"), MOST // 2)) for k in (0, 1)]).astype(np.float32)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("evidence", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            row, key, value = features(batch.column("text"))
            evidence = np.bincount(row, weights[batch.column("fold").to_numpy()[row], key] * value, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(evidence)], schema=schema)

    evidence = written(own.mapInArrow(run, "doc_id long, lang string, source string, evidence double").join(known.drop("fold"), "doc_id", "left"), "evidence")
    labelled = evidence.filter("quality IS NOT NULL").dropDuplicates(["doc_id"])
    paths = written(labelled.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k")), "paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    all_n, all_k = paths.agg(F.sum("n"), F.sum("k")).first()
    base = (all_k + 1) / (all_n + 2) if all_n else 0.5
    strong_host, strong_path = _strength(hosts), _strength(paths)
    out = evidence.join(hosts.select("source", F.col("n").alias("hn"), F.col("k").alias("hk")), "source", "left").join(paths.select("source", "lang", F.col("n").alias("pn"), F.col("k").alias("pk")), ["source", "lang"], "left")
    mine, good = F.when(F.col("quality").isNull(), 0).otherwise(1), F.coalesce("quality", F.lit(0))
    rest = lambda c, x: F.greatest(F.coalesce(c, F.lit(0)) - x, F.lit(0))
    out = out.withColumn("host_rate", (rest("hk", good) + strong_host * base) / (rest("hn", mine) + strong_host))
    out = out.withColumn("path_rate", (rest("pk", good) + strong_path * F.col("host_rate")) / (rest("pn", mine) + strong_path))
    logit = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(base))
    out = out.withColumn("probability", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "probability", (F.col("probability") >= cutoff).alias("kept"))
