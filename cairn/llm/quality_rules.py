"""Quality rules with risk-controlled thresholds.

Counts of each text give ratios. A text's severity is the largest of its ratios, each measured by the reference value of its rule, and a text is rejected if its severity is over its stratum's
(language's) cutoff: every rule then has the cutoff `REFERENCE` times that number. So one verdict is tested, whatever the number of rules, and the risk is that of all rules together.

For every stratum, labelled good documents are counted over a fixed grid of cutoffs. Cutoffs are tested in a fixed sequence, from the most lenient to the strictest, and the last one before the
first failure is taken: its exact (Clopper-Pearson) upper bound of the false rejection rate is within `risk`. A fixed sequence needs no correction of its own; strata that have labels enough
to pass at all share delta (Bonferroni), so that all guarantees hold at once with probability 1 - delta. Where the first cutoff cannot be guaranteed, no rule is on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, written
from .words import Words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK, UPPER = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(b"!?")] = UPPER[65:91] = True
BLANK = " \t\n\v\f\r"

#: Rules: the ratio of each, and its reference value.
RATIOS = {
    "symbols": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "marks": lambda: F.col("n_marks") / F.greatest("n_words", F.lit(1)),
    "upper": lambda: F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
}
REFERENCE = {"symbols": 0.1, "dup_lines": 0.3, "repeats": 0.5, "word_length": 10.0, "marks": 0.1, "upper": 0.3}
#: Cutoffs of the severity in the order in which they are tested.
GRID = tuple(round(4 * 0.93**k, 3) for k in range(45))


def severity() -> Column:
    return F.greatest(*(ratio() / REFERENCE[rule] for rule, ratio in RATIOS.items()))


def repeated_words(s: np.ndarray, n: int, words: int) -> int:
    """How many of a text's words stand in a window of n words whose hash s occurs twice or more."""
    if words < n or len(s) < 2:
        return 0
    order = np.argsort(s, kind="stable")
    same = s[order][1:] == s[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(words + 1, np.int32)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines), len(lines) - len(set(lines))


def text_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) to doc_id, lang and COUNTS, one row for each row given; a null or empty text counts 0 throughout."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches):
        for batch in slices(batches):
            w = Words(batch.column("text"))
            s, first = w.shingles(3)
            inside = np.concatenate([[0], np.cumsum(w.inside & ((w.data & 0xC0) != 0x80))])[w.at]
            symbols, marks, upper = (np.diff(np.concatenate([[0], np.cumsum(kind[w.data])])[w.at]) for kind in (SYMBOL, MARK, UPPER))
            repeats = [repeated_words(s[a:b], 3, n) for a, b, n in zip(first[:-1], first[1:], w.counts.tolist(), strict=True)]
            lines = [duplicate_lines(t or "") for t in batch.column("text").to_pylist()]
            columns = [w.counts, np.diff(inside), symbols, [x[1] for x in lines], repeats, [x[0] for x in lines], marks, upper]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS))


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


def within_risk(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper confidence bound, at error delta, of a rate of which k of n cases were seen is at most risk."""
    return n > 0 and k < n * risk and log_binomial_cdf(k, n, risk) <= math.log(delta)


def strictest(n: int, over: list[int], risk: float, delta: float) -> float | None:
    """The strictest cutoff that is guaranteed, over[i] of n good texts being over GRID[i]; None if the first is not."""
    found = None
    for k, cutoff in zip(over, GRID, strict=True):
        if not within_risk(k, n, risk, delta):
            break
        found = cutoff
    return found


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, n, cutoff): the strictest cutoff of the severity that is guaranteed to reject at most `risk` of the stratum's good documents; null if none is.

    Holdouts are the documents with labels(doc_id, quality) of quality 1; a document with conflicting labels is none. Strata may be any number: they stay in a table of a row each.
    """
    good = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low")).filter("low = 1").select("doc_id")
    seen = counts.dropDuplicates(["doc_id"]).join(good, "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("stratum"), severity().alias("s"))
    step = F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: c >= F.col("s")))  # the first of the grid that the severity is over
    steps = seen.groupBy("stratum", step.alias("step")).agg(F.count("*").alias("c"))
    table = steps.groupBy("stratum").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("by"))
    table = written(table, "strata")
    least = math.ceil(math.log(delta) / math.log1p(-risk))  # fewer labels cannot pass
    share = delta / max(1, table.filter(F.col("n") >= least).count())
    schema = pa.schema([("stratum", pa.string()), ("n", pa.int64()), ("cutoff", pa.float64())])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                by = dict(r["by"])
                over = np.cumsum([by.get(i, 0) for i in range(len(GRID))]).tolist()
                out.append((r["stratum"], r["n"], strictest(r["n"], over, risk, share)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return table.mapInArrow(run, "stratum string, n long, cutoff double")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """docs(doc_id, text, lang, ...) and labels(doc_id, quality, ...) to doc_id, COUNTS, base_failed, rejected_by (array of rules), cutoff (of the stratum's severity, null if no rule is on) and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. One row for each row given; nulls in text count as empty,
    nulls in lang are a stratum of their own, null labels are none. Without labels no rule is on. Other columns are not read. An empty table gives no rows.
    """
    counts = written(text_counts(docs), "counts")
    found = written(cutoffs(counts, labels, risk, delta).filter("cutoff IS NOT NULL").select("stratum", "cutoff"), "cutoffs")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    hit = [F.when(ratio() / REFERENCE[rule] > F.col("cutoff"), F.lit(rule)) for rule, ratio in RATIOS.items()]
    out = counts.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(found, "stratum", "left")
    out = out.withColumn("base_failed", failed).withColumn("rejected_by", F.array_compact(F.array(*hit)))
    return out.select("doc_id", *COUNTS, "base_failed", "rejected_by", "cutoff", (~failed & (F.size("rejected_by") == 0)).alias("kept"))
