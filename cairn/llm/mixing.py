"""Mixing sources to target weights by iterative proportional fitting.

Token counts by source, language and topic are raked to three target marginals under the bound that no probability exceeds 1: a cell's probability is min(1, a * b * c) with a factor for its source,
its language and its topic. In each round every source's factor is solved exactly for its target; then clipped cells stay at 1 and the others are raked to the language and topic targets. Documents
are drawn with the probability of their cell. A target that is over the tokens that there are is lowered to them, and the rest of its margin takes the difference.

Sources may be many and stay in a table, one row each with its cells; the factors of languages and topics are kept by the driver. Topics are clusters of hashed, weighted words around centres
fitted on all texts, taken after each language's mean is removed, so that they do not just follow the language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import BATCH_BYTES, slices, written
from .words import Words

TOPICS, BINS, TOPIC_LETTERS = 8, 4096, 5
#: Rounds of fitting; texts that centres may start from; parts that values are rounded to, so that sums are exact.
ROUNDS, STARTS, SCALE = 15, 64, 1 << 20
#: Languages with a margin of their own, those with most tokens; all others share one.
MOST_LANGUAGES, OTHERS = 1 << 16, "\0others"
CARRIED = "_doc_"
#: Factor of a source of which everything is taken.
ALL = 1e200


@dataclass
class Topics:
    """Weights of the bins, centres (topic, bin), and for each language, and for others under None, the centres' products with its mean."""

    weights: np.ndarray
    centres: np.ndarray
    means: dict[str | None, np.ndarray]

    def of(self, column: pa.Array, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The topic of each text, the smaller one if equal, -1 for a text without words of TOPIC_LETTERS bytes or more; and its words."""
        w = Words(column, lower=True)
        out = np.full(len(w.counts), -1, np.int32)
        if len(self.centres):
            row, b, value = bins(w, self.weights)
            if len(row):
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                near = np.stack([np.add.reduceat(value * c[b], begin) for c in self.centres], 1)
                lost = np.stack([self.means.get(langs[i], self.means[None]) for i in row[begin].tolist()])
                out[row[begin]] = (near - lost).argmax(1)
        return out, w.counts


def counted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, count) of each text's longer words."""
    long = (w.ends - w.starts) >= TOPIC_LETTERS
    text = np.repeat(np.arange(len(w.counts)), w.counts)[long]
    key, count = np.unique(text * BINS + (w.hashes()[long] % np.uint64(BINS)).astype(np.int64), return_counts=True)
    return key // BINS, key % BINS, count


def weighed(row: np.ndarray, b: np.ndarray, count: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Values of the bins of n texts: 1 + log of the count by the bin's weight, of unit length."""
    value = (1 + np.log(count)) * weights[b]
    norm = np.sqrt(np.bincount(row, value * value, n))
    return value / np.maximum(norm[row], 1e-12)


def bins(w: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value) of each text's longer words."""
    row, b, count = counted(w)
    return row, b, weighed(row, b, count, weights, len(w.counts))


def unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(1e-12, np.sqrt((c * c).sum(-1, keepdims=True)))


def spread_out(vectors: np.ndarray, topics: int) -> np.ndarray:
    """The first vector, and again and again the one whose nearest chosen one is farthest."""
    chosen = [0]
    while len(chosen) < min(topics, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(1)
        near[chosen] = np.inf
        chosen.append(int(near.argmin()))
    return vectors[chosen]


def cluster(texts: list[str], langs: list[str], topics: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """What fit_topics finds, of a few texts in memory: k-means by direction of the texts' bins without their language's mean."""
    w = Words(pa.array(texts, pa.string()), lower=True)
    row, b, count = counted(w)
    kept, row = np.unique(row, return_inverse=True)
    n = len(kept)
    if not n:
        return Topics(np.ones(BINS), np.zeros((0, BINS)), {})
    weights = np.log((1 + n) / (1 + np.bincount(b, minlength=BINS)))
    whole = np.zeros((n, BINS))
    whole[row, b] = np.rint(weighed(row, b, count, weights, n) * SCALE) / SCALE
    langs = [langs[i] for i in kept.tolist()]
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs])
    mean = np.stack([whole[lang == j].mean(0) for j in range(len(names))])
    own = whole - mean[lang]
    at = {xxhash.xxh64_intdigest(texts[i].encode(), 42) ^ (1 << 63): k for k, i in enumerate(kept.tolist())}
    centres = spread_out(unit(own[[at[x] for x in sorted(at)[:STARTS]]]), topics)
    for _ in range(rounds):
        best = (own @ centres.T).argmax(1)
        centres = np.stack([unit(own[best == j].sum(0)) if (best == j).any() else c for j, c in enumerate(centres)])
    return Topics(weights, centres, {x: centres @ mean[j] for j, x in enumerate(names)} | {None: centres @ mean.mean(0)})


def packed(values: np.ndarray, row: np.ndarray, dtype: type) -> pa.Array:
    """Values in order of their row as one binary for each row that has some."""
    begin = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) * np.dtype(dtype).itemsize
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(values.astype(dtype))])


def unpacked(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and the row of each."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype), np.repeat(np.arange(len(column)), np.diff(at) // np.dtype(dtype).itemsize)


def table_of(columns: dict[str, np.ndarray | list], ddl: str) -> pa.RecordBatch:
    kind = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[x.split()[0]], kind[x.split()[1]]) for x in ddl.split(", ")], names=[x.split()[0] for x in ddl.split(", ")])


def fit_topics(docs: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """Topics fitted on all texts, each with all its words: k-means by direction of the texts' bins without their language's mean.

    The bins of every text are counted once and written; weights, means of languages and each round's centres are sums over that table. The sums are of whole numbers (values by SCALE), so they do not depend on the order of rows. Centres start from texts
    far from one another among the STARTS distinct ones of smallest hash; the rounds move them. Languages beyond the MOST_LANGUAGES with most texts share one mean.
    """
    own = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    large = [r["lang"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    if len(large) == MOST_LANGUAGES:
        own = own.join(F.broadcast(docs.sparkSession.createDataFrame([(x, True) for x in large], "lang string, _own boolean")), "lang", "left").withColumn("lang", F.when(F.col("_own"), F.col("lang")).otherwise(OTHERS))

    def count(batches):
        for batch in slices(batches):
            row, b, many = counted(Words(batch.column("text"), lower=True))
            if len(row):
                kept = pa.array(np.unique(row))
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(kept), batch.column("at").take(kept), packed(b, row, np.uint16), packed(many, row, np.uint32)], names=["lang", "at", "bins", "counts"])

    rows = written(own.select("lang", "text", F.xxhash64("text").alias("at")).mapInArrow(count, "lang string, at long, bins binary, counts binary"), "bins")

    def found(batches):
        out = np.zeros(BINS + 1)
        for batch in slices(batches, "bins"):
            b, _ = unpacked(batch.column("bins"), np.uint16)
            out += np.append(np.bincount(b, minlength=BINS), batch.num_rows)
        place = np.flatnonzero(out)
        yield table_of({"bin": place, "s": out[place]}, "bin int, s double")

    texts_with = np.zeros(BINS + 1)
    for r in rows.select("bins").mapInArrow(found, "bin int, s double").groupBy("bin").agg(F.sum("s").alias("s")).collect():
        texts_with[r["bin"]] = r["s"]
    n = texts_with[BINS]
    if not n:
        return Topics(np.ones(BINS), np.zeros((0, BINS)), {})
    weights = np.log((1 + n) / (1 + texts_with[:BINS]))

    def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bin, value by SCALE, a whole number)"""
        b, row = unpacked(batch.column("bins"), np.uint16)
        many, _ = unpacked(batch.column("counts"), np.uint32)
        return row, b.astype(np.int64), np.rint(weighed(row, b, many, weights, batch.num_rows) * SCALE)

    def by_language(batches):
        for batch in slices(batches, "bins", BATCH_BYTES // 4):
            row, b, value = vectors(batch)
            lang = batch.column("lang").dictionary_encode()
            code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
            key, at = np.unique(np.concatenate([code[row] * np.int64(BINS + 1) + b, code * np.int64(BINS + 1) + BINS]), return_inverse=True)
            total = np.bincount(at, np.concatenate([value, np.ones(len(code))]))
            yield table_of({"lang": [names[i] for i in (key // (BINS + 1)).tolist()], "bin": key % (BINS + 1), "s": total}, "lang string, bin int, s double")

    sums = rows.select("lang", "bins", "counts").mapInArrow(by_language, "lang string, bin int, s double").groupBy("lang", "bin").agg(F.sum("s").alias("s"))
    means = sums.groupBy("lang").agg(F.max(F.when(F.col("bin") == BINS, F.col("s"))).alias("n"), F.collect_list(F.when(F.col("bin") < BINS, F.struct("bin", "s"))).alias("sums"))
    means = written(means.select("lang", "n", F.col("sums.bin").alias("bins"), F.col("sums.s").alias("sums")), "means")

    def mean_rows(batches):
        for batch in batches:
            for lang, m, b, s in zip(*(batch.column(c) for c in ("lang", "n", "bins", "sums")), strict=True):
                yield lang.as_py(), np.array(b.values, np.int64), np.array(s.values, np.float64) / (m.as_py() * SCALE)

    def lost_to(centres: np.ndarray) -> dict[str, np.ndarray]:
        """Of each language the centres' products with its mean."""

        def run(batches):
            got = [(lang, (centres[:, b] @ mean).tobytes()) for lang, b, mean in mean_rows(batches)]
            yield table_of({"lang": [x for x, _ in got], "lost": [x for _, x in got]}, "lang string, lost binary")

        return {r["lang"]: np.frombuffer(r["lost"]) for r in means.mapInArrow(run, "lang string, lost binary").collect()}

    def means_by(many: dict[str, np.ndarray], k: int) -> np.ndarray:
        """The sum of the languages' means, each as often as it has texts in each topic."""

        def run(batches):
            out = np.zeros((k, BINS))
            for lang, b, mean in mean_rows(batches):
                if lang in many:
                    out[:, b] += many[lang][:, None] * mean
            yield table_of({"s": [out.tobytes()]}, "s binary")

        return sum(np.frombuffer(r["s"]).reshape(k, BINS) for r in means.mapInArrow(run, "s binary").collect())

    first = [r["at"] for r in rows.select("at").distinct().orderBy("at").limit(STARTS).collect()]
    starts = sorted(rows.filter(F.col("at").isin(first)).dropDuplicates(["at"]).collect(), key=lambda r: r["at"])
    ones = {r["lang"]: np.array([float(r["lang"] == x["lang"]) for x in starts]) for r in starts}
    row, b, value = vectors(pa.RecordBatch.from_arrays([pa.array([bytes(r[c]) for r in starts], pa.binary()) for c in ("bins", "counts")], names=["bins", "counts"]))
    whole = np.zeros((len(starts), BINS))
    whole[row, b] = value / SCALE
    centres = spread_out(unit(whole - means_by(ones, len(starts))), topics)
    k = len(centres)
    columns = [f"s{j}" for j in range(k)]
    ddl = ", ".join(["lang string", "bin int", *(f"{c} double" for c in columns)])
    lost = lost_to(centres)

    def assigned(centres: np.ndarray, lost: dict[str, np.ndarray]):
        def run(batches):
            total, many = np.zeros((k, BINS)), {}
            turned = np.ascontiguousarray(centres.T)
            for batch in slices(batches, "bins", BATCH_BYTES // 4):
                row, b, value = vectors(batch)
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                langs = batch.column("lang").to_pylist()
                best = (np.add.reduceat(turned[b] * value[:, None], begin) / SCALE - np.stack([lost[x] for x in langs])).argmax(1)
                total += np.bincount(best[row] * BINS + b, value, k * BINS).reshape(k, BINS)
                for lang, j in zip(langs, best.tolist(), strict=True):
                    many.setdefault(lang, np.zeros(k))[j] += 1
            place = np.flatnonzero(total.any(0))
            both = np.concatenate([total[:, place].T, *(x[None] for x in many.values())])
            yield table_of({"lang": [None] * len(place) + list(many), "bin": [*place.tolist(), *[BINS] * len(many)], **{c: both[:, j] for j, c in enumerate(columns)}}, ddl)

        return run

    for _ in range(rounds):
        seen = rows.select("lang", "bins", "counts").mapInArrow(assigned(centres, lost), ddl).groupBy("lang", "bin").agg(*(F.sum(c).alias(c) for c in columns)).collect()
        total, many = np.zeros((k, BINS)), {}
        for lang, place, *x in seen:
            if place < BINS:
                total[:, place] = x
            else:
                many[lang] = np.array(x)
        new = unit(total / SCALE - means_by(many, k))
        new = np.where(sum(many.values())[:, None] > 0, new, centres)  # a centre without texts stays
        still = np.array_equal(new, centres)
        centres, lost = new, lost_to(new)
        if still:
            break
    return Topics(weights, centres, lost | {None: lost.get(OTHERS, sum(lost.values()) / len(lost))})


def text_facts(docs: DataFrame, model: Topics, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) to doc_id, lang, source (empty if null), topic, n_tokens (words), mark (a hash of the text where doc_id is null), and the columns to carry, CARRIED before their names."""
    names = ["doc_id", "lang", "source", "topic", "n_tokens", "mark", *(CARRIED + c for c in carry)]

    def run(batches):
        for batch in slices(batches):
            topic, counts = model.of(batch.column("text"), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(topic), pa.array(counts, pa.int64()), batch.column("mark"), *(batch.column("text" if c == "text" else CARRIED + c) for c in carry)], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).alias("mark"), *(F.col(c).alias(CARRIED + c) for c in carry if c != "text"))
    facts = StructType.fromDDL("doc_id long, lang string, source string, topic int, n_tokens long, mark long")
    return own.mapInArrow(run, StructType([*facts, *(StructField(CARRIED + c, StringType() if c == "text" else docs.schema[c].dataType) for c in carry)]))


def tempered(totals: dict, power: float) -> dict:
    """Target shares in proportion to a power of the tokens that there are."""
    raw = {k: v**power for k, v in totals.items() if v > 0}
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def within(targets: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Targets lowered to what is there, the others raised in proportion so that the sum stays, if it can."""
    out, total = np.minimum(targets, there), min(targets.sum(), there[targets > 0].sum())
    for _ in range(len(targets)):
        free = (out < there) & (targets > 0)
        if not free.any() or out.sum() >= total * (1 - 1e-12):
            break
        out = np.where(free, np.minimum(there, targets * ((total - out[~free].sum()) / targets[free].sum())), out)
    return out


def solved(tokens: np.ndarray, q: np.ndarray, target: float) -> float:
    """The factor a for which the sum of tokens * min(1, a * q) is target; ALL if that takes everything."""
    order = np.argsort(-q, kind="stable")
    t, q = tokens[order][q[order] > 0], q[order][q[order] > 0]
    if target <= 0 or not len(q):
        return 0.0
    if target >= t.sum() * (1 - 1e-12):
        return ALL
    clipped = np.concatenate([[0.0], np.cumsum(t)[:-1]])  # tokens of the cells before each, all at 1
    a = (target - clipped) / np.cumsum((t * q)[::-1])[::-1]
    return float(a[np.flatnonzero(a * q <= 1 + 1e-12)[0]])


@dataclass
class Mix:
    """sources(source, factor, target, expected), in tokens; factors of languages and topics; margins: (kind, name) to asked, target (what there can be of it) and expected tokens."""

    sources: DataFrame
    languages: dict[str, float]
    topics: dict[int, float]
    margins: dict[tuple[str, object], tuple[float, float, float]]


def rake(cells: DataFrame, fraction: float = 0.5, power: float = 0.7, languages: dict[str, float] | None = None, topics: dict[int, float] | None = None, sources: dict[str, float] | None = None, rounds: int = 60, close: float = 1e-3) -> Mix:
    """cells(source, lang, topic, tokens) to the factors by which `fraction` of the tokens meets the target shares, each margin to within `close` of every target.

    Targets that are not given are the shares of tokens to the given power. A source, language or topic without a target share gets factor 0. A target over the tokens that there are is
    lowered to them (Mix.margins and Mix.sources say so); targets that contradict one another are met as nearly as `rounds` rounds bring them, sources first.
    """
    by = cells.groupBy("lang").agg(F.sum("tokens").alias("t"))
    named = {r["lang"]: r["t"] for r in by.orderBy(F.desc("t"), "lang").limit(MOST_LANGUAGES).collect()}
    if len(named) == MOST_LANGUAGES:
        named[OTHERS] = (by.agg(F.sum("t")).first()[0] or 0) - sum(named.values())
    names, kinds = sorted(named), sorted(r["topic"] for r in cells.select("topic").distinct().collect())
    at_l, at_t = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(kinds)}
    shape = (len(names), len(kinds))
    rows = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens")).alias("c"), F.sum("tokens").alias("t"))
    if sources is not None:
        wanted = cells.sparkSession.createDataFrame(list(sources.items()) or [("", 0.0)], "source string, raw double")
        rows = rows.join(wanted, "source", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    else:
        rows = rows.withColumn("raw", F.pow("t", F.lit(power)))
    rows = written(rows.withColumn("t", F.col("t").cast("double")), "rows")
    total, raw = rows.agg(F.sum("t"), F.sum("raw")).first()
    goal = fraction * (total or 0.0)
    up = goal / raw if raw else 0.0  # tokens by raw share; targets over what is there are lowered, the others raised, until none is over
    for _ in range(rounds):
        full, free = rows.agg(F.sum(F.when(F.col("raw") * up >= F.col("t"), F.col("t"))), F.sum(F.when(F.col("raw") * up < F.col("t"), F.col("raw")))).first()
        new = max(0.0, goal - (full or 0.0)) / free if free else up
        if new <= up * (1 + 1e-9):
            break
        up = new
    rows = written(rows.withColumn("target", F.least("t", F.col("raw") * up)), "targets")

    def here(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([at_l.get(x["lang"], at_l.get(OTHERS, 0)) for x in c]), np.array([at_t[x["topic"]] for x in c]), np.array([float(x["tokens"]) for x in c])

    def sums(b: np.ndarray, g: np.ndarray) -> np.ndarray:
        """For languages and topics, the tokens of clipped cells, of others by their probability, and all."""
        def run(batches):
            out = np.zeros((3, *shape))
            for batch in batches:
                for c, target in zip(batch.column("c").to_pylist(), batch.column("target").to_pylist(), strict=True):
                    i, j, t = here(c)
                    p = solved(t, b[i] * g[j], target) * b[i] * g[j]
                    for k, x in enumerate((np.where(p >= 1, t, 0.0), np.where(p < 1, t * p, 0.0), t)):
                        np.add.at(out[k], (i, j), x)
            place = np.flatnonzero(out.any(0).ravel())
            flat = out.reshape(3, -1)[:, place]
            yield pa.RecordBatch.from_arrays([pa.array(place), *map(pa.array, flat)], names=["place", "clipped", "free", "all"])

        got = rows.mapInArrow(run, "place long, clipped double, free double, all double").groupBy("place").agg(*(F.sum(x) for x in ("clipped", "free", "all"))).collect()
        out = np.zeros((3, shape[0] * shape[1]))
        for place, *x in got:
            out[:, place] = x
        return out.reshape(3, *shape)

    b, g = np.ones(shape[0]), np.ones(shape[1])
    asked = met = [np.zeros(n) for n in shape]
    if goal > 0:
        there = [np.array([named[x] for x in names], float), None]
        want = [languages or tempered(dict(named), power), None]
        for step in range(rounds):
            clipped, free, every = sums(b, g)
            if not step:
                there[1] = every.sum(0)
                want[1] = topics or tempered(dict(zip(kinds, there[1].tolist(), strict=True)), power)
                asked = [np.array([w.get(k, 0.0) for k in keys]) * goal for w, keys in zip(want, (names, kinds), strict=True)]
                target = [within(x, t) for x, t in zip(asked, there, strict=True)]
            met = [(clipped + free).sum(1), (clipped + free).sum(0)]
            if max((np.abs(x - t) / np.maximum(t, 1e-4 * goal)).max() for x, t in zip(met, target, strict=True)) < close:
                break
            for axis, f in ((1, b), (0, g)):
                fixed, loose, aim = clipped.sum(axis), free.sum(axis), target[1 - axis]
                turn = np.where(aim <= 0, 0.0, np.clip(np.divide(aim - fixed, loose, out=np.ones_like(loose), where=loose > 0), 0.5, 4.0))
                f *= turn
                free = free * (turn[:, None] if axis else turn)

    def last(batches):
        for batch in batches:
            a, e = [], []
            for c, target in zip(batch.column("c").to_pylist(), batch.column("target").to_pylist(), strict=True):
                i, j, t = here(c)
                a.append(solved(t, b[i] * g[j], target))
                e.append(float((t * np.minimum(1.0, a[-1] * b[i] * g[j])).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(a, pa.float64()), batch.column("target"), pa.array(e, pa.float64())], names=["source", "factor", "target", "expected"])

    margins = {}
    if goal > 0:
        for kind, keys, x, y, z in zip(("lang", "topic"), (names, kinds), asked, target, met, strict=True):
            margins |= {(kind, k): v for k, *v in zip(keys, x.tolist(), y.tolist(), z.tolist(), strict=True)}
    fit = written(rows.mapInArrow(last, "source string, factor double, target double, expected double"), "fit")
    return Mix(fit, dict(zip(names, b.tolist(), strict=True)), dict(zip(kinds, g.tolist(), strict=True)), margins)


def mix(docs: DataFrame, fraction: float = 0.5, power: float = 0.7, languages: dict[str, float] | None = None, topics: dict[int, float] | None = None, sources: dict[str, float] | None = None, seed: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) to doc_id, source, lang, topic, n_tokens, weight, probability and sampled, one row for each row given.

    probability is min(1, weight), the weight being the product of the document's source, language and topic factors, by which `fraction` of the tokens is expected, in the target shares;
    sampled is drawn by a hash of doc_id (of the text where it is null) and seed, the same in every run and for repeated rows. Columns of docs to carry come last, CARRIED before their names.
    Null languages and sources are the empty name. Texts without words have the probability of their cell too, 0 if its source has no tokens. Targets that cannot be met are lowered as
    `rake` says. A sampling operator: what is not sampled is left to the caller. An empty table gives no rows.
    """
    facts = written(text_facts(docs, fit_topics(docs), carry), "facts")
    found = rake(facts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), fraction, power, languages, topics, sources)
    spark = docs.sparkSession
    # At most MOST_LANGUAGES + 1 rows. Rows of an Arrow table need no Python worker; a list would start a second set of them in every executor.
    of_lang = spark.createDataFrame(pa.table({"lang": pa.array(found.languages, pa.string()), "of_lang": pa.array(found.languages.values(), pa.float64())}), "lang string, of_lang double")
    others, none = F.lit(found.languages.get(OTHERS, 0.0)), F.lit(0.0)
    of_topic = F.coalesce(*(F.when(F.col("topic") == k, F.lit(v)) for k, v in found.topics.items()), none)
    out = facts.join(found.sources.select("source", "factor"), "source", "left").join(F.broadcast(of_lang), "lang", "left")
    weight = F.coalesce("factor", none) * F.coalesce("of_lang", others) * of_topic
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", "mark"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out = out.withColumn("weight", weight).withColumn("probability", F.least(F.lit(1.0), F.col("weight")))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("sampled"), *(CARRIED + c for c in carry))
