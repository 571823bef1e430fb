"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes and inner n-grams (byte n-grams of the lower-cased word between two end marks, hashed) and its entry in a lexicon of the training words.
Transitions between the languages of neighbouring words are learned with them, on sequences that switch between languages. Forward-backward gives every word's
label distribution, also in code-switched text; a document's language is the one with the largest share of its letters.

Memory follows neither a text's length times the number of languages nor the training sample's: features are taken of a part of the words at a time, training goes in small steps, and with many
languages a text goes through forward-backward block by block, from the vectors at the blocks' borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices
from .words import Words, mix, text_bytes

ORDERS, DIMENSION, CHUNK = (1, 2, 3, 4, 5), 1 << 16, 32
#: Up to so many languages chunks run side by side; beyond it, whole texts do, in blocks of about so many numbers, and features have FEWER places.
SIDE_BY_SIDE, BLOCK, FEWER = 16, 1 << 20, 1 << 14
FIRST, LAST = 2, 3  # marks of a word's ends
LETTER = re.compile(r"[^\W\d_]")
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True  # a lead byte stands for its character


def ngram_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words given by byte positions: all of them word by word, and where each word's begin. dimension: a power of two."""
    length = ends - starts + 2
    begin = np.cumsum(length) - length
    total = int(length.sum())
    place = np.arange(total) - np.repeat(begin, length)
    text = data[np.clip(np.repeat(starts, length) + place - 1, 0, max(0, len(data) - 1))].astype(np.uint64) if len(data) else np.zeros(total, np.uint64)
    text[begin], text[begin + length - 1] = FIRST, LAST
    left = np.repeat(length, length) - place
    out = np.zeros((total, len(ORDERS)), np.int32)
    h = np.zeros(total, np.uint64)
    for k, n in enumerate(ORDERS):
        h[: total - n + 1] = mix(h[: total - n + 1] * np.uint64(31) + text[n - 1 :] + np.uint64(n))
        out[:, k] = (h & np.uint64(dimension - 1)).astype(np.int32)
        out[left < n, k] = dimension  # a row of zeros
    return out.reshape(-1), begin * len(ORDERS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features + 1, languages), the last row zero
    lexicon: np.ndarray  # sorted word hashes
    odds: np.ndarray  # (words, languages) clipped log odds of the lexicon's words
    mixing: np.ndarray  # (languages, languages) from odds to scores
    steps: np.ndarray  # (languages, languages) transition scores

    def scores(self, data, starts, ends, hashes) -> np.ndarray:
        s = np.zeros((len(starts), len(self.languages)), np.float32)
        many = max(64, min(8192, (1 << 16) // max(1, len(self.languages))))
        for at in range(0, len(starts), many):  # a part of the words at a time: their features take a hundred times a word's place
            part = slice(at, at + many)
            flat, begin = ngram_features(data, starts[part], ends[part], len(self.weights) - 1)
            s[part] = np.add.reduceat(self.weights[flat], begin, axis=0)
        return s + self.lexicon_odds(hashes) @ self.mixing

    def lexicon_odds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.odds[at] * (self.lexicon[at] == hashes)[:, None]


def forward(e: np.ndarray, live: np.ndarray, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised forward vectors (chunk, place, label) from a start vector for each chunk; where not live, the vector stays."""
    out, now = np.empty_like(e), start
    for t in range(e.shape[1]):
        new = (now @ steps) * e[:, t]
        new /= new.sum(-1, keepdims=True)
        now = np.where(live[:, t, None], new, now)
        out[:, t] = now
    return out


def backward(e: np.ndarray, live: np.ndarray, steps: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Normalised backward vectors: at each place, of what follows it."""
    out, now = np.empty_like(e), end
    for t in range(e.shape[1] - 1, -1, -1):
        out[:, t] = now
        new = (now * e[:, t]) @ steps.T
        new /= new.sum(-1, keepdims=True)
        now = np.where(live[:, t, None], new, now)
    return out


def transfer(e: np.ndarray, live: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For each chunk the matrix that takes the vector before it to the one after it, up to a factor."""
    k = len(steps)
    now = np.broadcast_to(np.eye(k, dtype=e.dtype), (len(e), k, k)).copy()
    for t in range(e.shape[1]):
        new = (now @ steps) * e[:, t, None, :]
        new /= new.sum((1, 2), keepdims=True)
        now = np.where(live[:, t, None, None], new, now)
    return now


def marginals(e: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Exact label distributions of all words of all texts; e: (words, labels) factors, first: where each text's words begin, with the end.

    Texts are cut into chunks that work side by side: a matrix for each chunk carries the vectors across, then chunks are filled in.
    """
    n, k = e.shape
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    base = np.concatenate([[0], np.cumsum(chunks)])
    number = np.arange(base[-1]) - np.repeat(base[:-1], chunks)
    begin = np.repeat(first[:-1], chunks) + number * CHUNK
    place = begin[:, None] + np.arange(CHUNK)
    live = place < np.repeat(first[1:], chunks)[:, None]
    x = np.where(live[:, :, None], e[np.minimum(place, max(0, n - 1))], 1) if n else np.zeros((0, CHUNK, k), e.dtype)
    across = transfer(x, live, steps)
    before, after = np.full((len(x), k), 1 / k, e.dtype), np.full((len(x), k), 1 / k, e.dtype)
    order = np.argsort(-chunks, kind="stable")
    sizes = chunks[order]
    for j in range(1, int(sizes[0]) if len(sizes) else 0):
        at = base[order[: np.searchsorted(-sizes, -j, "left")]] + j
        v = np.einsum("nk,nkl->nl", before[at - 1], across[at - 1])
        before[at] = v / v.sum(-1, keepdims=True)
    for j in range(int(sizes[0]) - 2 if len(sizes) else -1, -1, -1):
        at = base[order[: np.searchsorted(-sizes, -(j + 1), "left")]] + j
        v = np.einsum("nl,nkl->nk", after[at + 1], across[at + 1])
        after[at] = v / v.sum(-1, keepdims=True)
    p = forward(x, live, steps, before) * backward(x, live, steps, after)
    p /= p.sum(-1, keepdims=True)
    return p[live]


def marginals_in_blocks(e: np.ndarray, which: np.ndarray, first: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What `marginals` gives of e[which], as (first word, distributions of the words from it on), text by text and block by block from each text's end: only the vectors at borders are kept."""
    k = e.shape[1]
    size = max(16, BLOCK // k)
    even = np.full((1, k), 1 / k, e.dtype)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        borders, vectors = list(range(a, b, size)), [even]
        live = np.ones((1, size), bool)
        for at in borders[:-1]:
            vectors.append(forward(e[which[at : at + size]][None], live, steps, vectors[-1])[:, -1])
        after = even
        for at, before in zip(reversed(borders), reversed(vectors), strict=False):
            x = e[which[at : min(b, at + size)]][None]
            back = backward(x, live[:, : x.shape[1]], steps, after)
            p = forward(x, live[:, : x.shape[1]], steps, before) * back
            yield at, (p / p.sum(-1, keepdims=True))[0]
            after = (back[:, 0] * x[:, 0]) @ steps.T
            after = after / after.sum(-1, keepdims=True)


def word_marginals(model: Model, column: pa.Array) -> tuple[Words, Iterator[tuple[int, np.ndarray]]]:
    """The words of all texts, and (first word, label distributions of the words from it on) until each word has had its own."""
    w = Words(column, lower=True)
    if not model.languages:
        return w, iter([(0, np.zeros((len(w.starts), 0), np.float32))])
    distinct, where, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    s = model.scores(w.data, w.starts[where], w.ends[where], distinct)
    e = np.exp(s - s.max(-1, keepdims=True)).astype(np.float32) if len(s) else s.astype(np.float32)
    e = np.maximum(e, 1e-6)
    letters = np.concatenate([[0], np.cumsum(IS_LETTER[w.data])])
    e[(letters[w.ends[where]] - letters[w.starts[where]]) == 0] = 1  # no letters, no evidence
    steps = np.exp(model.steps).astype(np.float32)
    if len(model.languages) > SIDE_BY_SIDE:
        return w, marginals_in_blocks(e, inverse, w.first, steps)
    return w, iter([(0, marginals(e[inverse], w.first, steps))])


def predict(model: Model, column: pa.Array) -> list[tuple[str, float]]:
    """The language of each text and its share of the letters."""
    return [x[:2] for x in judged(model, column)]


def judged(model: Model, column: pa.Array) -> list[tuple[str, float, float]]:
    """The language of each text, its share of the letters, and the evidence for any language: the mean over the letters of the likeliest language of their word, whichever it is."""
    w, parts = word_marginals(model, column)
    letters = np.concatenate([[0], np.cumsum(IS_LETTER[w.data])])
    weight = (letters[w.ends] - letters[w.starts]).astype(np.float64)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    share, sure = np.zeros((len(w.counts), len(model.languages))), np.zeros(len(w.counts))
    for at, p in parts:
        if p.size:
            here, by = text[at : at + len(p)], weight[at : at + len(p)]
            begin = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            share[here[begin]] += np.add.reduceat(p * by[:, None], begin)
            sure[here[begin]] += np.add.reduceat(p.max(1) * by, begin)
    total = np.bincount(text, weight, len(w.counts))
    out = []
    for i, t in enumerate(column.to_pylist()):
        if not model.languages or not t or not LETTER.search(t):
            out.append(("und", 0.0, 0.0))
            continue
        best = int(np.argmax(share[i]))
        out.append((model.languages[best], *(min(1.0, max(0.0, float(y / max(total[i], 1.0)))) for y in (share[i, best], sure[i]))))
    return out


def train(samples: list[tuple[str, str]], rounds: int = 240, length: int = 48, batch: int = 96, seed: int = 7) -> Model:
    """A model of (language, passage) samples; sequences are made of runs of 4 to 24 words of one language after another, and each of `rounds` steps takes a batch of them."""
    rng = np.random.default_rng(seed)
    samples = sorted((lang, text) for lang, text in samples if LETTER.search(text))
    languages = sorted({lang for lang, _ in samples})
    k = len(languages)
    size = DIMENSION if k <= SIDE_BY_SIDE else FEWER
    zero = np.zeros((0,), np.uint64)
    model = Model(languages, np.zeros((size + 1, k), np.float32), zero, np.zeros((0, k), np.float32), np.eye(k, dtype=np.float32) * 0.5, np.zeros((k, k), np.float32))
    if not samples:
        return model
    number = {x: i for i, x in enumerate(languages)}
    data, starts, ends, hashes, first, at = [], [], [], [], [0], 0
    for a in range(0, len(samples), 128):  # a few passages at a time, to keep the driver's memory low
        w = Words(pa.array([t for _, t in samples[a : a + 128]]), lower=True)
        hashes.append(w.hashes())
        data.append(w.data)
        starts.append(w.starts + at)
        ends.append(w.ends + at)
        first += (first[-1] + w.first[1:]).tolist()
        at += len(w.data)
    data, starts, ends, hashes = (np.concatenate(x) for x in (data, starts, ends, hashes))
    label = np.repeat([number[x] for x, _ in samples], np.diff(first))
    distinct, where, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    known = count >= 3
    place = np.cumsum(known) - 1
    by = np.zeros((int(known.sum()), k), np.float32)
    seen = known[inverse]
    np.add.at(by, (place[inverse[seen]], label[seen]), 1)
    rate = (by + 0.2) / (np.bincount(label, minlength=k) + 0.2)
    model.lexicon, model.odds = distinct[known], np.clip(np.log(rate / rate.mean(-1, keepdims=True)), -3, 3).astype(np.float32)

    runs = []  # (first word, words) of one language
    for a, b in zip(first[:-1], first[1:], strict=True):
        while a < b:
            n = int(rng.integers(4, 25))
            runs.append((a, min(b, a + n) - a))
            a += n
    word = np.concatenate([np.arange(runs[i][0], runs[i][0] + runs[i][1]) for i in rng.permutation(len(runs))])
    word = np.resize(word, max(1, len(word) // length) * length).reshape(-1, length)
    params = [model.weights, model.mixing, model.steps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    order = np.zeros(0, np.int64)
    for step in range(1, rounds + 1):
        if len(order) < min(batch, len(word)):
            order = np.concatenate([order, rng.permutation(len(word))])
        rows, order = word[order[:batch]], order[batch:]
        here, spot = np.unique(inverse[rows], return_inverse=True)
        spot, truth, live = spot.reshape(rows.shape), label[rows], np.ones(rows.shape, bool)
        flat, begin = ngram_features(data, starts[where[here]], ends[where[here]], size)
        sizes = np.diff(np.append(begin, len(flat)))
        parts = np.searchsorted(begin, np.arange(0, len(flat), max(256, (1 << 20) // k)))
        parts = [*np.unique(parts).tolist(), len(here)]
        parts = [(a, b, slice(begin[a], begin[b] if b < len(here) else len(flat))) for a, b in zip(parts[:-1], parts[1:], strict=True) if a < b]
        lex = model.lexicon_odds(distinct[here])
        s = np.concatenate([np.add.reduceat(model.weights[flat[c]], begin[a:b] - begin[a], axis=0) for a, b, c in parts]) + lex @ model.mixing
        e = np.maximum(np.exp(s - s.max(-1, keepdims=True)), 1e-6)[spot]
        trans, even = np.exp(model.steps), np.full((len(rows), k), 1 / k, np.float32)
        f, g = forward(e, live, trans, even), backward(e, live, trans, even)
        p = f * g
        p /= p.sum(-1, keepdims=True)
        before, after = f[:, :-1].reshape(-1, k), (e[:, 1:] * g[:, 1:]).reshape(-1, k)
        pairs = trans * ((before / ((before @ trans) * after).sum(-1, keepdims=True)).T @ after)  # expected transitions
        np.add.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), -1)
        p[np.arange(len(rows))[:, None], np.arange(length), truth] -= 1
        at = np.zeros((len(here), k), np.float32)
        np.add.at(at, spot.ravel(), p.reshape(-1, k))
        at /= rows.size
        slope = 1e-6 * model.weights
        for j in range(k):
            slope[:, j] += np.bincount(flat, np.repeat(at[:, j], sizes), size + 1)
        slope[-1] = 0
        pace = 0.1 * (1 - step / (rounds + 1)) + 0.005
        for q, grad, (m, v) in zip(params, [slope, lex.T @ at, pairs / rows.size], moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            q -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def training_samples(docs: DataFrame, per_language: int = 400, words: int = 120, languages: int = 512, most: int = 6000) -> list[tuple[str, str]]:
    """A bounded sample: about per_language rows of each lang (null left out), fewer if there are so many languages that it would be over `most` rows, chosen by a hash of doc_id, and of each
    a passage of at most `words` words, cut to 200 characters each, from a place that the hash chooses. Of more than `languages` labels those with most rows, then the smaller ones, are learned."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, most // len(counts)))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.2 * per_language / n) * (1 << 30)))))
    hashed = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "lang"), F.lit(1 << 30))
    chosen = known.filter(hashed < share[F.col("lang")]).withColumn("at", hashed)  # null, so out, for a label that is not learned

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for lang, text, at in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "at")), strict=True):
                parts = text.split()
                a = int(at) % max(1, len(parts) - words + 1)
                rows.append((lang, " ".join(p[:200] for p in parts[a : a + words])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["lang", "passage"])

    passages = chosen.mapInArrow(cut, "lang string, passage string")
    return [(r["lang"], r["passage"]) for r in passages.limit(2 * per_language * len(counts)).collect()]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, lang_pred and score, one row for each row given.

    A text that is null or has no letter is `und` with score 0, and so is every text if the model has no language. Other columns are not read. No rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            found = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) to one row per text: doc_id, words (array of word, lang, score), for code-switched text; und where a word has no letter. Nulls have no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])))])

    def run(batches):
        for batch in slices(batches):
            w, parts = word_marginals(model, batch.column("text"))
            best, sure = np.zeros(len(w.starts), np.int64), np.zeros(len(w.starts))
            for at, p in parts:
                if p.size:
                    best[at : at + len(p)], sure[at : at + len(p)] = p.argmax(1), p.max(1)
            raw, _ = text_bytes(batch.column("text"))
            rows = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                words = [raw[x:y].tobytes().decode() for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)]
                rows.append([{"word": t, "lang": model.languages[q] if model.languages and LETTER.search(t) else "und", "score": s} for t, q, s in zip(words, best[a:b].tolist(), sure[a:b].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, schema.field("words").type)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, words array<struct<word string, lang string, score double>>")
