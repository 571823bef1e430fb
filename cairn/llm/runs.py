"""Runs: stretches of words that repeat themselves, found online by catchers over completed power-of-two blocks.

When a block of B = 2^k words is complete, it becomes a catcher. Every word appended after it completes one more suffix of B words, and the catcher compares itself with that suffix, for distances from B to
2B - 1; a hit at distance p says that the block's words are the same p words later. Hits of neighbouring blocks at one distance cover more than p words and so are a square; squares that overlap at one
distance merge into a run, which is then drawn out word by word to both sides. A run of period p and at least 4p words holds two blocks in a row of the B with B <= p < 2B, wherever blocks begin, so
nothing is missed. Squares whose period is a multiple of a known run's lie within that run (Fine and Wilf) and are dropped before they are counted, so periods are smallest ones.

All texts of an Arrow batch are appended as one stream with a mark of its own between texts, which no suffix can cross, and the comparisons of all words of a level are one array operation: time is
words x log(words of the longest text). Suffixes are compared by 64-bit names made of two names of half the length; every hit is confirmed word by word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices
from .words import Words, mix

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
STEP = 64


def word_numbers(column: pa.Array) -> tuple[np.ndarray, Words]:
    """A number for each word of all texts, equal for equal words, and where the words are."""
    w = Words(column)
    length = w.ends - w.starts
    data = w.data[w.inside]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), w


def draw_out(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many words in a row, from position `at` on in steps of `step`, equal the word one period later."""
    out, live = np.zeros(len(at), np.int64), np.arange(len(at))
    ahead = step * np.arange(STEP)
    while len(live):
        x = (at[live] + step * out[live])[:, None] + ahead
        y = x + period[live][:, None]
        same = (x >= 0) & (y < len(words))
        same &= words[np.where(same, x, 0)] == words[np.where(same, y, 0)]
        many = np.where(same.all(1), STEP, (~same).argmax(1))
        out[live] += many
        live = live[many == STEP]
    return out


def ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (many[i] numbers), one after another."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)


class Known:
    """Runs found so far; says which stretches lie within one."""

    def __init__(self):
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        order = np.argsort(start := np.concatenate([self.start, start]), kind="stable")
        self.start, self.end, self.period = start[order], np.concatenate([self.end, end])[order], np.concatenate([self.period, period])[order]
        self.reach = np.maximum.accumulate(self.end)

    def holds(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        return (at >= 0) & (self.reach[np.maximum(at, 0)] >= end)


def catch(words: np.ndarray, sizes: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of all runs of at least `times` (4 or more) periods, of texts of `sizes` words that stand one after another in `words` (whole numbers from 0 on); by start, then period."""
    if times < 4:
        raise ValueError("two neighbouring blocks lie in every run only from four periods on")
    first = np.cumsum(sizes) - sizes
    known, block = Known(), 1
    texts = np.flatnonzero(sizes >= times)
    stream = name = place = None
    while len(texts):
        if stream is None or (many := int(sizes[texts].sum())) < 0.7 * len(stream):  # texts too short for this level leave
            many = sizes[texts] + 1
            place = ranges(first[texts], many)  # a text's last place is its mark's
            marks = np.cumsum(many) - 1
            place[marks] = -1
            stream = words[place]
            stream[marks] = -1 - np.arange(len(marks))
            name, size = stream.view(np.uint64), 1
            while size < block:
                name, size = doubled(name, size), 2 * size
        elif block > 1:
            name = doubled(name, block // 2)
        rows = -(-len(name) // block)
        if rows > 1:
            filled = np.concatenate([name, np.zeros(rows * block - len(name), np.uint64)]) if len(name) % block else name
            grid = filled.reshape(rows, block)  # row j: the block that begins at j * block, then the suffixes that the catcher before it meets
            catcher, shift = np.divmod(np.flatnonzero(grid[1:] == grid[:-1, :1]), block)
            add = squares(stream, place, catcher, shift, block, times, known)
            if add:
                known.add(*add)
        block *= 2
        texts = texts[sizes[texts] >= times * block]
    order = np.lexsort((known.period, known.start))
    return known.start[order], (known.end - known.start)[order], known.period[order]


def doubled(name: np.ndarray, size: int) -> np.ndarray:
    """Names of all stretches of twice the size."""
    return mix(name[:-size] * np.uint64(0x9E3779B97F4A7C15) + name[size:] + np.uint64(size)) if len(name) > size else name[:0]


def squares(stream, place, catcher, shift, block, times, known):
    """Merges the hits of a level to runs that are not known yet: start, end and period by place, or None."""
    start, period = catcher * block, block + shift
    new = ~known.holds(place[start], place[start] + period + block)
    start, period = start[new], period[new]
    inside = start + period + block <= len(stream)
    start, period = start[inside], period[inside]
    at = ranges(start, np.full(len(start), block))  # names may be equal by chance
    same = (stream[at] == stream[at + np.repeat(period, block)]).reshape(-1, block).all(1)
    start, period = start[same], period[same]
    if not len(start):
        return None
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    head = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (start[1:] != start[:-1] + block)))
    many = np.diff(np.append(head, len(start))) * block
    start, period = start[head], period[head]
    hope = many + 2 * (block - 1) >= (times - 1) * period
    start, period, many = start[hope], period[hope], many[hope]
    left = draw_out(stream, start - 1, period, -1)
    right = draw_out(stream, start + many, period, 1)
    start, many = start - left, many + left + right
    long = many >= (times - 1) * period
    start, period, many = start[long], period[long], many[long]
    return (place[start], place[start] + many + period, period) if len(start) else None


def collapsed(text: bytes, order: list[int] | None, gone: np.ndarray | None) -> bytes:
    """The text's words joined by one space, taken in `order` and without those that are `gone`."""
    words = text.split()
    if order is not None:
        words = [words[i] for i in order]
    if gone is not None:
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, runs (array of start, length and period, by start, then period; word numbers) and collapsed: the words joined by one space, each run cut to its first period.

    A word is a run of characters other than space and the characters 9 to 13. A run is a stretch of at least `least` words and `times` (4 or more) of its smallest period that no neighbouring word extends. With `order`, the words
    are first put in the order that order(doc_id, number of words) gives: for each place the number of the word that goes there (none: as they are).

    One row for each row given, repeated ones too; a null or empty text, or one without words, has no runs and collapses to an empty text. doc_id may be null. Other columns are not read. No rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def run(batches):
        for batch in slices(batches):
            ids, w = word_numbers(batch.column("text"))
            first = w.first.tolist()
            orders = [order(d, n) if n and order else None for d, n in zip(batch.column("doc_id").to_pylist(), w.counts.tolist(), strict=True)]
            for i, o in enumerate(orders):
                if o is not None:
                    ids[first[i] : first[i + 1]] = ids[first[i] : first[i + 1]][o]
            start, length, period = catch(ids, w.counts, times)
            kept = length >= np.maximum(least, times * period)
            start, length, period = start[kept], length[kept], period[kept]
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            gone = np.cumsum(gone)[:-1] > 0
            of = np.searchsorted(w.first[1:], start, "right")
            cut = np.searchsorted(of, np.arange(len(orders) + 1)).astype(np.int32)
            data, at = w.data.tobytes(), w.at.tolist()
            short = [collapsed(data[at[i] : at[i + 1]], None if o is None else o.tolist(), gone[first[i] : first[i + 1]] if cut[i] < cut[i + 1] else None) for i, o in enumerate(orders)]
            runs = pa.StructArray.from_arrays([pa.array(start - w.first[of]), pa.array(length), pa.array(period)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut), runs), pa.array(short, pa.binary()).cast(pa.string())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")
