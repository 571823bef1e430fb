"""Least values of ranges: per group a sparse table of minima (of 1, 2, 4, ... points from each one on), in which a range of any length is the lesser of two entries.

Points and probes meet by one shuffle by their keys, sorted so that a group's points come before its probes. A task reads them in Arrow batches and keeps the points of one group, so probes of a group may be any number; the tables of all
groups of a batch are built and asked at once. n points and m probes cost n * log(n) + m * log(n), whatever the ranges hold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def numbers_of_groups(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """0, 0, 1, ...: rises by one where a key of sorted rows changes."""
    change = np.zeros(len(table), bool)
    for k in keys:
        code = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        change[1:] |= code[1:] != code[:-1]
    return np.cumsum(change)


def lowest(group: np.ndarray, place: np.ndarray, value: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each probe (at: its group) the least value of the group's points with lo <= place <= hi; infinite if there is none. Points are sorted by group."""
    n, m = len(place), len(at)
    order = np.lexsort((place, group))
    place, value, group = place[order], value[order], group[order]
    # Ends and points in one order: how many points stand before an end is its position.
    which = np.concatenate([at, group, at])
    tag = np.repeat([0, 1, 2], [m, n, m])
    line = np.lexsort((tag, np.concatenate([lo, place, hi]), which))
    before = np.empty(n + 2 * m, np.int64)
    before[line] = np.cumsum(tag[line] == 1)
    a, b = before[:m], before[m + n :]
    out = np.full(m, np.inf)
    full = np.flatnonzero((b > a) & ~np.isnan(lo) & ~np.isnan(hi))
    if not len(full):
        return out
    level = np.frexp((b - a)[full].astype(float))[1] - 1
    table, size = value, 1
    for k in range(int(level.max()) + 1):
        asked = full[level == k]
        out[asked] = np.minimum(table[a[asked]], table[b[asked] - size])
        table, size = np.minimum(table[:-size], table[size:]) if len(table) > size else table[:0], 2 * size
    return out


def least_in_range(points: DataFrame, probes: DataFrame, keys: Sequence[str], place: str = "dist", value: str = "angle", name: str = "low") -> DataFrame:
    """Adds `name` (double) to probes (keys, lo, hi, ...): the least value of the points (keys, place, value) with the same keys and lo <= place <= hi; null if there is none, or if lo or hi is null.

    One row for each probe given, repeated ones too; points without a place or value do not count, and null keys are a group of their own.
    """
    keys, names = list(keys), probes.columns
    line = points.filter(F.col(place).isNotNull() & F.col(value).isNotNull()).select(*(F.col(k).cast(probes.schema[k].dataType).alias(k) for k in keys), F.lit(0).alias("_probe"), F.col(place).cast("double").alias("_place"), F.col(value).cast("double").alias("_value"))
    asked = probes.select("*", F.lit(1).alias("_probe"), F.col("lo").cast("double").alias("_lo"), F.col("hi").cast("double").alias("_hi"))
    both = asked.unionByName(line, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_probe")

    def run(batches):
        kept: pa.Table | None = None  # the points of the last group
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            if not len(table):
                continue
            group, probe = numbers_of_groups(table, keys), table.column("_probe").to_numpy() == 1
            of = lambda c, where, t=table: t.column(c).to_numpy()[where].astype(np.float64)
            low = lowest(group[~probe], of("_place", ~probe), of("_value", ~probe), group[probe], of("_lo", probe), of("_hi", probe))
            out = table.filter(pa.array(probe)).select(names).append_column(name, pa.array(low, mask=np.isinf(low)))
            kept = table.filter(pa.array(~probe & (group == group[-1])))
            yield from out.to_batches()

    return both.mapInArrow(run, StructType([*probes.schema.fields, StructField(name, DoubleType())]))
