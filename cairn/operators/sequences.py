"""Places, prefix sums and exact selection within groups of any size: no task holds a group, and no array holds its values.

A window over a whole group is one task's work. Here rows are dealt by ranges of (keys, order), so that a large group takes many partitions; each has a sum of its own, and the sums of those before it are its base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

#: Of quantile sketches: their error is under one in so many of a group's rows, and the values between two of them that are sorted are about four times as many.
ACCURACY = 10_000


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of keys, each a group of its own where it is null."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[f"_{k}"])
    return out


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """df with, for each name of `sums`, the sum of that expression over the rows of the same keys up to this one in `order`; nulls add nothing. Rows equal in all of `order` come in any order.

    Two levels: sums within each range of rows, then the sums of all ranges before it (one row for each partition and group). Ranges are written, so that both levels see the same ones.
    Sums of doubles depend on where the ranges begin in their last digits; those of whole numbers do not.
    """
    taken = {"_part", *(f"_{k}" for k in keys), *(f"_{n}" for n in sums)} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} of the rows have names that running_sums uses")
    own = [c for c in df.columns if c not in sums]
    dealt = df.select(*own, *(F.coalesce(v, F.lit(0)).alias(f"_{n}") for n, v in sums.items())).repartitionByRange(*keys, *order)
    rows = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    total = rows.groupBy("_part", *keys).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums)).withColumnsRenamed({k: f"_{k}" for k in keys})
    before = Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("_part", *(f"_{k}" for k in keys), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(n) for n in sums))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *(F.sum(f"_{n}").over(within).alias(f"_own_{n}") for n in sums))
    met = local.join(base, (local["_part"] == base["_part"]) & _same(local, base, keys))
    return met.select(*(local[c] for c in own), *((local[f"_own_{n}"] + base[n]).alias(n) for n in sums))


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) among the rows of its keys in `order`, as row_number over the whole group."""
    return running_sums(df, keys, order, **{name: F.lit(1)})


def selected(df: DataFrame, keys: Sequence[str], value: str, **shares: float) -> DataFrame:
    """(keys, n, names...): per group the number n of its values and for each name the value at place floor(n * share), from 0, of the values in order (the last one beyond them). Nulls are no values; a group of nulls
    alone has n = 0 and nulls; NaN comes last. Without keys all rows are one group; without rows there is none.

    Three passes: a sketch brackets each place, a count tells how many values lie under and inside its bracket, and only those of the part that holds the place are put in order, equal ones as one row with their number.
    The sketch decides how many these are, never the result.
    """
    if not keys:
        return selected(df.withColumn("_all", F.lit(0)), ["_all"], value, **shares).drop("_all")
    names = list(shares)
    own = [f"_{k}" for k in keys]
    ends = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-2 / ACCURACY, 2 / ACCURACY)]
    rows = written(df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_v")), "values")
    sketch = rows.groupBy(*own).agg(F.count("_v").alias("n"), F.percentile_approx("_v", ends, ACCURACY).alias("_ends")).withColumnsRenamed({f"_{k}": k for k in keys})
    known = rows.filter("_v IS NOT NULL")
    v, end = F.col("_v"), lambda i: F.get("_ends", F.lit(i))
    met = lambda bounds: known.join(bounds, _same(bounds, known, keys))
    count = [F.struct(F.count_if(v < end(2 * j)).alias("under"), F.count_if(v <= end(2 * j + 1)).alias("to")).alias(f"_c{j}") for j in range(len(names))]
    counted = written(met(sketch).groupBy(*keys, "n", "_ends").agg(*count), "brackets")
    at = [F.least(F.floor(F.col("n") * F.lit(s)), F.col("n") - 1) for s in shares.values()]
    asked = []
    for j in range(len(names)):
        under, to, low, high = F.col(f"_c{j}.under"), F.col(f"_c{j}.to"), end(2 * j), end(2 * j + 1)
        part = F.when(at[j] < under, v < low).when(at[j] < to, (v >= low) & (v <= high)).otherwise(v > high)
        base = F.when(at[j] < under, 0).when(at[j] < to, under).otherwise(to)
        asked.append(F.when(part, F.struct(F.lit(j).alias("j"), (at[j] - base).alias("k"))))
    inside = met(counted).select(*keys, "_v", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("_x"))
    distinct = inside.groupBy(*keys, "_x", "_v").agg(F.count("*").alias("_many"))
    upto = F.sum("_many").over(Window.partitionBy(*keys, "_x").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = distinct.withColumn("_to", upto).filter((F.col("_to") > F.col("_x.k")) & (F.col("_to") - F.col("_many") <= F.col("_x.k")))
    found = hit.groupBy(*keys).agg(*(F.max(F.when(F.col("_x.j") == j, v)).alias(n) for j, n in enumerate(names))).withColumnsRenamed({k: f"_{k}" for k in keys})
    return sketch.join(found, _same(sketch, found, keys), "left").select(*(sketch[k] for k in keys), sketch["n"], *names)

