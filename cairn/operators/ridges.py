"""Ridgelines: crests of neighbouring rays linked one to one, chained around the circle; and rings stitched from open lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

#: Relative distance and angle (degrees) within which crests link; span of a ridge (degrees).
NEAR, LEVEL, SPAN = 0.06, 0.3, 0.5
#: More than there are crests on a ray.
CRESTS = 100_000


def links(crest: DataFrame, rays: int) -> DataFrame:
    """(scene, ray, seq, next_ray, next_seq): of each pair of neighbouring rays the links of least cost first, each crest used once. Pairs of rays are independent; the last ray meets ray 0."""
    a = crest.select("scene", F.pmod(F.col("ray") + 1, F.lit(rays)).alias("ray2"), "ray", "seq", "dist", "angle")
    b = crest.select("scene", F.col("ray").alias("ray2"), F.col("seq").alias("seq2"), F.col("dist").alias("dist2"), F.col("angle").alias("angle2"))
    rel = F.abs(F.col("dist") - F.col("dist2")) / F.least("dist", "dist2")
    turn = F.abs(F.col("angle") - F.col("angle2"))
    met = a.join(b, ["scene", "ray2"]).withColumn("rel", rel).withColumn("turn", turn).filter((F.col("rel") < NEAR) & (F.col("turn") < LEVEL))
    met = met.withColumn("cost", F.col("rel") / NEAR + F.col("turn") / LEVEL).select("scene", "ray", "ray2", "seq", "seq2", "cost").withColumn("block", F.floor(F.col("ray") / 16))

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ray", "cost", "seq2", "seq"], kind="stable")
        from_, to = (part["ray"].to_numpy(np.int64) * CRESTS + part[c].to_numpy(np.int64) for c in ("seq", "seq2"))
        left, keep = np.arange(len(part)), []
        while len(left):  # the first link of both its crests is sure; links of crests that have one go
            a, b = from_[left], to[left]
            first = np.zeros(len(left), bool)
            first[np.intersect1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])] = True
            keep.append(left[first])
            left = left[~np.isin(a, a[first]) & ~np.isin(b, b[first])]
        out = part.iloc[np.concatenate(keep)][["scene", "ray", "seq", "ray2", "seq2"]]
        return out.set_axis(["scene", "ray", "seq", "next_ray", "next_seq"], axis=1)

    return met.groupBy("scene", "block").applyInPandas(greedy, "scene long, ray int, seq int, next_ray int, next_seq int")


def _heads(nodes: DataFrame, prev: DataFrame, rounds: int) -> DataFrame:
    """(scene, id, head, place): the first node of each path and the steps to it, by pointer doubling; prev(scene, id, prev) has one row at most for an id, and no cycles."""
    at = nodes.join(prev, ["scene", "id"], "left").select("scene", "id", F.coalesce("prev", "id").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("place"))
    steps = None
    for _ in range(rounds):
        far = at.select("scene", F.col("id").alias("head"), F.col("head").alias("head2"), F.col("place").alias("place2"))
        at = written(at.join(far, ["scene", "head"]).select("scene", "id", F.col("head2").alias("head"), (F.col("place") + F.col("place2")).alias("place")), "heads")
        before, steps = steps, at.agg(F.sum("place")).first()[0]
        if steps == before:
            break
    return at


def ridgelines(crest: DataFrame, rays: int) -> DataFrame:
    """(scene, ridge, place, ray, seq, dist, angle): chains of linked crests of at least SPAN degrees, numbered by their first crest.

    Chains run from ray 0 up; a chain that ends on the last ray goes on in the one that it links to on ray 0, unless that is itself. In a circle of several chains the lowest comes first.
    """
    crest = written(crest.select("scene", F.col("ray").cast("int").alias("ray"), F.col("seq").cast("int").alias("seq"), "dist", "angle"), "crests")
    number = lambda ray, seq: (F.col(ray).cast("long") * CRESTS + F.col(seq)).alias("id")
    link = written(links(crest, rays), "links")
    nodes = crest.select("scene", number("ray", "seq"))
    prev = link.filter("next_ray > 0").select("scene", number("next_ray", "next_seq"), number("ray", "seq").alias("prev"))
    rounds = max(1, math.ceil(math.log2(rays)))
    chain = _heads(nodes, prev, rounds)
    size = chain.groupBy("scene", "head").agg(F.count("*").alias("n"))
    seam = link.filter("next_ray = 0").select("scene", number("ray", "seq"), number("next_ray", "next_seq").alias("to"))
    over = seam.join(chain.select("scene", "id", "head"), ["scene", "id"]).filter("head <> to").select("scene", F.col("to").alias("id"), F.col("head").alias("prev"))
    # Each chain on ray 0 has one chain before it at most; a circle of chains is cut before its lowest.
    over = written(over, "seams")
    low = over.select("scene", "id", "prev", F.col("id").alias("low"))
    for _ in range(rounds):
        step = low.select("scene", F.col("id").alias("prev"), F.col("prev").alias("prev2"), F.col("low").alias("seen"))
        low = written(low.join(step, ["scene", "prev"], "left").select("scene", "id", F.coalesce("prev2", F.lit(-1)).alias("prev"), F.least("low", F.coalesce("seen", "low")).alias("low")), "lows")
        if not low.filter("prev >= 0").limit(1).count():  # no circle
            break
    circle = low.filter("prev >= 0 AND id = low").select("scene", "id")
    over = over.join(circle, ["scene", "id"], "left_anti")
    joined = _heads(size.select("scene", F.col("head").alias("id")), over, rounds)
    order = joined.join(size.withColumnRenamed("head", "id"), ["scene", "id"])
    before = F.sum("n").over(Window.partitionBy("scene", "head").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    order = order.select("scene", F.col("id").alias("chain"), F.col("head").alias("ridge"), F.coalesce(before, F.lit(0)).alias("base"))
    out = chain.select("scene", "id", F.col("head").alias("chain"), F.col("place").alias("p")).join(order, ["scene", "chain"]).withColumn("place", F.col("base") + F.col("p"))
    least = math.ceil(SPAN * rays / 360 - 1e-9) + 1
    out = out.withColumn("points", F.count("*").over(Window.partitionBy("scene", "ridge"))).filter(F.col("points") >= least)
    return out.join(crest.withColumn("id", number("ray", "seq")), ["scene", "id"]).select("scene", "ridge", "place", "ray", "seq", "dist", "angle")


def stitch(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from lines that share ends; what never closes is left out. The last open line grows first, at its end, by the first line that fits either way round."""
    closed = lambda r: len(r) >= 4 and r[0] == r[-1]
    rings, open_ = [p for p in parts if closed(p)], [p for p in parts if not closed(p) and len(p) >= 2]
    while open_:
        ring = open_.pop()
        while not closed(ring):
            k = next((k for k, p in enumerate(open_) if ring[-1] in (p[0], p[-1])), None)
            if k is None:
                break
            p = open_.pop(k)
            ring = ring + (p if p[0] == ring[-1] else p[::-1])[1:]
        if closed(ring):
            rings.append(ring)
    return rings


def stitched_rings(lines: DataFrame) -> DataFrame:
    """lines (id, part, x and y arrays) of each relation to its rings (id, ring, x, y). Relations are independent and bounded by their own lines; many share a task."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, own in part.groupby("id"):
            rings = stitch([list(zip(x, y, strict=True)) for x, y in own.sort_values("part")[["x", "y"]].itertuples(index=False)])
            rows += [(key, k, [p[0] for p in r], [p[1] for p in r]) for k, r in enumerate(rings)]
        return pd.DataFrame(rows, columns=["id", "ring", "x", "y"])

    spread = lines.select("id", "part", "x", "y", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("_g"))
    return spread.groupBy("_g").applyInPandas(lambda p: each(p.drop(columns="_g")), "id long, ring int, x array<double>, y array<double>")
