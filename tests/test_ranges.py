"""Least values of ranges against plain search, and the number of rows that they take."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import peaks, rays
from cairn.operators.ranges import least_in_range


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65, 300])
def test_equals_search(spark, n):
    rng = random.Random(n)
    points = [(g, rng.choice([float(rng.randrange(20)), rng.uniform(0, 20), None]), rng.choice([rng.uniform(-5, 5), -1.0, None])) for g in (0, 1) for _ in range(n if g == 0 else 3)]
    probes = [(g, i, *sorted((rng.uniform(-1, 21), float(rng.randrange(21))), reverse=rng.random() < 0.1), "x") for g in (0, 1, 2) for i in range(60)] + [(0, 99, None, 3.0, "y"), (0, 98, 3.0, None, "y"), (0, 7, 3.0, 3.0, "z"), (0, 7, 3.0, 3.0, "z"), (None, 5, 1.0, 2.0, "n")]
    p = spark.createDataFrame(points, "g int, dist double, angle double") if points else spark.createDataFrame([], "g int, dist double, angle double")
    q = spark.createDataFrame(probes, "g int, id int, lo double, hi double, angle string")
    got = sorted(map(tuple, least_in_range(p, q, ["g"]).collect()), key=str)
    low = lambda g, lo, hi: min((v for h, d, v in points if h == g and d is not None and v is not None and None not in (lo, hi) and lo <= d <= hi), default=None)
    assert got == sorted(((g, i, lo, hi, a, low(g, lo, hi)) for g, i, lo, hi, a in probes), key=str)


def test_bands_of_crests_equal_search(spark):
    rng = random.Random(3)
    crest = [(s, r, i, rng.uniform(0, 100), rng.uniform(-3, 3)) for s in (0, 1) for r in range(5) for i in range(rng.randint(0, 40))]
    probes = [(s, r, k, lo, lo + rng.uniform(0, 50)) for k, (s, r, lo) in enumerate((rng.randrange(3), rng.randrange(6), rng.uniform(-5, 100)) for _ in range(300))]
    c = spark.createDataFrame(crest, "scene int, ray int, seq int, dist double, angle double")
    q = spark.createDataFrame(probes, "scene int, ray int, id int, lo double, hi double")
    got = {tuple(r)[:3]: r["low"] for r in rays.lowest_in_band(c, q).collect()}
    assert got == {(s, r, k): min((a for t, u, _, d, a in crest if (t, u) == (s, r) and lo <= d <= hi), default=None) for s, r, k, lo, hi in probes}


def rows_of_plan(df):
    """Rows that windows, joins and explodes of the plan that ran have made."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal total
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            total += metrics.apply("numOutputRows").value()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return total


def test_rows_follow_points_and_probes(spark):
    """On one ray of n crests with n probes that each hold half of them, the rows grow as n * log n, where all pairs would grow with its square."""

    def rows(n):
        c = spark.range(n).select(F.lit(0).alias("scene"), F.lit(0).alias("ray"), F.col("id").cast("double").alias("dist"), F.col("id").cast("double").alias("angle"))
        q = spark.range(n).select(F.lit(0).alias("scene"), F.lit(0).alias("ray"), "id", (F.col("id") / 2).alias("lo"), (F.col("id") / 2 + n / 2).alias("hi"))
        return rows_of_plan(rays.lowest_in_band(c, q))

    small, large = rows(1000), rows(4000)
    assert 0 < small < 1000 * 100 and large < 6 * small


def test_prominence_equals_search(spark):
    rng, count = random.Random(5), 72
    crest = [(s, r, rng.uniform(500, 9000), rng.uniform(-2, 4)) for s in (0, 1) for r in range(count) for _ in range(rng.randint(0, 6))]
    sky = [(s, r, rng.uniform(0, 5)) for s in (0, 1) for r in range(count)]
    seen = [(i, rng.randrange(2), rng.uniform(0, 360), rng.uniform(600, 9000), rng.uniform(0, 6), rng.choice("ab")) for i in range(80)]
    seen += seen[:3]
    got = peaks.prominence(
        spark.createDataFrame(seen, "id int, scene int, az double, dist double, angle double, lo string"),
        spark.createDataFrame(crest, "scene int, ray int, dist double, angle double"),
        spark.createDataFrame(sky, "scene int, ray int, angle double"),
        count,
    )
    steps = int(peaks.WINDOW * count / 360 + 0.5)

    def want(i, s, az, dist, angle, _):
        at = int(az * count / 360 + 0.5)
        low = lambda side: min((a for t, r, d, a in crest for o in range(1, steps + 1) if t == s and r == (at + side * o) % count and dist * 0.7 <= d <= dist * 1.3), default=None)
        sides = [x for x in (low(-1), low(1)) if x is not None]
        base = max(sides) if sides else min(a for t, r, a in sky if t == s and any(r == (at + o) % count for o in range(-steps, steps + 1)))
        return i, round(max(0.0, angle - base), 9)

    assert sorted((r["id"], round(r["prominence"], 9)) for r in got.collect()) == sorted(want(*x) for x in seen)
    assert got.columns == ["id", "scene", "az", "dist", "angle", "lo", "prominence"]
