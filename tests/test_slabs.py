"""Points in polygons by slabs of edges against a plain search, and the rows that they take."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_ranges import rows_of_plan

from cairn.operators import vector

POINT, EDGE = "grid long, id long, e double, n double", "grid long, area long, rank long, e1 double, n1 double, e2 double, n2 double"


def ring(grid, area, corners):
    return [(grid, area, area % 3, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def inside(edges, e, n):
    return sum((n1 > n) != (n2 > n) and e < (e2 - e1) * (n - n1) / (n2 - n1) + e1 for _, _, _, e1, n1, e2, n2 in edges) % 2 == 1


def star(rng, e, n, size, corners):
    return [(e + rng.uniform(0.2, 1) * size * math.cos(2 * math.pi * k / corners), n + rng.uniform(0.2, 1) * size * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


@pytest.mark.parametrize("bucket", [8.0, 32.0, 1000.0])
def test_equals_search(spark, bucket):
    rng = random.Random(bucket)
    polygons = {}
    for area in range(12):
        e, n = rng.uniform(0, 300), rng.uniform(0, 300)
        polygons[area % 2, area] = ring(area % 2, area, star(rng, e, n, rng.choice([5, 60, 150]), rng.choice([3, 4, 30])))
    polygons[0, 20] = ring(0, 20, [(10.0, 10.0), (290.0, 10.0), (290.0, 290.0), (10.0, 290.0)]) + ring(0, 20, [(100.0, 100.0), (200.0, 100.0), (200.0, 200.0), (100.0, 200.0)])  # with a hole
    polygons[0, 21] = ring(0, 21, [(0.0, 64.0), (300.0, 64.0)])  # flat
    points = [(g, i, *rng.choice([(rng.uniform(-50, 350), rng.uniform(-50, 350)), (float(rng.randrange(0, 320, 32)), float(rng.randrange(0, 320, 32))), (10.0, rng.uniform(0, 300)), (rng.uniform(0, 300), 100.0)])) for i in range(400) for g in (0, 1)]
    points += points[:5] + [(5, 1, 20.0, 20.0), (0, 1000, 1e6, 1e6)]
    edges = [x for p in polygons.values() for x in p]
    got = sorted(map(tuple, vector.containing(spark.createDataFrame(points, POINT), spark.createDataFrame(edges, EDGE), bucket).collect()))
    assert got == sorted((g, i, a, a % 3) for g, i, e, n in points for (h, a), p in polygons.items() if h == g and inside(p, e, n))


def test_rows_follow_points_not_edges(spark):
    """A polygon of 20,000 edges and 20,000 points: all pairs would be 400 million rows."""
    rng = random.Random(1)
    count = 20_000
    corners = [((10_000 + rng.uniform(-3, 3)) * math.cos(2 * math.pi * k / count), (10_000 + rng.uniform(-3, 3)) * math.sin(2 * math.pi * k / count)) for k in range(count)]
    edges = spark.createDataFrame(ring(0, 0, corners), EDGE)
    points = spark.range(20_000).select(F.lit(0).cast("long").alias("grid"), "id", (F.rand(1) * 24_000 - 12_000).alias("e"), (F.rand(2) * 24_000 - 12_000).alias("n"))
    points = spark.createDataFrame(points.collect(), POINT)
    found = vector.containing(points, edges, 500.0)
    assert rows_of_plan(found) < 4_000_000
    want = sum(math.hypot(p["e"], p["n"]) < 9_990 for p in points.collect())
    assert abs(found.count() - want) < 200


def test_no_rows(spark):
    none = spark.createDataFrame([], POINT), spark.createDataFrame([], EDGE)
    assert vector.containing(*none).collect() == []
