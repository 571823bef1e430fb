"""Faults that showed only on large tables or odd input, in small: each against a plain version."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_geometry import haversine
from test_ranges import rows_of_plan

from cairn.catalog import rays as catalog_rays
from cairn.catalog import vector as catalog_vector
from cairn.catalog import view as catalog_view
from cairn.operators import labels, peaks, rays, view
from cairn.sources import features


def test_highest_near_decides_the_edge_in_each_rasters_own_places(spark):
    rng = random.Random(6)
    points = [(g, i, rng.randrange(1000) / 10.0, rng.randrange(1000) / 10.0) for g in (0, 9, 57) for i in range(40)] + [(9, 189, 21.3, 48.1)]
    pixels = [(g, c, r, round(rng.uniform(0, 5), 3)) for g in (0, 9, 57) for r in range(100) for c in range(100)]
    found = rays.highest_near(spark.createDataFrame(points, "grid long, id int, gx double, gy double"), spark.createDataFrame(pixels, "grid long, px int, py int, elev double"), 6.0, keys=("grid",))

    def best(g, gx, gy):
        near = [(z, -r, -c) for h, c, r, z in pixels if h == g and (c + 0.5 - gx) ** 2 + (r + 0.5 - gy) ** 2 <= 36]
        z, r, c = max(near)
        return -c, -r, z

    assert {(r["grid"], r["id"]): (r["px"], r["py"], r["elev"]) for r in found.collect()} == {(g, i): best(g, x, y) for g, i, x, y in points}


def test_boxes_beyond_a_pole_have_no_tiles(spark):
    rows = [(0, 2100.0), (1, -700.0), (2, 2000.0), (3, -100.0)]
    tiles = features.tiles_in_box(F.lit(10.0), F.col("y"), F.lit(10.0) + 20, F.col("y") + 300, 3)
    got = {r["i"]: [tuple(t) for t in r["t"]] for r in spark.createDataFrame(rows, "i int, y double").select("i", tiles.alias("t")).collect()}
    assert got == {0: [], 1: [], 2: [(0, 7)], 3: [(0, 0)]}
    beyond = view.visible_tiles(F.lit(4), F.lit(0.0), F.col("y"), F.lit(1.0), F.lit(10.0), F.lit(10.0), F.lit(15.0), F.lit(-20.0))
    assert [len(r["t"]) for r in spark.createDataFrame([(-900.0,), (900.0,)], "y double").select(beyond.alias("t")).collect()] == [0, 0]


def test_prominence_keeps_every_peak_once_in_any_order_of_rows(spark):
    """Rows come in another order each time they are computed, as from partitions that Spark joins anew."""
    rng = random.Random(8)
    crest = spark.createDataFrame([(0, r, 1000.0, rng.uniform(-3, 3)) for r in range(360)], "scene long, ray int, dist double, angle double")
    named = [(i, rng.uniform(300, 6000), rng.uniform(0, 360), rng.uniform(-3, 3), 0) for i in range(300)]

    def shuffled(parts):
        rows = [r for part in parts for r in part.to_dict("records")]
        random.shuffle(rows)
        yield pd.DataFrame(rows)

    kind = "id long, dist double, az double, angle double, scene long"
    seen = spark.createDataFrame(named, kind).coalesce(1)
    sky = crest.groupBy("scene", "ray").agg(F.max("angle").alias("angle"))
    found = [{r["id"]: r["prominence"] for r in peaks.prominence(df, crest, sky, 360).collect()} for df in (seen, seen.mapInPandas(shuffled, kind))]
    assert len(found[0]) == len(named) and found[0] == found[1]


def broadcast_of_exploded(df):
    """Lines of the plan that explode rows within a broadcast."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        place = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and place <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = place
        if depth is not None and "Generate" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["hz03_heights", "rs04_lakes", "sc05_layer", "vr10_protection"])
def test_exploded_rows_are_not_broadcast(spark, sf, name):
    """Spark guesses their number from the rows before."""
    query = next(m.QUERIES[name] for m in (catalog_rays, catalog_vector, catalog_view) if name in m.QUERIES)
    assert broadcast_of_exploded(query(spark, sf)) == []


def test_copies_of_places_and_cones_do_not_meet_one_by_one(spark):
    points = spark.range(2000).select("id", (46 + F.col("id") % 4 / 100).alias("lat"), (F.col("id") % 3 + 8.0).alias("lon"))
    cones = spark.range(2000).select((46 + F.col("id") % 5 / 100).alias("clat"), F.lit(8.0).alias("clon"), F.lit(50.0).alias("height"), F.lit(3000.0).alias("radius"))
    out = rays.cone_heights(points, cones, 100.0)
    assert rows_of_plan(out) < 50_000
    at = lambda la, lo: 100 + sum(400 * 50 * (1 - d / 3000) for k in range(5) if (d := haversine(la, lo, 46 + k / 100, 8.0)) < 3000)
    got = {r["id"]: r["h"] for r in out.collect()}
    assert len(got) == 2000 and all(abs(h - at(46 + i % 4 / 100, i % 3 + 8.0)) < 1e-6 for i, h in got.items())


def test_nearest_does_not_compare_copies(spark):
    points = spark.range(2000).select("id", (46 + F.col("id") % 4 / 100).alias("lat"), (F.col("id") % 3 + 8.0).alias("lon"))
    probes = spark.range(1500).select(F.col("id").alias("probe"), (46.001 + F.col("id") % 4 / 100).alias("plat"), F.lit(9.0).alias("plon"))
    out = peaks.nearest(points, probes, 1000.0)
    assert rows_of_plan(out) < 50_000
    last = {k: max(i for i in range(2000) if i % 4 == k and i % 3 == 1) for k in range(4)}
    assert {r["probe"]: r["id"] for r in out.collect()} == {i: last[i % 4] for i in range(1500)}


def test_hits_do_not_compare_copies(spark):
    k = F.col("id")
    boxes = spark.range(2000).select("id", (k * 7 % 1500).alias("place"), (k % 5 * 200.0).alias("x"), (k % 3 * 90.0).alias("y"), F.lit(60.0).alias("w"), F.lit(18.0).alias("h"))
    probes = spark.range(1500).select(k.alias("probe"), (k % 4 * 205.0).alias("px"), F.lit(95.0).alias("py"))
    out = labels.hits(boxes, probes)
    assert rows_of_plan(out) < 50_000
    first = {c: min((i * 7 % 1500, i) for i in range(2000) if i % 5 == c and i % 3 == 1)[1] for c in range(4)}
    assert {r["probe"]: r["id"] for r in out.collect()} == {i: first[i % 4] for i in range(1500)}


def test_export_plans_try_few_steps_and_find_the_first_that_fits(spark):
    rng = random.Random(18)
    rows = [(i, rng.uniform(1, 400), rng.uniform(1, 40), rng.uniform(0.5, 3), 10 ** rng.uniform(0, 7)) for i in range(400)]
    p = view.export_plan(F.col("f"), F.col("s"), F.col("x"), F.col("w"))
    df = spark.createDataFrame(rows, "i int, f double, s double, x double, w double").select("i", p.alias("p"))
    assert "sequence(0, 200" not in p._jc.toString() and "sequence(0, 200" not in df._jdf.queryExecution().toString().lower()

    def first(f, s, x, w):
        for k in range(201):
            px = w * math.pow(0.95, k)
            width, height = max(1, math.floor(f * px + 0.5)), max(1, math.floor(s * px * x + 0.5))
            footer = math.floor(min(48, max(14, math.floor(width / 90 + 0.5))) * 4.2 + 0.5)
            if width * (height + footer) <= 16_000_000:
                return width, height, footer
        return None

    got = {r["i"]: r["p"] and (r["p"]["width"], r["p"]["height"], r["p"]["footer"]) for r in df.collect()}
    assert got == {i: first(*x) for i, *x in rows}
