"""Operators of geometry against plain versions on random input: distances, cells of ground, labels, ray samples, levels."""

import math
import random

import numpy as np
from pyspark.sql import functions as F


from cairn.operators import labels, peaks, rays, vector, view


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_nearest_in_rows_equals_comparing_all_columns():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 8, 9, 31, 64, 100):
        for _ in range(10):
            g = rng.integers(0, 30, (6, width)).astype(float)
            g[rng.random(g.shape) < rng.random()] = np.inf
            c = np.arange(width)
            assert (vector.nearest_in_rows(g) == ((c[:, None] - c) ** 2 + (g * g)[:, None, :]).min(2)).all()


def test_distances_of_grids_of_different_widths(spark):
    sizes = {0: (7, 13), 1: (1, 40), 2: (20, 1)}
    cells = [(g, r, c) for g, (h, w) in sizes.items() for r in range(h) for c in range(w)]
    marks = [(0, 3, 4), (0, -2, 12), (1, 0, 39), (9, 0, 0)]
    schema = "grid long, row int, col int"
    got = {(r["grid"], r["row"], r["col"]): r["distance"] for r in vector.distances(spark.createDataFrame(cells, schema), spark.createDataFrame(marks, schema), 2.0, band=4).collect()}
    assert len(got) == len(cells)
    for g, r, c in cells:
        want = min((math.hypot(r - y, c - x) * 2 for k, y, x in marks if k == g), default=math.inf)
        assert math.isclose(got[g, r, c], want, rel_tol=1e-12)


def test_cells_of_ground_meet_everywhere(spark):
    """Nearest and anti-join by distance at the date line, at the poles and in between, against all pairs."""
    rng = random.Random(3)
    near = [(0.0, 179.99), (0.0, -179.99), (89.99, 10.0), (89.99, -170.0), (-89.999, 50.0), (-89.98, -130.0), (47.0, 8.0)]
    places = [(i, a + rng.uniform(-0.03, 0.03), b + rng.uniform(-0.05, 0.05)) for i, (a, b) in enumerate(near * 20)]
    places = [(i, max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for i, a, b in places]
    others = [(i, a, b) for i, a, b in places if i % 3 == 0]
    p, o = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (places, others))
    for most in (500.0, 3000.0):
        got = {r["probe"]: (r["id"], r["d"]) for r in peaks.nearest(o, p.select(F.col("id").alias("probe"), F.col("lat").alias("plat"), F.col("lon").alias("plon")), most).collect()}
        alone = {r["id"] for r in peaks.without_near(p, o, most).collect()}
        for i, a, b in places:
            best = min((haversine(a, b, c, d), -k) for k, c, d in others)
            assert (i in got) == (best[0] <= most) == (i not in alone)
            if i in got:
                assert got[i][0] == -best[1] and math.isclose(got[i][1], best[0], abs_tol=1e-3)


def test_cones_over_points_on_both_sides_of_the_date_line(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-1, 1), (179.5 + rng.uniform(0, 1) + 180) % 360 - 180) for i in range(100)]
    cones = [(rng.uniform(-1, 1), (179.5 + rng.uniform(0, 1) + 180) % 360 - 180, 500.0, rng.uniform(1000, 60_000)) for _ in range(15)]
    out = rays.cone_heights(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(cones, "clat double, clon double, height double, radius double"), 10.0)
    got = {r["id"]: r["h"] for r in out.collect()}
    for i, a, b in points:
        assert math.isclose(got[i], 10 + sum(h * max(0, 1 - haversine(a, b, c, d) / r) for c, d, h, r in cones), abs_tol=1e-6)


def test_summit_heights_fill_only_unknown_ones(spark):
    p = spark.createDataFrame([(1, 46.0, 8.0, None), (2, 46.0, 8.0, 5.0), (3, 47.0, 8.0, None)], "id long, lat double, lon double, elev double")
    ground = spark.createDataFrame([(46.0005, 8.0, 900.0), (46.0, 8.0008, 950.0), (46.002, 8.0, 2000.0), (46.0, 8.0, None)], "lat double, lon double, h double")
    assert {r["id"]: r["elev"] for r in peaks.summit_heights(p, ground).collect()} == {1: 950.0, 2: 5.0, 3: None}


def test_samples_for_observers_equal_those_of_one(spark):
    obs = spark.createDataFrame([(0, 46.5), (1, -70.0)], "scene long, lat double")
    got = rays.samples_for(obs, 25_000.0).orderBy("scene", "i").collect()
    for scene, lat in ((0, 46.5), (1, -70.0)):
        want = rays.ray_samples(spark, lat, 25_000.0).orderBy("i").collect()
        mine = [r for r in got if r["scene"] == scene]
        assert [(r["i"], r["zoom"]) for r in mine] == [(r["i"], r["zoom"]) for r in want]
        assert all(math.isclose(a["dist"], b["dist"], rel_tol=1e-12) and math.isclose(a["drop"], b["drop"], rel_tol=1e-9) for a, b in zip(mine, want, strict=True))


def test_level_just_above_a_level_keeps_it(spark):
    finest = 4 * 512 / 360.0
    row = spark.range(1).select(view.level_for(F.lit(finest * 1.02)).alias("a"), view.level_for(F.lit(finest * 1.04)).alias("b"), view.level_for(F.lit(1e9)).alias("c")).first()
    assert tuple(row) == (4, 6, 256)


def plain_clash(p, q, period):
    """Two labels (x, w, top, bottom, foot x, foot y) by sampling their lines finely and comparing boxes; None where it is too close to call."""
    shift = round((p[0] - q[0]) / period) * period
    q = (q[0] + shift, *q[1:4], q[4] + shift, q[5])
    s = labels.SPACING
    gap = [abs(p[0] - q[0]) - (p[1] + q[1]) / 2 - s, p[2] - q[3] - s, q[2] - p[3] - s]
    if max(gap) < 0:
        return True
    close = abs(max(gap)) < 1e-6
    line = lambda a: [(a[0] + (a[4] - a[0]) * t / 400, a[3] + (a[5] - a[3]) * t / 400) for t in range(401)]
    for a, b in ((p, q), (q, p)):
        for x, y in line(a):
            far = max(abs(x - b[0]) - b[1] / 2 - s, b[2] - s - y, y - b[3] - s)
            if far <= 0:
                return True
            close = close or far < 0.6
    ax, ay, bx, by = p[0], p[3], p[4], p[5]
    cx, cy, dx, dy = q[0], q[3], q[4], q[5]
    side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    values = [side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)]
    if values[0] * values[1] < 0 and values[2] * values[3] < 0:
        return True
    return None if close or min(map(abs, values)) < 1e-6 else False


def test_conflicts_of_labels_equal_a_sampled_version():
    rng = random.Random(8)
    decided = 0
    for _ in range(1500):
        period = 3600.0
        one, other = ([rng.uniform(0, 400), rng.uniform(20, 90), 0.0, rng.uniform(20, 200), 0.0, 0.0] for _ in range(2))
        for x in (one, other):
            x[2] = x[3] - labels.HEIGHT
            x[4], x[5] = x[0] + rng.uniform(-150, 150), x[3] + rng.uniform(12, 150)
        other[0], other[4] = other[0] + rng.choice([0, period, -period]), other[4]
        other[4] = other[0] + rng.uniform(-150, 150)
        want = plain_clash(one, other, period)
        if want is not None:
            got = labels.conflicts(np.array([one[0]]), one[1], np.array([one[3]]), (one[4], one[5]), np.array([other]), period)[0, 0]
            assert bool(got) == want, (one, other)
            decided += 1
    assert decided > 1000


def test_layout_places_labels_in_order_in_their_first_free_spot(spark):
    """Random scenes: every placed label is free of those before it, and no earlier spot of its own was."""
    rng = random.Random(2)
    rows = [(s, i, i, rng.uniform(0, 360), rng.uniform(0, 6), rng.uniform(30, 120)) for s in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "scene long, id long, place int, az double, angle double, width double")
    got = {(r["scene"], r["id"]): r for r in labels.layout(df, 10.0, 20.0).collect()}
    spots = sorted(((row, shift) for shift in labels.SHIFTS for row in range(labels.ROWS)), key=lambda x: x[0] + labels.SHIFT_COST * abs(x[1]))
    for s in range(3):
        placed = []
        for _, i, _, az, angle, width in (r for r in rows if r[0] == s):
            w, fx, fy = width + 2 * labels.PAD, az * 10.0, (20.0 - angle) * 10.0
            found = None
            for row, shift in spots:
                x, bottom = fx + shift * w, fy - labels.LEADER - row * (labels.HEIGHT + labels.SPACING)
                if bottom < labels.HEIGHT or abs(shift * w) > max(fy - bottom, labels.FLAT * w):
                    continue
                if not any(labels.conflicts(np.array([x]), w, np.array([bottom]), (fx, fy), np.array([p]), 3600.0)[0, 0] for p in placed):
                    found = (x, w, bottom - labels.HEIGHT, bottom, fx, fy)
                    break
            assert (found is None) == ((s, i) not in got)
            if found:
                placed.append(found)
                assert math.isclose(got[s, i]["dx"], found[0] - fx - w / 2, abs_tol=1e-9) and math.isclose(got[s, i]["dy"], found[2] - fy, abs_tol=1e-9)
    assert len(got) > 60
