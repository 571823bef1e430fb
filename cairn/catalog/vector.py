"""Registered queries of vector features on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import raster, vector
from ..sources import terrain, views
from ..sources.views import with_views
from . import raster as cells_of
from .raster import _FLAT, _PATCH, _TERRAIN

GEO = vector.Geometry(views.E0, views.N0, views.CELL, views.WIDTH, views.HEIGHT)
L = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


def vr02_lines(spark, sf_dir):
    return vector.rasterise_lines(views.tracks(spark, sf_dir), GEO).select(*L("grid", "row", "col"))


def vr03_points(spark, sf_dir):
    return vector.rasterise_points(views.points(spark, sf_dir), GEO).select(*L("grid", "row", "col"))


def vr04_fill(spark, sf_dir):
    return vector.fill_polygons(views.areas(spark, sf_dir), GEO).select(*L("grid", "area", "row", "col"))


def _probes(spark, sf_dir):
    k = F.col("event_id")
    return views.table(spark, sf_dir, "events").select((k % 2).cast("long").alias("grid"), k.alias("id"), (views.E0 + k * 17 % 2000 / 10.0 + 0.05).alias("e"), (views.N0 - k * 31 % 2000 / 10.0 - 0.05).alias("n"))


def place_windows(spark, sf_dir):
    """Windows of 40 m around places, some beyond the ground that there is."""
    k = F.col("s_suppkey")
    places = views.table(spark, sf_dir, "supplier").select(k.alias("grid"), (k % views.grids(spark, sf_dir) * 1000 + views.E0 + k * 71 % 230 - 15).alias("east"), (views.N0 - k * 43 % 230 + 15).alias("north"))
    return places.select("grid", *(c.alias(n) for n, c in terrain.window_bounds(F.col("east"), F.col("north"), 20.0, views.CELL).items()))


def src13_windows(spark, sf_dir):
    """Heights of windows from tiles of a square kilometre."""
    return terrain.load_windows(place_windows(spark, sf_dir), views.tiles(spark, sf_dir), views.CELL).select(*L("grid", "row", "col"), F.round("z", 6).alias("z"))


def vr05_pip(spark, sf_dir):
    return vector.containing(_probes(spark, sf_dir), views.areas(spark, sf_dir)).select(*L("grid", "id", "area"))


def vr12_areas_at(spark, sf_dir):
    return vector.areas_at(_probes(spark, sf_dir), views.areas(spark, sf_dir)).select(*L("grid", "id", "place", "area", "rank"))


def vr10_protection(spark, sf_dir):
    return vector.protection_index(views.areas(spark, sf_dir), GEO).select(*L("grid", "row", "col", "index"))


def sc05_layer(spark, sf_dir):
    """0 not protected, 1 flagged, 2 in force, for every cell."""
    edges = views.areas(spark, sf_dir)
    order = vector.paint_order(edges.select("grid", "area", "rank").distinct()).select("grid", "index", "rank")
    index = vector.protection_index(edges, GEO).join(order.hint("merge"), ["grid", "index"])
    out = views.dem(spark, sf_dir).select("grid", "row", "col").join(index.hint("merge"), ["grid", "row", "col"], "left")  # Spark guesses the size of filled cells from the suppliers'
    layer = F.when(F.col("rank").isNull(), 0).when(F.col("rank") == 2, 2).otherwise(1)
    return out.select(*L("grid", "row", "col"), layer.cast("long").alias("layer"))


def _all_distances(spark, sf_dir):
    grid = views.dem(spark, sf_dir).select("grid", "row", "col")
    cells = grid.withColumn("kind", F.explode(F.array(*map(F.lit, ("trail", "drinking")))))
    marks = vector.rasterise_lines(views.tracks(spark, sf_dir), GEO).withColumn("kind", F.lit("trail")).unionByName(vector.rasterise_points(views.points(spark, sf_dir), GEO).withColumn("kind", F.lit("drinking")))
    return vector.distances(cells, marks, views.CELL, ("grid", "kind"))


def vr07_distance_map(spark, sf_dir):
    """Distances to trails with those up to 100 m outside the raster."""
    grids = views.dem(spark, sf_dir).select("grid").distinct()
    return vector.distance_map(grids, views.tracks(spark, sf_dir), vector.rasterise_lines, GEO).select(*L("grid", "row", "col"), F.round("distance", 4).alias("distance"))


def vr06_edt(spark, sf_dir):
    marks = vector.rasterise_lines(views.tracks(spark, sf_dir), GEO)
    return vector.distances(views.dem(spark, sf_dir).select("grid", "row", "col"), marks, views.CELL).select(*L("grid", "row", "col"), F.round("distance", 4).alias("distance"))


def vr08_distances(spark, sf_dir):
    return _all_distances(spark, sf_dir).select(*L("grid", "row", "col"), "kind", F.round("distance", 4).alias("distance"))


def sc02_camp_score(spark, sf_dir):
    d = _all_distances(spark, sf_dir).groupBy("grid", "row", "col").agg(F.max(F.when(F.col("kind") == "trail", F.col("distance"))).alias("trail"), F.max(F.when(F.col("kind") == "drinking", F.col("distance"))).alias("drinking"))
    s = cells_of.scored(spark, sf_dir).select("grid", "row", "col", "score").join(d, ["grid", "row", "col"])
    score = raster.camp_score(F.col("score"), F.col("trail"), None, F.col("drinking"), None, {"trail": 60.0, "drinking": -50.0})
    return s.select(*L("grid", "row", "col"), F.round(score, 6).alias("score"))


def rs07_vegetation(spark, sf_dir):
    sub = lambda j: F.when((F.col("id") * 3 + j) % 17 == 0, None).otherwise(F.col("z") + 0.01 * ((F.col("id") * 7919 + j * 104729) % 400))
    cells = views.dem(spark, sf_dir).withColumn("surface", F.array(*map(sub, range(4))))
    return vector.vegetation(cells, "surface", "z", views.WIDTH, views.HEIGHT).select(*L("grid", "row", "col"), F.round("canopy", 6).alias("canopy"))


def rs08_resample(spark, sf_dir):
    dem = views.dem(spark, sf_dir)
    source = dem.filter("row % 5 = 2 AND col % 5 = 2").select("grid", (F.col("row") / 5).cast("int").alias("row"), (F.col("col") / 5).cast("int").alias("col"), F.col("z").alias("v"))
    targets = dem.select("grid", "row", "col", (views.E0 + (F.col("col") + 0.5) * views.CELL - 3).alias("e"), (views.N0 - (F.col("row") + 0.5) * views.CELL + 3).alias("n"))
    return vector.resample(targets, source, views.E0, views.N0, 10.0, 20, 20).select(*L("grid", "row", "col"), F.round("value", 6).alias("value"))


def vr14_reproject(spark, sf_dir, most: int = 60):
    """Cell under each pixel centre of a map of every raster; null outside."""
    grids = views.dem(spark, sf_dir).select("grid").distinct()
    e0 = views.E0 + F.col("grid") * 1000.0
    corner = F.explode(F.array(*(F.struct((e0 + dx).alias("e"), F.lit(views.N0 - dy).alias("n")) for dx in (0.0, 200.0) for dy in (0.0, 200.0))))
    at = grids.select("grid", corner.alias("p")).select("grid", *(c.alias(n) for n, c in zip(("lat", "lon"), geo.from_lv95(F.col("p.e"), F.col("p.n")), strict=True)))
    box = at.groupBy("grid").agg(F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("x"))
    aspect = (F.col("x") - F.col("w")) * 111_320 * F.cos(F.radians((F.col("s") + F.col("t")) / 2)) / ((F.col("t") - F.col("s")) * 111_200)
    box = box.withColumn("a", aspect).withColumn("pw", F.when(F.col("a") >= 1, most).otherwise(text.half_up(most * F.col("a")))).withColumn("ph", F.when(F.col("a") >= 1, text.half_up(most / F.col("a"))).otherwise(most))
    px = box.select("*", F.explode(F.sequence(F.lit(0), F.col("ph") - 1)).alias("py")).select("*", F.explode(F.sequence(F.lit(0), F.col("pw") - 1)).alias("px"))
    e, n = geo.to_lv95(F.col("t") - (F.col("py") + 0.5) / F.col("ph") * (F.col("t") - F.col("s")), F.col("w") + (F.col("px") + 0.5) / F.col("pw") * (F.col("x") - F.col("w")))
    out = px.select("grid", "py", "px", GEO.row(n).alias("row"), GEO.col(e - F.col("grid") * 1000.0).alias("col"))
    return out.select(*L("grid", "py", "px"), F.when(GEO.inside(), F.col("row") * views.WIDTH + F.col("col")).cast("long").alias("cell"))


def sc06_paint(spark, sf_dir):
    """Colours of the slope layer from a table of 256 steps; unknown cells are transparent."""
    from .scalar import STOPS

    good = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("slope") - 5) / 30))
    k = text.half_up(good * 255)
    c = raster.terrain(views.dem(spark, sf_dir), grid=("grid",)).withColumn("c", text.palette_colour(STOPS, k / 255))
    known = F.col("slope").isNotNull()
    return c.select(*L("grid", "row", "col"), *(F.when(known, text.half_up(F.get("c", F.lit(i)))).otherwise(0).cast("long").alias(n) for i, n in enumerate("rgb")), F.when(known, 165).otherwise(0).cast("long").alias("alpha"))


_LINES = """+sg AS (SELECT grid, line, seq, e, n, lead(e) OVER w AS e2, lead(n) OVER w AS n2, row_number() OVER w AS k FROM tracks WINDOW w AS (PARTITION BY grid, line ORDER BY seq, e, n)),
 st AS (SELECT grid, e, n, coalesce(e2, e) AS e2, coalesce(n2, n) AS n2, greatest(1, ceil(sqrt(pow(coalesce(e2, e) - e, 2) + pow(coalesce(n2, n) - n, 2))))::INT AS steps FROM sg WHERE e2 IS NOT NULL OR k = 1),
 sm AS (SELECT *, unnest(range(0, steps + 1)) AS k FROM st),
 trail AS (SELECT DISTINCT grid, row, col FROM (SELECT grid, floor((1205000 - (n + (n2 - n) * k / steps)) / 2)::BIGINT AS row, floor((e + (e2 - e) * k / steps - 2722000) / 2)::BIGINT AS col FROM sm) WHERE row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99)"""
_WIDE = """, wide AS (SELECT DISTINCT grid, row, col FROM (SELECT grid, floor((1205000 - (n + (n2 - n) * k / steps)) / 2)::BIGINT AS row, floor((e + (e2 - e) * k / steps - 2722000) / 2)::BIGINT AS col FROM sm) WHERE row BETWEEN -50 AND 149 AND col BETWEEN -50 AND 149),
 rc AS (SELECT grid, r AS row, c AS col FROM (SELECT DISTINCT grid FROM dem), range(0, 100) a(r), range(0, 100) b(c))"""
_POINTS = """tap AS (SELECT DISTINCT grid, row, col FROM (SELECT grid, floor((1205000 - n) / 2)::BIGINT AS row, floor((e - 2722000) / 2)::BIGINT AS col FROM points) WHERE row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99)"""
_FILLED = """+rw AS (SELECT unnest(range(0, 100)) AS row), cr AS (SELECT grid, area, rank, row, e1 + (1205000 - (row + 0.5::DOUBLE) * 2 - n1) / (n2 - n1) * (e2 - e1) AS x FROM areas, rw
   WHERE (n1 <= 1205000 - (row + 0.5::DOUBLE) * 2) <> (n2 <= 1205000 - (row + 0.5::DOUBLE) * 2)),
 ps AS (SELECT *, row_number() OVER (PARTITION BY grid, area, row ORDER BY x) AS k, lead(x) OVER (PARTITION BY grid, area, row ORDER BY x) AS y FROM cr),
 filled AS (SELECT DISTINCT grid, area, rank, row, unnest(range(greatest(0, ceil((x - 2722000) / 2 - 0.5::DOUBLE))::BIGINT, least(99, floor((y - 2722000) / 2 - 0.5::DOUBLE))::BIGINT + 1)) AS col FROM ps WHERE k % 2 = 1),
 paint AS (SELECT grid, area, rank, row_number() OVER (PARTITION BY grid ORDER BY rank, area) AS index FROM (SELECT DISTINCT grid, area, rank FROM areas)),
 prot AS (SELECT f.grid, f.row, f.col, max(index) AS index FROM filled f JOIN paint p USING (grid, area) GROUP BY ALL)"""
_PROBED = """+pr AS (SELECT event_id % 2 AS grid, event_id AS id, 2722000 + event_id * 17 % 2000 / 10.0::DOUBLE + 0.05::DOUBLE AS e, 1205000 - event_id * 31 % 2000 / 10.0::DOUBLE - 0.05::DOUBLE AS n FROM events),
 hit AS (SELECT p.grid, id, area, rank FROM pr p JOIN areas a USING (grid) GROUP BY ALL HAVING count(*) FILTER ((n1 > n) <> (n2 > n) AND e < (e2 - e1) * (n - n1) / (n2 - n1) + e1) % 2 = 1)"""
_NEAREST = "SELECT d.grid, d.row, d.col, '{k}' AS kind, coalesce(min(sqrt(pow(d.row - m.row, 2) + pow(d.col - m.col, 2))) * 2, 'Infinity'::DOUBLE) AS distance FROM dem d LEFT JOIN {t} m ON m.grid = d.grid GROUP BY d.grid, d.row, d.col"
_DISTS = f"{_LINES}, {_POINTS}, dist AS ({_NEAREST.format(k='trail', t='trail')} UNION ALL {_NEAREST.format(k='drinking', t='tap')})"


def _ground(j: int, i: int) -> str:
    """Bilinear ground under sub-pixel (j, i) from the neighbourhood columns az..kz, z."""
    names = {(-1, -1): "az", (-1, 0): "bz", (-1, 1): "cz", (0, -1): "dz", (0, 0): "z", (0, 1): "fz", (1, -1): "gz", (1, 0): "hz", (1, 1): "kz"}
    cases = []
    for cy, y, ty in [("row = 0", 0, -0.25), ("row > 0", -1, 0.75)] if j == 0 else [("row = 99", -1, 1.25), ("row < 99", 0, 0.25)]:
        for cx, x, tx in [("col = 0", 0, -0.25), ("col > 0", -1, 0.75)] if i == 0 else [("col = 99", -1, 1.25), ("col < 99", 0, 0.25)]:
            cases.append(f"WHEN {cy} AND {cx} THEN ({names[y, x]} * {1 - tx}::DOUBLE + {names[y, x + 1]} * {tx}::DOUBLE) * {1 - ty}::DOUBLE + ({names[y + 1, x]} * {1 - tx}::DOUBLE + {names[y + 1, x + 1]} * {tx}::DOUBLE) * {ty}::DOUBLE")
    return "CASE " + " ".join(cases) + " END"


_VEG = ", ".join(f"CASE WHEN (id * 3 + {2 * j + i}) % 17 <> 0 THEN z + 0.01::DOUBLE * ((id * 7919 + {(2 * j + i) * 104729}) % 400) - ({_ground(j, i)}) END" for j in (0, 1) for i in (0, 1))
_CELL = "grid::BIGINT AS grid, row::BIGINT AS row, col::BIGINT AS col"
_LAT = "(16.9023892::DOUBLE + 3.238272::DOUBLE*w - 0.270978::DOUBLE*v*v - 0.002528::DOUBLE*w*w - 0.0447::DOUBLE*v*v*w - 0.014::DOUBLE*w*w*w) * 100 / 36"
_LON = "(2.6779094::DOUBLE + 4.728982::DOUBLE*v + 0.791484::DOUBLE*v*w + 0.1306::DOUBLE*v*w*w - 0.0436::DOUBLE*v*v*v) * 100 / 36"
_U = "CASE WHEN trail < 8 THEN 0.2::DOUBLE ELSE 0.2::DOUBLE + 0.8::DOUBLE * u * u * (3 - 2 * u) END"
SQL = {
    "vr02_lines": with_views(_LINES + f" SELECT {_CELL} FROM trail", "tracks"),
    "vr03_points": with_views(f"+{_POINTS} SELECT {_CELL} FROM tap", "points"),
    "vr04_fill": with_views(_FILLED + " SELECT grid, area, row, col FROM filled", "areas"),
    "src13_windows": with_views("""+w AS (SELECT s_suppkey AS grid, s_suppkey % (SELECT max(event_id) // 10000 + 1 FROM events) AS g, floor((2722000 + s_suppkey * 71 % 230 - 35) / 2.0) * 2 - 2722000 AS e0, ceil((1205000 - s_suppkey * 43 % 230 + 35) / 2.0) * 2 - 1205000 AS n0 FROM supplier),
        ok AS (SELECT grid AS g FROM dem GROUP BY grid HAVING count(*) = 10000), c AS (SELECT w.*, r AS row, c AS col, (r - n0 / 2)::BIGINT AS y, (c + e0 / 2)::BIGINT AS x FROM w, range(0, 20) a(r), range(0, 20) b(c))
        SELECT c.grid, c.row, c.col, round(d.z, 6) AS z FROM c LEFT JOIN (SELECT dem.* FROM dem JOIN ok ON ok.g = dem.grid) d ON d.grid = c.g AND d.row = c.y AND d.col = c.x""", "dem"),
    "vr05_pip": with_views(_PROBED + " SELECT grid, id, area FROM hit", "areas"),
    "vr12_areas_at": with_views(_PROBED + " SELECT grid, id, row_number() OVER (PARTITION BY grid, id ORDER BY rank DESC, area DESC) AS place, area, rank FROM hit", "areas"),
    "vr10_protection": with_views(_FILLED + " SELECT grid, row, col, index FROM prot", "areas"),
    "sc05_layer": with_views(_FILLED + " SELECT d.grid, d.row::BIGINT AS row, d.col::BIGINT AS col, CASE WHEN p.rank IS NULL THEN 0 WHEN p.rank = 2 THEN 2 ELSE 1 END::BIGINT AS layer FROM dem d LEFT JOIN prot x ON x.grid = d.grid AND x.row = d.row AND x.col = d.col LEFT JOIN paint p ON p.grid = x.grid AND p.index = x.index", "dem", "areas"),
    "vr06_edt": with_views(_DISTS + f" SELECT {_CELL}, round(distance, 4) AS distance FROM dist WHERE kind = 'trail'", "dem", "tracks", "points"),
    "vr07_distance_map": with_views(_LINES + _WIDE + f" SELECT {_CELL}, round(distance, 4) AS distance FROM (SELECT d.grid, d.row, d.col, coalesce(min(sqrt(pow(d.row - m.row, 2) + pow(d.col - m.col, 2))) * 2, 'Infinity'::DOUBLE) AS distance FROM rc d LEFT JOIN wide m ON m.grid = d.grid GROUP BY d.grid, d.row, d.col)", "dem", "tracks"),
    "vr08_distances": with_views(_DISTS + f" SELECT {_CELL}, kind, round(distance, 4) AS distance FROM dist", "dem", "tracks", "points"),
    "sc02_camp_score": with_views(
        f"""{_DISTS}, {_TERRAIN.removeprefix("+")}{_FLAT}{_PATCH}, sc AS (SELECT p.*, t.distance AS trail, w.distance AS tap, least(1.0::DOUBLE, (t.distance - 8) / 52) AS u FROM patch p
        JOIN dist t ON t.kind = 'trail' AND t.grid = p.grid AND t.row = p.row AND t.col = p.col JOIN dist w ON w.kind = 'drinking' AND w.grid = p.grid AND w.row = p.row AND w.col = p.col)
        SELECT {_CELL}, round(CASE WHEN score IS NULL OR score = 0 THEN score ELSE score * ({_U}) * (CASE WHEN trail <= 60 THEN 1.0::DOUBLE WHEN isinf(trail) THEN 0.15::DOUBLE ELSE 0.15::DOUBLE + 0.85::DOUBLE * greatest(0.0::DOUBLE, 1 - (trail - 60) / 60) END)
          * (CASE WHEN tap < 50 THEN 0.6::DOUBLE + 0.4::DOUBLE * tap / 50 ELSE 1.0::DOUBLE END) END, 6) AS score FROM sc""",
        "dem", "tracks", "points",
    ),
    "rs07_vegetation": with_views(
        _TERRAIN + f""", sf AS (SELECT n.grid, n.row, n.col, list_filter([{_VEG}], lambda x: x IS NOT NULL) AS h FROM (SELECT nb.*, d.id FROM nb JOIN dem d USING (grid, row, col)) n),
        so AS (SELECT grid, row, col, list_reverse_sort(list_transform(h, lambda x: greatest(0.0::DOUBLE, x))) AS h FROM sf) SELECT {_CELL}, round(h[least(2, len(h))], 6) AS canopy FROM so""",
        "dem",
    ),
    "rs08_resample": with_views(
        f"""+src AS (SELECT grid, row // 5 AS y, col // 5 AS x, z AS v FROM dem WHERE row % 5 = 2 AND col % 5 = 2), t AS (SELECT grid, row, col, ((col + 0.5::DOUBLE) * 2 - 3) / 10 - 0.5::DOUBLE AS px, ((row + 0.5::DOUBLE) * 2 - 3) / 10 - 0.5::DOUBLE AS py FROM dem),
        u AS (SELECT *, px BETWEEN -0.5 AND 19.5 AND py BETWEEN -0.5 AND 19.5 AS ok, least(18, greatest(0, floor(px)))::BIGINT AS x, least(18, greatest(0, floor(py)))::BIGINT AS y FROM t),
        w AS (SELECT u.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, px - u.x)) AS fx, least(1.0::DOUBLE, greatest(0.0::DOUBLE, py - u.y)) AS fy, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM u LEFT JOIN src a ON a.grid = u.grid AND a.x = u.x AND a.y = u.y
          LEFT JOIN src b ON b.grid = u.grid AND b.x = u.x + 1 AND b.y = u.y LEFT JOIN src c ON c.grid = u.grid AND c.x = u.x AND c.y = u.y + 1 LEFT JOIN src d ON d.grid = u.grid AND d.x = u.x + 1 AND d.y = u.y + 1)
        SELECT {_CELL}, round(CASE WHEN ok THEN coalesce((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy, CASE WHEN fx < 0.5 AND fy < 0.5 THEN a WHEN fy < 0.5 THEN b WHEN fx < 0.5 THEN c ELSE d END) END, 6) AS value FROM w""",
        "dem",
    ),
    "vr14_reproject": with_views(
        f"""+cn AS (SELECT DISTINCT grid, (2722000 + grid * 1000.0::DOUBLE + dx - 2600000) / 1e6::DOUBLE AS v, (1205000 - dy - 1200000)::DOUBLE / 1e6::DOUBLE AS w FROM dem, (VALUES (0), (200)) a(dx), (VALUES (0), (200)) b(dy)),
        bx AS (SELECT grid, min({_LAT}) AS s, max({_LAT}) AS t, min({_LON}) AS west, max({_LON}) AS x FROM cn GROUP BY grid), ba AS (SELECT *, (x - west) * 111320 * cos(radians((s + t) / 2)) / ((t - s) * 111200) AS a FROM bx),
        bs AS (SELECT *, CASE WHEN a >= 1 THEN 60 ELSE floor(60 * a + 0.5) END::INT AS pw, CASE WHEN a >= 1 THEN floor(60 / a + 0.5) ELSE 60 END::INT AS ph FROM ba), p1 AS (SELECT *, unnest(range(0, ph)) AS py FROM bs), p2 AS (SELECT *, unnest(range(0, pw)) AS px FROM p1),
        p3 AS (SELECT *, ((t - (py + 0.5::DOUBLE) / ph * (t - s)) * 3600 - 169028.66::DOUBLE) / 10000 AS p, ((west + (px + 0.5::DOUBLE) / pw * (x - west)) * 3600 - 26782.5::DOUBLE) / 10000 AS l FROM p2),
        p4 AS (SELECT grid, py, px, floor((1205000 - (1200147.07::DOUBLE + 308807.95::DOUBLE*p + 3745.25::DOUBLE*l*l + 76.63::DOUBLE*p*p - 194.56::DOUBLE*l*l*p + 119.79::DOUBLE*p*p*p)) / 2)::BIGINT AS row,
          floor((2600072.37::DOUBLE + 211455.93::DOUBLE*l - 10938.51::DOUBLE*l*p - 0.36::DOUBLE*l*p*p - 44.54::DOUBLE*l*l*l - grid * 1000 - 2722000) / 2)::BIGINT AS col FROM p3)
        SELECT grid, py, px, CASE WHEN row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99 THEN row * 100 + col END AS cell FROM p4""",
        "dem",
    ),
    "sc06_paint": with_views(
        _TERRAIN + f""", s AS (SELECT [0,81,183,252,252] AS r, [0,18,55,137,253] AS g, [4,124,121,97,191] AS b), x AS (SELECT grid, row, col, floor((1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (slope - 5) / 30))) * 255 + 0.5::DOUBLE) / 255 * 4 AS x, slope FROM terrain),
        y AS (SELECT *, least(3, floor(x))::INT AS i, x - least(3, floor(x)) AS f FROM x)
        SELECT {_CELL}, {", ".join(f"CASE WHEN slope IS NULL THEN 0 ELSE floor({c}[i+1] + ({c}[i+2] - {c}[i+1]) * f + 0.5)::BIGINT END AS {c}" for c in "rgb")}, CASE WHEN slope IS NULL THEN 0 ELSE 165 END::BIGINT AS alpha FROM y, s""",
        "dem",
    ),
}
QUERIES = {n: globals()[n] for n in SQL}
