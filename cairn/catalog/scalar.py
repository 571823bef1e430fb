"""Registered queries over Column expressions: geodesy, factors, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import factors, geo, text
from ..sources import views
from ..sources.views import table, with_views

HOME = (46.5, 8.5)


def _round(**columns):
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def geo01_06_geodesy(spark, sf_dir):
    p, (lat, lon) = views.peaks(spark, sf_dir), HOME
    d = geo.distance(lat, lon, F.col("lat"), F.col("lon"))
    to = geo.destination(lat, lon, F.col("id") % 360 * 1.0, F.col("id") * 17.0)
    return p.select("id", *_round(drop=geo.curvature_drop(d), angle=geo.elevation_angle(F.col("id") % 4000, 500.0, d), wrapped=geo.wrap180(F.col("lon") * 40 - 500), to_lat=to[0], to_lon=to[1], dist=d, az=geo.bearing(lat, lon, F.col("lat"), F.col("lon"))))


def geo07_tiles(spark, sf_dir):
    x, y = geo.to_tile(F.col("lat"), F.col("lon"), 12)
    lat, lon = geo.from_tile(F.col("x"), F.col("y"), 12)
    return views.peaks(spark, sf_dir).withColumns({"x": x, "y": y}).select("id", *_round(x=F.col("x"), y=F.col("y"), lat=lat, lon=lon, mpp=geo.metres_per_pixel(F.col("lat"), 12)))


def geo10_box(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", geo.in_switzerland(45 + F.col("event_id") % 400 / 100.0, 5 + F.col("event_id") * 7 % 700 / 100.0).alias("inside"))


def geo08_lv95(spark, sf_dir):
    e, n = geo.to_lv95(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_lv95(F.col("e"), F.col("n"))
    return views.peaks(spark, sf_dir).withColumns({"e": e, "n": n}).select("id", F.round("e", 4).alias("e"), F.round("n", 4).alias("n"), *_round(lat=lat, lon=lon), geo.in_switzerland(F.col("lat"), F.col("lon")).alias("inside"))


def geo09_laea(spark, sf_dir):
    grid = geo.Laea()
    e, n = grid.forward(F.col("lat"), F.col("lon"))
    lat, lon = grid.inverse(F.col("e"), F.col("n"))
    return views.peaks(spark, sf_dir).withColumns({"e": e, "n": n}).select("id", F.round("e", 4).alias("e"), F.round("n", 4).alias("n"), *_round(lat=lat, lon=lon))


def geo11_envelope(spark, sf_dir):
    """Geographic envelope of each raster with a margin of 100 m."""
    grids = views.dem(spark, sf_dir).select("grid").distinct()
    w, h, m = views.WIDTH * views.CELL, views.HEIGHT * views.CELL, 100.0
    e0 = views.E0 + F.col("grid") * 1000.0
    corner = F.explode(F.array(*(F.struct((e0 + dx).alias("e"), F.lit(views.N0 + dy).alias("n")) for dx in (-m, w + m) for dy in (m, -h - m))))
    at = grids.select("grid", corner.alias("p")).select("grid", *(c.alias(n) for n, c in zip(("lat", "lon"), geo.from_lv95(F.col("p.e"), F.col("p.n")), strict=True)))
    return at.groupBy("grid").agg(*(F.round(f(c), 6).alias(n) for n, f, c in (("south", F.min, "lat"), ("west", F.min, "lon"), ("north", F.max, "lat"), ("east", F.max, "lon"))))


def geo12_bbox_split(spark, sf_dir):
    k = F.col("id")
    at = views.peaks(spark, sf_dir).select("id", (k * 37 % 179 - 89 + 0.25).alias("lat"), (k * 53 % 360 - 180 + 0.5).alias("lon"))
    return at.select("id", F.posexplode(geo.bboxes(F.col("lat"), F.col("lon"), 200_000.0)).alias("box", "b")).select("id", F.col("box").cast("long").alias("box"), *(F.round(f"b.{c}", 6).alias(c) for c in ("south", "west", "north", "east")))


def geo13_keys(spark, sf_dir):
    step = 0.005
    lat, lon = (text.half_up(F.col(c) * 100) / 100 for c in ("lat", "lon"))
    return views.peaks(spark, sf_dir).select("id", F.format_string("%.2f,%.2f,%dkm", lat, lon, F.lit(200)).alias("key"), *_round(south=F.floor(F.col("lat") / step) * step, north=F.ceil((F.col("lat") + 0.01) / step) * step))


def geo14_16_rays(spark, sf_dir):
    k = F.col("id")
    x, y = geo.ray_pixel(HOME[0], HOME[1], F.radians(k % 360 * 1.0), k % 200 * 1000.0 / geo.EARTH_RADIUS_M, 256.0 * 2**11)
    zoom = F.when(k % 200 <= 20, 12).when(k % 200 <= 60, 11).when(k % 200 <= 150, 10).otherwise(9)
    steps = (0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 45.0, 90.0)
    grid = F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, steps)), lambda s: s * (k % 60 + 1) >= 80)), F.lit(90.0))
    return views.peaks(spark, sf_dir).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), zoom.cast("long").alias("zoom"), F.pmod(text.half_up(F.col("lon") * 10), F.lit(3600)).cast("long").alias("ray"), grid.alias("step"))


def sf01_05_factors(spark, sf_dir):
    d = F.when(F.col("event_id") % 50 == 0, float("inf")).when(F.col("event_id") % 51 == 0, None).otherwise(F.col("event_id") % 900 * 1.0)
    e = table(spark, sf_dir, "events").withColumn("d", d)
    d = F.col("d")
    return e.select("event_id", *_round(fade=factors.fade(F.col("event_id") % 15 * 1.0, 5.0, 10.0), quiet=factors.trail_quiet(d), near=factors.nearness(d, 300.0, 0.15), far=factors.remoteness(d, 400.0, 0.5), liked=factors.preference(d, 800.0, 0.6), shunned=factors.preference(d, -100.0, 0.6), limit=factors.slope_limit(F.col("event_id") % 8 * 1.0)))


def sf06_depth(spark, sf_dir):
    d = F.col("event_id") % 3000 * 100.0
    return table(spark, sf_dir, "events").select("event_id", factors.band(d).cast("long").alias("band"), *_round(depth=factors.depth(d, 200_000.0), line=factors.snowline(F.col("event_id") % 90 - 45.0), snow=factors.snow_band(F.col("event_id") % 5000 * 1.0, F.lit(2700.0), d + 1)))


def js01_parse_ele(spark, sf_dir):
    return views.peaks(spark, sf_dir).select("id", F.round(text.parse_elevation(F.col("ele_text")), 4).alias("ele"))


def js02_in_force(spark, sf_dir):
    return views.periods(spark, sf_dir).select("id", text.in_force(F.col("period"), F.col("month"), F.col("day")).alias("in_force"))


def js11_13_text(spark, sf_dir):
    k = F.col("event_id")
    d = F.when(k % 17 == 0, float("inf")).when(k % 19 == 0, None).otherwise(k % 15000 + 0.5)
    parts = F.concat_ws(", ", F.concat(text.half_up(k % 40 + 0.5), F.lit("° slope")), text.near_text("a trail", F.col("d")), text.near_text("water", F.col("d") * 2), F.when(k % 3 == 0, F.concat(F.lit("in reserve: R"), k % 7, F.when(k % 2 == 0, " (not in force today)").otherwise(""))))
    return table(spark, sf_dir, "events").withColumn("d", d).select("event_id", text.format_bearing(k % 800 - 200 + 0.5).alias("bearing"), text.format_signed(k % 5 * 100 - 200).alias("signed"), parts.alias("line"))


def js10_slug_query(spark, sf_dir):
    t = F.concat(F.lit("  "), F.col("p_name"), F.lit(" É-Öst  "), F.col("p_partkey") % 10)
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(t).alias("slug"), text.normal_query(F.when(F.col("p_partkey") % 9 == 0, " x ").otherwise(t)).alias("query"), text.zoom_for_span(F.col("p_partkey") % 50 * 3.0).cast("long").alias("zoom"))


def js12_settings(spark, sf_dir):
    """Settings clamped and defaulted from JSON; legacy {enabled, maxM} is read too."""
    k = F.col("event_id")
    body = F.when(k % 7 == 0, "garbage").when(k % 7 == 1, '{"slope": 99, "near": {"enabled": false, "maxM": 5}}').when(k % 7 == 2, '{"near": {"enabled": true, "maxM": 250}, "area": 3}').otherwise(F.format_string('{"slope": %d, "area": %d, "near": %d}', k % 20, k % 5, k % 3000 - 1500))
    e = table(spark, sf_dir, "events").withColumn("j", body)
    number = lambda p: F.get_json_object("j", p).try_cast("double")
    near = F.when(F.get_json_object("j", "$.near.enabled") == "false", 0.0).otherwise(F.coalesce(number("$.near.maxM"), number("$.near")))
    clamp = lambda x, lo, hi, default: F.coalesce(F.least(F.lit(hi), F.greatest(F.lit(lo), x)), F.lit(default))
    least = lambda x: F.when(x.isin(0.5, 1.0, 2.0, 4.0), x).otherwise(2.0)
    slope = F.when(number("$.slope").isNotNull(), clamp(number("$.slope"), 1.0, 15.0, 5.0)).otherwise(5.0)
    return e.select("event_id", slope.alias("slope"), factors.slope_limit(slope).alias("slope_max"), F.when(near.isNotNull(), clamp(near, -1000.0, 1000.0, 300.0)).otherwise(300.0).alias("near"), least(number("$.area")).alias("area"))


def js15_hash(spark, sf_dir):
    h = text.hash_pair(F.col("event_id"), F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", h.alias("h"), F.round(h / 4294967296.0, 9).alias("u"))


STOPS = [(0, 0, 4), (81, 18, 124), (183, 55, 121), (252, 137, 97), (252, 253, 191)]


def js16_palette(spark, sf_dir):
    c = text.palette_colour(STOPS, F.col("event_id") % 300 / 255.0 - 0.05)
    return table(spark, sf_dir, "events").withColumn("c", c).select("event_id", *(text.half_up(F.get("c", F.lit(i))).cast("long").alias(n) for i, n in enumerate("rgb")))


def snk04_share_link(spark, sf_dir):
    """Only known keys with allowed values are read from a link."""
    k = F.col("event_id")
    url = F.concat(F.lit("https://x.example/camping?km="), F.element_at(F.array(*map(F.lit, ("1", "2", "9", "4", "x"))), (k % 5 + 1).cast("int")), F.lit("&layer="), F.when(k % 3 == 0, "slope").when(k % 3 == 1, "nope").otherwise("score"), F.lit("&u=1"))
    e = table(spark, sf_dir, "events").withColumn("q", F.str_to_map(F.parse_url(url, F.lit("QUERY")), F.lit("&"), F.lit("=")))
    return e.select("event_id", F.when(F.col("q")["km"].isin("0.5", "1", "2", "4"), F.col("q")["km"].cast("double")).alias("km"), F.when(F.col("q")["layer"].isin("score", "slope", "roughness"), F.col("q")["layer"]).alias("layer"))


def src02_terrarium(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (k % 256 * 256 + k * 7 % 256 + k * 13 % 256 / 256.0 - 32768).alias("elev"))


def js14_urls(spark, sf_dir):
    """Addresses of feature queries around points; every third has no layer."""
    k = F.col("c_custkey")
    west, south = k % 300 * 0.5, k % 90 * 0.25
    box = text.box_text(west, south, west + 0.5, south + 0.25)
    url = text.query_url("https://example.org/query", {"bbox": box, "layer": F.when(k % 3 > 0, F.concat(F.lit("a/b&c"), k)), "f": F.lit("json")})
    return table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"))


def snk03_settings(spark, sf_dir):
    """Sanitised settings as the JSON that is stored."""
    s = js12_settings(spark, sf_dir)
    return s.select("event_id", F.to_json(F.struct("slope", "near", "area")).alias("json"))


def src23_blocks(spark, sf_dir):
    """Blocks of 1 MiB that a closed byte range touches, and the bytes of each."""
    k, size = F.col("event_id"), 1 << 20
    header = F.when(k % 11 == 0, "bytes=5-").when(k % 13 == 0, "bytes=9-3").otherwise(F.format_string("bytes=%d-%d", k * 1000, k * 1000 + k % 5 * 900000))
    m = lambda i: F.regexp_extract("h", "^bytes=([0-9]+)-([0-9]+)$", i).try_cast("long")
    e = table(spark, sf_dir, "events").withColumn("h", header).select("event_id", m(1).alias("a"), m(2).alias("b")).filter("b >= a")
    e = e.select("event_id", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))).alias("block"))
    start = F.col("block") * size
    return e.select("event_id", "block", (F.greatest("a", start) - start).alias("first"), (F.least(F.col("b"), start + size - 1) - start).alias("last"))


_R, _C = "6371000.0::DOUBLE", "0.87::DOUBLE"
_DIST = f"2 * {_R} * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - 46.5) / 2), 2) + cos(radians(46.5::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 8.5) / 2), 2))))"
_BRG = "fmod(fmod(degrees(atan2(sin(radians(lon - 8.5)) * cos(radians(lat)), cos(radians(46.5::DOUBLE)) * sin(radians(lat)) - sin(radians(46.5::DOUBLE)) * cos(radians(lat)) * cos(radians(lon - 8.5)))), 360) + 360, 360)"


def _near(d: str, most: str, floor: str) -> str:
    return f"CASE WHEN {d} IS NULL OR {d} <= {most} THEN 1.0::DOUBLE WHEN isinf({d}) THEN {floor}::DOUBLE ELSE {floor}::DOUBLE + (1 - {floor}::DOUBLE) * greatest(0.0::DOUBLE, 1 - ({d} - {most}) / {most}) END"


def _far(d: str, least: str, floor: str) -> str:
    return f"CASE WHEN {d} < {least} THEN {floor}::DOUBLE + (1 - {floor}::DOUBLE) * ({d} / {least}) ELSE 1.0::DOUBLE END"


_KM = "CASE WHEN {d} < 1000 THEN (floor({d} / 10 + 0.5) * 10)::BIGINT || ' m' WHEN {d} / 1000 < 10 THEN printf('%.1f km', {d} / 1000) ELSE floor({d} / 1000 + 0.5)::BIGINT || ' km' END"
_LAEA = geo.Laea()

SQL = {
    "geo01_06_geodesy": with_views(
        f"""+x AS (SELECT *, {_DIST} AS dist, {_BRG} AS az, radians((id % 360)::DOUBLE) AS th, id * 17.0::DOUBLE / {_R} AS de, radians(46.5::DOUBLE) AS ph FROM peaks),
        y AS (SELECT *, sin(ph) * cos(de) + cos(ph) * sin(de) * cos(th) AS s FROM x)
        SELECT id, round(dist * dist / (2 * {_R}) * {_C}, 6) AS drop, round(degrees(atan2(id % 4000 - dist * dist / (2 * {_R}) * {_C} - 500, dist)), 6) AS angle,
        round(fmod(fmod(lon * 40 - 500 + 180, 360) + 360, 360) - 180, 6) AS wrapped, round(degrees(asin(s)), 6) AS to_lat,
        round(fmod(fmod(degrees(radians(8.5::DOUBLE) + atan2(sin(th) * sin(de) * cos(ph), cos(de) - sin(ph) * s)) + 180, 360) + 360, 360) - 180, 6) AS to_lon, round(dist, 6) AS dist, round(az, 6) AS az FROM y""",
        "peaks",
    ),
    "geo07_tiles": with_views("SELECT id, round((lon + 180) / 360 * 4096, 6) AS x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096, 6) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon, round(156543.03::DOUBLE * cos(radians(lat)) / 4096, 6) AS mpp FROM peaks", "peaks"),
    "geo10_box": "SELECT event_id, 45 + event_id % 400 / 100.0::DOUBLE BETWEEN 45.8 AND 47.85 AND 5 + event_id * 7 % 700 / 100.0::DOUBLE BETWEEN 5.9 AND 10.55 AS inside FROM events",
    "geo08_lv95": with_views(
        """+x AS (SELECT *, (lat * 3600 - 169028.66::DOUBLE) / 10000 AS p, (lon * 3600 - 26782.5::DOUBLE) / 10000 AS l FROM peaks),
        y AS (SELECT *, 2600072.37::DOUBLE + 211455.93::DOUBLE*l - 10938.51::DOUBLE*l*p - 0.36::DOUBLE*l*p*p - 44.54::DOUBLE*l*l*l AS e,
          1200147.07::DOUBLE + 308807.95::DOUBLE*p + 3745.25::DOUBLE*l*l + 76.63::DOUBLE*p*p - 194.56::DOUBLE*l*l*p + 119.79::DOUBLE*p*p*p AS n FROM x),
        z AS (SELECT *, (e - 2600000) / 1e6::DOUBLE AS v, (n - 1200000) / 1e6::DOUBLE AS w FROM y)
        SELECT id, round(e, 4) AS e, round(n, 4) AS n,
          round((16.9023892::DOUBLE + 3.238272::DOUBLE*w - 0.270978::DOUBLE*v*v - 0.002528::DOUBLE*w*w - 0.0447::DOUBLE*v*v*w - 0.014::DOUBLE*w*w*w) * 100 / 36, 6) AS lat,
          round((2.6779094::DOUBLE + 4.728982::DOUBLE*v + 0.791484::DOUBLE*v*w + 0.1306::DOUBLE*v*w*w - 0.0436::DOUBLE*v*v*v) * 100 / 36, 6) AS lon,
          lat BETWEEN 45.8 AND 47.85 AND lon BETWEEN 5.9 AND 10.55 AS inside FROM z""",
        "peaks",
    ),
    "geo09_laea": with_views(
        f"""+k AS (SELECT {_LAEA.e2!r}::DOUBLE AS e2, {_LAEA.e!r}::DOUBLE AS ex),
        x AS (SELECT p.*, radians(lon - 10) AS dl, asin((1 - e2) * (sin(radians(lat)) / (1 - e2 * pow(sin(radians(lat)), 2)) - 1 / (2 * ex) * ln((1 - ex * sin(radians(lat))) / (1 + ex * sin(radians(lat))))) /
          ((1 - e2) * (1 / (1 - e2) - 1 / (2 * ex) * ln((1 - ex) / (1 + ex))))) AS be FROM peaks p, k),
        y AS (SELECT *, {_LAEA.radius!r}::DOUBLE * sqrt(2 / (1 + {_LAEA.sb!r}::DOUBLE * sin(be) + {_LAEA.cb!r}::DOUBLE * cos(be) * cos(dl))) AS b FROM x)
        SELECT id, round(4321000 + b * {_LAEA.d!r}::DOUBLE * cos(be) * sin(dl), 4) AS e, round(3210000 + b / {_LAEA.d!r}::DOUBLE * ({_LAEA.cb!r}::DOUBLE * sin(be) - {_LAEA.sb!r}::DOUBLE * cos(be) * cos(dl)), 4) AS n, round(lat, 6) AS lat, round(lon, 6) AS lon FROM y""",
        "peaks",
    ),
    "geo11_envelope": with_views(
        """+c AS (SELECT DISTINCT grid, (2722000 + grid * 1000.0::DOUBLE + dx - 2600000) / 1e6::DOUBLE AS v, (1205000 + dy - 1200000)::DOUBLE / 1e6::DOUBLE AS w FROM dem, (VALUES (-100), (300)) a(dx), (VALUES (100), (-300)) b(dy)),
        g AS (SELECT grid, (16.9023892::DOUBLE + 3.238272::DOUBLE*w - 0.270978::DOUBLE*v*v - 0.002528::DOUBLE*w*w - 0.0447::DOUBLE*v*v*w - 0.014::DOUBLE*w*w*w) * 100 / 36 AS lat,
          (2.6779094::DOUBLE + 4.728982::DOUBLE*v + 0.791484::DOUBLE*v*w + 0.1306::DOUBLE*v*w*w - 0.0436::DOUBLE*v*v*v) * 100 / 36 AS lon FROM c)
        SELECT grid, round(min(lat), 6) AS south, round(min(lon), 6) AS west, round(max(lat), 6) AS north, round(max(lon), 6) AS east FROM g GROUP BY grid""",
        "dem",
    ),
    "geo12_bbox_split": """WITH p AS (SELECT c_custkey AS id, (c_custkey * 37) % 179 - 89 + 0.25::DOUBLE AS lat, (c_custkey * 53) % 360 - 180 + 0.5::DOUBLE AS lon, 200000 / 111194.9::DOUBLE AS h FROM customer),
        q AS (SELECT *, CASE WHEN abs(lat) + h >= 89 THEN 180.0::DOUBLE ELSE h / cos(radians(abs(lat) + h)) END AS w FROM p),
        r AS (SELECT id, 0::BIGINT AS box, lat, h, CASE WHEN w >= 180 THEN -180.0::DOUBLE WHEN lon - w < -180 THEN lon - w + 360 ELSE lon - w END AS west,
          CASE WHEN w >= 180 OR lon - w < -180 OR lon + w > 180 THEN 180.0::DOUBLE ELSE lon + w END AS east FROM q
          UNION ALL SELECT id, 1, lat, h, -180.0::DOUBLE, CASE WHEN lon - w < -180 THEN lon + w ELSE lon + w - 360 END FROM q WHERE w < 180 AND (lon - w < -180 OR lon + w > 180))
        SELECT id, box, round(greatest(-90.0::DOUBLE, lat - h), 6) AS south, round(west, 6) AS west, round(least(90.0::DOUBLE, lat + h), 6) AS north, round(east, 6) AS east FROM r""",
    "geo13_keys": with_views("SELECT id, printf('%.2f,%.2f,%dkm', floor(lat * 100 + 0.5) / 100, floor(lon * 100 + 0.5) / 100, 200) AS key, round(floor(lat / 0.005::DOUBLE) * 0.005::DOUBLE, 6) AS south, round(ceil((lat + 0.01::DOUBLE) / 0.005::DOUBLE) * 0.005::DOUBLE, 6) AS north FROM peaks", "peaks"),
    "geo14_16_rays": with_views(
        f"""+x AS (SELECT *, radians((id % 360)::DOUBLE) AS th, (id % 200) * 1000.0::DOUBLE / {_R} AS de, radians(46.5::DOUBLE) AS ph FROM peaks),
        y AS (SELECT *, greatest(-sin(radians(85.05::DOUBLE)), least(sin(radians(85.05::DOUBLE)), sin(ph) * cos(de) + cos(ph) * sin(de) * cos(th))) AS s FROM x)
        SELECT id, round((radians(8.5::DOUBLE) + atan2(sin(th) * sin(de) * cos(ph), cos(de) - sin(ph) * s) + pi()) / (2 * pi()) * 524288, 4) AS x, round((0.5::DOUBLE - ln((1 + s) / (1 - s)) / (4 * pi())) * 524288, 4) AS y,
        CASE WHEN id % 200 <= 20 THEN 12 WHEN id % 200 <= 60 THEN 11 WHEN id % 200 <= 150 THEN 10 ELSE 9 END::BIGINT AS zoom, floor(lon * 10 + 0.5)::BIGINT % 3600 AS ray,
        coalesce((SELECT min(s) FROM (VALUES (0.5::DOUBLE), (1), (2), (5), (10), (15), (30), (45), (90)) v(s) WHERE s * (id % 60 + 1) >= 80), 90.0::DOUBLE) AS step FROM y""",
        "peaks",
    ),
    "sf01_05_factors": f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 51 = 0 THEN NULL ELSE (event_id % 900)::DOUBLE END AS d,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, (event_id % 15 - 5) / 5.0::DOUBLE)) AS t, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (d - 8) / 52.0::DOUBLE)) AS u, (event_id % 8)::DOUBLE AS ok FROM events)
        SELECT event_id, round(1 - t * t * (3 - 2 * t), 6) AS fade, round(CASE WHEN d < 8 THEN 0.2::DOUBLE WHEN d IS NULL THEN NULL ELSE 0.2::DOUBLE + 0.8::DOUBLE * u * u * (3 - 2 * u) END, 6) AS quiet,
        round({_near("d", "300", "0.15")}, 6) AS near, round({_far("d", "400", "0.5")}, 6) AS far, round({_near("d", "800", "0.6")}, 6) AS liked, round({_far("d", "100", "0.6")}, 6) AS shunned, round(greatest(2 * ok, ok + 3), 6) AS limit FROM x""",
    "sf06_depth": """WITH x AS (SELECT event_id, (event_id % 3000) * 100.0::DOUBLE AS d, event_id % 5000 - 2700.0::DOUBLE AS up FROM events)
        SELECT event_id, CASE WHEN d < 5000 THEN 0 WHEN d < 15000 THEN 1 WHEN d < 40000 THEN 2 WHEN d < 100000 THEN 3 ELSE 4 END::BIGINT AS band,
        round(least(1.0::DOUBLE, ln(greatest(d, 1000) / 1000) / ln(200::DOUBLE)), 6) AS depth, round(5300 - 55 * abs(event_id % 90 - 45.0::DOUBLE), 6) AS line,
        round(CASE WHEN up <= 0 THEN 0.0::DOUBLE ELSE degrees(atan2(least(up * 0.6::DOUBLE, 900), d + 1)) END, 6) AS snow FROM x""",
    "js01_parse_ele": with_views(
        r"""+x AS (SELECT id, lower(trim(ele_text)) AS s, regexp_replace(regexp_extract(lower(trim(ele_text)), '-?[0-9][0-9,.'' ]*'), '['' ]', '', 'g') AS n FROM peaks),
        y AS (SELECT id, s, CASE WHEN regexp_matches(n, '^-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$') THEN replace(n, ',', '') ELSE regexp_replace(n, ',', '.') END AS n FROM x),
        z AS (SELECT id, TRY_CAST(n AS DOUBLE) * CASE WHEN regexp_matches(s, '\bft\b|feet') THEN 0.3048::DOUBLE ELSE 1 END AS v FROM y) SELECT id, round(CASE WHEN v BETWEEN -500 AND 9000 THEN v END, 4) AS ele FROM z""",
        "peaks",
    ),
    "js02_in_force": with_views(
        r"""+r AS (SELECT id, month * 100 + day AS t, unnest(regexp_extract_all(period, '[0-9]{1,2}\.[0-9]{1,2}\.?\s*[-–]\s*[0-9]{1,2}\.[0-9]{1,2}\.?')) AS x FROM periods),
        v AS (SELECT id, t, regexp_extract(x, '^([0-9]+)\.([0-9]+)', 2)::INT * 100 + regexp_extract(x, '^([0-9]+)\.([0-9]+)', 1)::INT AS a, regexp_extract(x, '[-–]\s*([0-9]+)\.([0-9]+)', 2)::INT * 100 + regexp_extract(x, '[-–]\s*([0-9]+)\.([0-9]+)', 1)::INT AS b FROM r),
        w AS (SELECT id, bool_or(CASE WHEN a <= b THEN t BETWEEN a AND b ELSE t >= a OR t <= b END) AS hit FROM v GROUP BY id) SELECT p.id, coalesce(hit, true) AS in_force FROM periods p LEFT JOIN w USING (id)""",
        "periods",
    ),
    "js11_13_text": f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 15000 + 0.5::DOUBLE END AS d, (floor(((event_id % 800 - 200 + 0.5::DOUBLE) % 360 + 360) % 360 + 0.5))::BIGINT % 360 AS g, event_id % 5 * 100 - 200 AS v FROM events)
        SELECT event_id, g || '° ' || ['N','NE','E','SE','S','SW','W','NW'][floor(g / 45.0::DOUBLE + 0.5)::BIGINT % 8 + 1] AS bearing, CASE WHEN v = 0 THEN 'Off' WHEN v > 0 THEN '+' || v || ' m' ELSE '-' || abs(v) || ' m' END AS signed,
        concat_ws(', ', (event_id % 40 + 1) || '° slope', CASE WHEN isinf(d) THEN 'no a trail in this box' ELSE {_KM.format(d="d")} || ' from a trail' END, CASE WHEN isinf(d) THEN 'no water in this box' ELSE {_KM.format(d="(d*2)")} || ' from water' END,
        CASE WHEN event_id % 3 = 0 THEN 'in reserve: R' || event_id % 7 || CASE WHEN event_id % 2 = 0 THEN ' (not in force today)' ELSE '' END END) AS line FROM x""",
    "js10_slug_query": r"""WITH x AS (SELECT p_partkey, '  ' || p_name || ' É-Öst  ' || p_partkey % 10 AS t FROM part)
        SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN p_partkey % 9 <> 0 THEN lower(regexp_replace(trim(t), '\s+', ' ', 'g')) END AS query,
        CASE WHEN p_partkey % 50 = 0 THEN 14 ELSE greatest(3, least(15, floor(log2(360 / (p_partkey % 50 * 3.0::DOUBLE))) + 1)) END::BIGINT AS zoom FROM x""",
    "js12_settings": """WITH x AS (SELECT event_id, event_id % 7 AS c, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 99 WHEN 2 THEN NULL ELSE event_id % 20 END AS s, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 250 ELSE event_id % 3000 - 1500 END AS n,
        CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 3 ELSE event_id % 5 END AS a FROM events), y AS (SELECT *, CASE WHEN s IS NULL THEN 5.0::DOUBLE ELSE least(15, greatest(1, s))::DOUBLE END AS slope FROM x)
        SELECT event_id, slope, greatest(2 * slope, slope + 3) AS slope_max, CASE WHEN n IS NULL THEN 300 ELSE least(1000, greatest(-1000, n)) END::DOUBLE AS near, CASE WHEN a IN (1, 2, 4) THEN a ELSE 2 END::DOUBLE AS area FROM y""",
    "js14_urls": """WITH c AS (SELECT c_custkey, c_custkey % 300 * 0.5::DOUBLE AS w, c_custkey % 90 * 0.25::DOUBLE AS s FROM customer) SELECT c_custkey, 'https://example.org/query?bbox=' || w || '%2C' || s || '%2C' || (w + 0.5::DOUBLE) || '%2C' || (s + 0.25::DOUBLE) || CASE WHEN c_custkey % 3 > 0 THEN '&layer=a%2Fb%26c' || c_custkey ELSE '' END || '&f=json' AS url FROM c""",
    "js15_hash": """WITH a AS (SELECT event_id, xor((event_id::HUGEINT * 2654435761 % 4294967296)::BIGINT, (user_id::HUGEINT * 2246822519 % 4294967296)::BIGINT) AS h FROM events),
        b AS (SELECT event_id, (xor(h, h >> 15)::HUGEINT * 739982445 % 4294967296)::BIGINT AS h FROM a), c AS (SELECT event_id, (xor(h, h >> 12)::HUGEINT * 695872825 % 4294967296)::BIGINT AS h FROM b)
        SELECT event_id, xor(h, h >> 15) AS h, round(xor(h, h >> 15) / 4294967296.0::DOUBLE, 9) AS u FROM c""",
    "js16_palette": """WITH s AS (SELECT [0,81,183,252,252] AS r, [0,18,55,137,253] AS g, [4,124,121,97,191] AS b), x AS (SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, event_id % 300 / 255.0::DOUBLE - 0.05::DOUBLE)) * 4 AS x FROM events),
        y AS (SELECT event_id, least(3, floor(x))::INT AS i, x - least(3, floor(x)) AS f FROM x) SELECT event_id, floor(r[i+1] + (r[i+2] - r[i+1]) * f + 0.5)::BIGINT AS r, floor(g[i+1] + (g[i+2] - g[i+1]) * f + 0.5)::BIGINT AS g, floor(b[i+1] + (b[i+2] - b[i+1]) * f + 0.5)::BIGINT AS b FROM y, s""",
    "snk04_share_link": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 3 THEN 4.0::DOUBLE END AS km, CASE event_id % 3 WHEN 0 THEN 'slope' WHEN 2 THEN 'score' END AS layer FROM events",
    "src02_terrarium": "SELECT event_id, event_id % 256 * 256 + event_id * 7 % 256 + (event_id * 13 % 256) / 256.0::DOUBLE - 32768 AS elev FROM events",
    "src23_blocks": """WITH x AS (SELECT event_id, event_id * 1000 AS a, event_id * 1000 + event_id % 5 * 900000 AS b FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0), y AS (SELECT *, unnest(range(a // 1048576, b // 1048576 + 1)) AS block FROM x)
        SELECT event_id, block, greatest(a, block * 1048576) - block * 1048576 AS first, least(b, block * 1048576 + 1048575) - block * 1048576 AS last FROM y""",
}
SQL["snk03_settings"] = f"""SELECT event_id, '{{"slope":' || slope || ',"near":' || near || ',"area":' || area || '}}' AS json FROM ({SQL["js12_settings"]})"""
QUERIES = {n: globals()[n] for n in SQL}
