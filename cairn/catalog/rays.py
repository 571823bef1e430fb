"""Registered queries of rays, crests, peaks and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import peaks, rays
from ..operators.sequences import running_sums, selected
from ..operators.staging import written
from ..plans import panorama
from ..sources import views
from ..sources.views import table, with_views

OBSERVER, RAYS, HOME, RADIUS = 200.0, 360, (46.5, 8.5), 80_000.0


def _key():
    return [F.col(c).cast("long").alias(c) for c in ("scene", "ray")]


def _seen(spark, sf_dir):
    return rays.visible(views.samples(spark, sf_dir), OBSERVER)


def _crests(spark, sf_dir):
    return rays.crests(_seen(spark, sf_dir))


def wn01_visible(spark, sf_dir):
    return _seen(spark, sf_dir).select(*_key(), F.col("i").cast("long").alias("i"), F.round("t", 9).alias("t"), "sea", "visible")


def wn02_crests(spark, sf_dir):
    return _crests(spark, sf_dir).select(*_key(), F.col("seq").cast("long").alias("seq"), "dist", F.round("angle", 6).alias("angle"), F.round("elev", 6).alias("elev"))


def wn03_sea(spark, sf_dir):
    return rays.sea_intervals(_seen(spark, sf_dir)).select(*_key(), F.col("seq").cast("long").alias("seq"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "lo_dist", "hi_dist")


def wn04_horizon(spark, sf_dir):
    return rays.horizon(_seen(spark, sf_dir)).select(*_key(), F.round("angle", 6).alias("angle"), "dist")


def wn05_next_lower(spark, sf_dir):
    return rays.next_lower(_crests(spark, sf_dir)).select(*_key(), F.col("seq").cast("long").alias("seq"), F.round("next_lower", 6).alias("next_lower"))


def wn07_offsets(spark, sf_dir):
    """Where each ray's crests begin and end in one list of all of a scene."""
    by = _crests(spark, sf_dir).groupBy("scene", "ray").agg(F.count("*").alias("n"))
    return running_sums(by, ["scene"], ["ray"], end=F.col("n")).select(*_key(), (F.col("end") - F.col("n")).alias("begin"), "end")


def _observers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("scene"), (k * 13 % 120 - 60 + 0.25).alias("lat"), (k * 47 % 360 - 180 + 0.1).alias("lon"))


def hz01_samples(spark, sf_dir):
    """Samples of two bands for the observer at every supplier."""
    out = rays.samples_for(_observers(spark, sf_dir), 21_000.0)
    return out.select("scene", F.col("i").cast("long").alias("i"), F.round("dist", 4).alias("dist"), F.col("zoom").cast("long").alias("zoom"), F.round("drop", 6).alias("drop"))


def hz02_tiles(spark, sf_dir):
    return rays.required_tiles(_observers(spark, sf_dir), 9, 1000.0, 60_000.0, 24).select("scene", *(F.col(c).cast("long").alias(c) for c in ("zoom", "x", "y")))


def jn03_asof(spark, sf_dir):
    probes = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") / 30000).cast("long").alias("scene"), (F.col("l_orderkey") % 360).cast("int").alias("ray"), F.col("l_partkey").alias("id")).agg((F.max("l_quantity") * 400).cast("double").alias("limit"))
    return rays.running_angle(_crests(spark, sf_dir), probes).select(*_key(), "id", F.round("blocking", 6).alias("blocking"))


def jn04_band_min(spark, sf_dir):
    q = F.max("l_quantity").cast("double")
    probes = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") / 30000).cast("long").alias("scene"), (F.col("l_orderkey") % 360).cast("int").alias("ray"), F.col("l_partkey").alias("id")).agg((q * 280).alias("lo"), (q * 520).alias("hi"))
    return rays.lowest_in_band(_crests(spark, sf_dir), probes).select(*_key(), "id", F.round("low", 6).alias("low"))


def _sightings(spark, sf_dir):
    p = views.peaks(spark, sf_dir)
    dem = F.when(F.col("id") % 3 == 0, F.col("id") % 3000 + 400.0)
    elev = F.coalesce(text.parse_elevation(F.col("ele_text")), dem)
    return peaks.sightings(p.withColumn("elev", elev), *HOME, RADIUS)


def pk01_sightings(spark, sf_dir):
    return _sightings(spark, sf_dir).select("id", F.round("dist", 4).alias("dist"), F.round("az", 6).alias("az"), F.round("elev", 4).alias("elev"))


def _visible(spark, sf_dir):
    """Every scene's own peaks: those whose id has the scene as its remainder. What the observer sees is written once, for crests and skyline."""
    samples = written(_seen(spark, sf_dir).select("scene", "ray", "i", "dist", "h", "t", "visible"), "seen")
    crest, sky = rays.crests(samples), rays.horizon(samples)
    scenes = (table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0) // 30000 + 1
    seen = _sightings(spark, sf_dir).withColumn("scene", F.col("id") % scenes)
    return peaks.visible_peaks(seen, crest, OBSERVER, RAYS), crest, sky


def pk02_visible(spark, sf_dir):
    return _visible(spark, sf_dir)[0].select("id", F.col("ray").cast("long").alias("ray"), F.round("angle", 6).alias("angle"))


def pk03_prominence(spark, sf_dir):
    seen, crest, sky = _visible(spark, sf_dir)
    return peaks.prominence(seen, crest, sky, RAYS).select("id", F.round("prominence", 6).alias("prominence"))


def tk02_rank(spark, sf_dir):
    seen, crest, sky = _visible(spark, sf_dir)
    out = peaks.prominence(seen, crest, sky, RAYS).withColumn("prominence", F.round("prominence", 6))
    return peaks.rank(out).select("scene", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def jn06_nearest(spark, sf_dir):
    probes = _places(spark, sf_dir).select(F.col("id").alias("probe"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return peaks.nearest(views.peaks(spark, sf_dir), probes, 4000.0).select("probe", "id", F.round("d", 4).alias("d"))


def _places(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (46 + k * 31 % 1000 / 1000.0 + 0.0004).alias("lat"), (8 + k * 57 % 2000 / 1000.0).alias("lon"))


def jn09_anti(spark, sf_dir):
    """Places without a peak within 1,500 m."""
    return peaks.without_near(_places(spark, sf_dir), views.peaks(spark, sf_dir), 1500.0).select("id")


def pk04_heights(spark, sf_dir):
    """Heights of peaks, unknown ones from the highest of the places within 5 km."""
    p = views.peaks(spark, sf_dir).withColumn("elev", text.parse_elevation(F.col("ele_text")))
    ground = _places(spark, sf_dir).withColumn("h", F.when(F.col("id") % 11 > 0, F.col("id") % 900 * 1.0))
    return peaks.summit_heights(p, ground, 5000.0).select("id", F.round("elev", 4).alias("elev"))


def ag09_by_ray(spark, sf_dir):
    """The crests of each ray as lists, nearest first."""
    by = rays.by_ray(_crests(spark, sf_dir))
    return by.select(*_key(), F.size("dist").cast("long").alias("n"), F.get("dist", F.lit(0)).alias("nearest"), F.element_at("dist", -1).alias("farthest"), F.round(F.element_at("angle", -1), 6).alias("last_angle"))


def rn02_scene_index(spark, sf_dir):
    """Painter's order of the ridges (here groups of four rays), their median distance, and how many of their points have a crest below."""
    crest = _crests(spark, sf_dir).withColumn("ridge", F.floor(F.col("ray") / 4))
    order, points, _ = rays.scene_index(crest, rays.horizon(_seen(spark, sf_dir)))
    below = points.groupBy("scene", "ridge").agg(F.count_if(F.col("below") > -90).alias("over"))
    return order.join(below, ["scene", "ridge"]).select("scene", "ridge", "dist", F.col("place").cast("long").alias("place"), "over")


def rn02_lowest(spark, sf_dir):
    """The lowest crest of each ray, or its horizon where it has none nearer than 6 km."""
    crest = _crests(spark, sf_dir).filter("dist < 6000").withColumn("ridge", F.floor(F.col("ray") / 4))
    return rays.scene_index(crest, rays.horizon(_seen(spark, sf_dir)))[2].select(*_key(), F.round("lowest", 6).alias("lowest"))


def hz03_heights(spark, sf_dir):
    """Heights on 16 rays of 1,500 m around every supplier, from tiles of 8 x 8 pixels whose heights follow from their place."""
    obs, count, size, zoom = _observers(spark, sf_dir), 16, 8, 12
    n = 2**zoom
    samples = rays.samples_for(obs.select("scene", "lat"), 1500.0)
    x, y = geo.to_tile(F.col("lat"), F.col("lon"), zoom)
    around = F.explode(F.sequence(F.floor(x) - 2, F.floor(x) + 2)), F.explode(F.sequence(F.floor(y) - 2, F.floor(y) + 2))
    keys = obs.select("lat", "lon", around[0].alias("tx")).select(F.pmod("tx", F.lit(n)).alias("tx"), around[1].alias("ty")).distinct()
    pixel = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: ((F.col("tx") * size + k % size) * 7 % 100 + (F.col("ty") * size + F.floor(k / size)) * 13 % 90) * 1.0)
    tiles = written(keys.select(F.lit(zoom).alias("zoom"), "tx", "ty", pixel.alias("elev")), "tiles")  # so that their size is known, not guessed from the suppliers'
    return panorama.heights_along_rays(obs, samples, tiles, count, size).select(*_key(), F.col("i").cast("long").alias("i"), F.round("h", 4).alias("h"))


def tk05_tile_order(spark, sf_dir):
    """Lookups with the blocks of tiles by which they are dealt and sorted."""
    return rays.by_tile(_observers(spark, sf_dir), 11).select("scene", F.col("zoom").cast("long").alias("zoom"), "block_y", "block_x")


def ag05_median(spark, sf_dir):
    """Upper median of the crest distances of each group of four rays, with its range."""
    points = _crests(spark, sf_dir).withColumn("ridge", F.floor(F.col("ray") / 4))
    return selected(points, ["scene", "ridge"], "dist", median=0.5, least=0.0, most=1.0).drop("n")


def ag06_exaggeration(spark, sf_dir):
    """Vertical exaggeration from the 5 and 95 % places of each scene's sorted horizon."""
    by = selected(rays.horizon(_seen(spark, sf_dir)).withColumn("angle", F.round("angle", 6)), ["scene"], "angle", high=0.95, low=0.05)
    relief = F.greatest(F.lit(0.5), F.col("high") - F.col("low"))
    e = F.least(F.lit(3.0), F.greatest(F.lit(1.0), text.half_up(0.22 * 900 / (relief * 10) * 4) / 4))
    return by.select("scene", F.when(F.col("n") < 2, 1.0).otherwise(e).alias("exaggeration"))


def rn06_envelope(spark, sf_dir, k: int = 5):
    """Highest horizon angle of every k rays; groups without any break the line into parts."""
    h = rays.horizon(_seen(spark, sf_dir)).filter("dist > 2000")
    by = h.groupBy("scene", F.floor(F.col("ray") / k).alias("g")).agg(F.round(F.max("angle"), 6).alias("angle"))
    w = Window.partitionBy("scene").orderBy("g")
    line = F.sum(F.coalesce((F.col("g") - F.lag("g").over(w) > 1).cast("int"), F.lit(0))).over(w)
    return by.withColumn("line", line.cast("long")).select("scene", "line", (F.col("g") * k + (k - 1) / 2).alias("at"), "angle")


def rn03_runs(spark, sf_dir):
    """Parts of ridges (first ray, points) inside a view that may pass north, with one degree of margin."""
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 360).alias("az0"), (F.col("c_custkey") % 90 + 1).alias("last"))
    s = r.withColumn("shift", F.explode(F.array(*map(F.lit, (-360, 0, 360, 720)))))
    a = F.col("az0") + F.col("shift")
    i0, i1 = F.greatest(F.lit(0), F.ceil(299.0 - a - 1e-9)), F.least(F.col("last"), F.floor(431.0 - a + 1e-9))
    return s.select("id", F.col("shift").cast("long").alias("shift"), i0.cast("long").alias("i0"), i1.cast("long").alias("i1")).filter("i0 <= i1")


def rs09_sample(spark, sf_dir):
    """Bilinear heights from tiles of 8 x 8, the embeddings, in a square world that holds them all; x wraps, the tiles that the last row lacks are null."""
    vectors = table(spark, sf_dir, "embeddings")
    world = max(1, math.ceil(math.sqrt(vectors.count())))
    t = vectors.select((F.col("vec_id") % world).alias("tx"), (F.col("vec_id") / world).cast("long").alias("ty"), F.col("embedding").cast("array<double>").alias("elev"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % (world * 800) / 100.0).alias("gx"), (F.col("event_id") * 91 % (world * 800) / 100.0).alias("gy"), F.lit(world).cast("long").alias("world"))
    return rays.sample_tiles(e, t, 8).select("event_id", F.round("elev", 6).alias("elev"))


def rs10_snap(spark, sf_dir):
    k = F.col("c_custkey")
    px = views.dem(spark, sf_dir).select("grid", F.col("col").alias("px"), F.col("row").alias("py"), F.round("z", 3).alias("elev"))
    p = table(spark, sf_dir, "customer").select((k % views.grids(spark, sf_dir)).alias("grid"), k.alias("id"), (k * 17 % 1000 / 10.0).alias("gx"), (k * 29 % 1000 / 10.0).alias("gy"))
    found = rays.highest_near(p, px, 6.0, keys=("grid",))
    return found.select("id", (F.col("grid") * 1000 + F.col("px")).cast("long").alias("px"), F.col("py").cast("long").alias("py"), "elev")


def src04_cones(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select((46 + F.col("s_suppkey") * 31 % 1000 / 1000.0).alias("clat"), (8 + F.col("s_suppkey") * 57 % 2000 / 1000.0).alias("clon"), (F.col("s_suppkey") % 30 * 100.0 + 50).alias("height"), (F.col("s_suppkey") % 9 * 3000.0 + 2000).alias("radius"))
    return rays.cone_heights(views.peaks(spark, sf_dir).select("id", "lat", "lon"), c, 100.0).select("id", F.round("h", 4).alias("h"))


_D = "2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_SEEN = """+kn AS (SELECT scene, ray, i, dist, h < 1 AS sea, CASE WHEN h < 1 THEN 0.0::DOUBLE ELSE h END AS h FROM samples WHERE h IS NOT NULL),
 tt AS (SELECT *, (h - dist * dist / (2 * 6371000.0::DOUBLE) * 0.87::DOUBLE - 200) / dist AS t FROM kn),
 bf AS (SELECT *, max(t) OVER (PARTITION BY scene, ray ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tt),
 seen AS (SELECT *, before IS NULL OR t > before AS visible FROM bf)"""
_CREST = """, isl AS (SELECT *, count(*) FILTER (visible) OVER (PARTITION BY scene, ray ORDER BY i) AS part FROM seen),
 ia AS (SELECT scene, ray, part, max(t) FILTER (visible) AS t, max(dist) FILTER (visible) AS dist, max(h) FILTER (visible) AS h, min(t) FILTER (NOT visible) AS low, max(part) OVER (PARTITION BY scene, ray) AS last FROM isl GROUP BY scene, ray, part),
 crest AS (SELECT scene, ray, row_number() OVER (PARTITION BY scene, ray ORDER BY part) - 1 AS seq, dist, degrees(atan(t)) AS angle, h AS elev FROM ia WHERE part = last OR atan(t) - atan(low) >= radians(0.03::DOUBLE)),
 hz AS (SELECT scene, ray, degrees(atan(max(t))) AS angle, arg_max(dist, t) AS dist FROM seen WHERE visible GROUP BY scene, ray)"""
_PROBE = "SELECT l_orderkey // 30000 AS scene, l_orderkey % 360 AS ray, l_partkey AS id, max(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1, 2, 3"
_ELE = r"""+ps AS (SELECT *, lower(trim(ele_text)) AS s, regexp_replace(regexp_extract(lower(trim(ele_text)), '-?[0-9][0-9,.'' ]*'), '['' ]', '', 'g') AS m FROM peaks),
 pn AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(m, '^-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$') THEN replace(m, ',', '') ELSE regexp_replace(m, ',', '.') END AS DOUBLE) * CASE WHEN regexp_matches(s, '\bft\b|feet') THEN 0.3048::DOUBLE ELSE 1 END AS v FROM ps),
 sg AS (SELECT id, """ + _D.format(a="46.5::DOUBLE", b="lat", c="8.5::DOUBLE", d="lon") + """ AS dist, fmod(fmod(degrees(atan2(sin(radians(lon - 8.5)) * cos(radians(lat)), cos(radians(46.5::DOUBLE)) * sin(radians(lat)) - sin(radians(46.5::DOUBLE)) * cos(radians(lat)) * cos(radians(lon - 8.5)))), 360) + 360, 360) AS az,
   coalesce(CASE WHEN v BETWEEN -500 AND 9000 THEN v END, CASE WHEN id % 3 = 0 THEN id % 3000 + 400.0::DOUBLE END) AS elev FROM pn),
 sight AS (SELECT * FROM sg WHERE dist BETWEEN 300 AND 80000)"""
_VIS = _ELE + _SEEN.replace("+kn", ", kn") + _CREST + """, c0 AS (SELECT * FROM crest), h0 AS (SELECT * FROM hz),
 pa AS (SELECT *, id % (SELECT max(l_orderkey) // 30000 + 1 FROM lineitem) AS scene, degrees(atan2(elev - dist * dist / (2 * 6371000.0::DOUBLE) * 0.87::DOUBLE - 200, dist)) AS angle, floor(az + 0.5)::BIGINT % 360 AS ray FROM sight WHERE elev IS NOT NULL),
 vis AS (SELECT p.scene, p.id, p.ray, p.angle, p.dist, p.az, p.elev FROM pa p ASOF LEFT JOIN c0 ON p.scene = c0.scene AND p.ray = c0.ray AND p.dist * 0.98::DOUBLE > c0.dist WHERE c0.angle IS NULL OR p.angle >= c0.angle - 0.05)"""
_PROM = _VIS + """, off AS (SELECT unnest(range(-6, 7)) AS o), sd AS (SELECT v.id, sign(o) AS side, min(c.angle) AS low FROM vis v JOIN off ON o <> 0 LEFT JOIN c0 c ON c.scene = v.scene AND c.ray = floor(fmod(az + o + 360, 360) + 0.5)::BIGINT % 360 AND c.dist BETWEEN v.dist * 0.7::DOUBLE AND v.dist * 1.3::DOUBLE GROUP BY 1, 2),
 sad AS (SELECT id, max(low) AS saddle FROM sd GROUP BY id), sky AS (SELECT v.id, min(h.angle) AS sky FROM vis v, off JOIN h0 h ON h.scene = v.scene WHERE h.ray = (floor(az + 0.5)::BIGINT + o + 360) % 360 GROUP BY v.id),
 prom AS (SELECT v.*, round(greatest(0.0::DOUBLE, angle - coalesce(saddle, sky, 0)), 6) AS prominence FROM vis v LEFT JOIN sad USING (id) LEFT JOIN sky USING (id))"""
_KEY = "scene, ray::BIGINT AS ray"
_PLACES = "+pl AS (SELECT s_suppkey AS id, 46 + (s_suppkey * 31) % 1000 / 1000.0::DOUBLE + 0.0004::DOUBLE AS lat, 8 + (s_suppkey * 57) % 2000 / 1000.0::DOUBLE AS lon FROM supplier)"


def _on(q: str, tail: str, *views_: str) -> str:
    return with_views(f"{q} {tail}", *views_)


SQL = {
    "wn01_visible": _on(_SEEN, f"SELECT {_KEY}, i::BIGINT AS i, round(t, 9) AS t, sea, visible FROM seen", "samples"),
    "wn02_crests": _on(_SEEN + _CREST, f"SELECT {_KEY}, seq, dist, round(angle, 6) AS angle, round(elev, 6) AS elev FROM crest", "samples"),
    "wn03_sea": _on(
        _SEEN,
        f""", vl AS (SELECT *, CASE WHEN sea <> lag(sea) OVER (PARTITION BY scene, ray ORDER BY i) THEN 1 ELSE 0 END AS turn FROM seen WHERE visible), vr AS (SELECT *, sum(turn) OVER (PARTITION BY scene, ray ORDER BY i) AS run FROM vl),
        si AS (SELECT scene, ray, run, coalesce(arg_min(coalesce(before, t), i), 0) AS lo, max(t) AS hi, min(dist) AS lo_dist, max(dist) AS hi_dist FROM vr WHERE sea GROUP BY scene, ray, run)
        SELECT {_KEY}, row_number() OVER (PARTITION BY scene, ray ORDER BY run) - 1 AS seq, round(degrees(atan(lo)), 6) AS lo, round(degrees(atan(hi)), 6) AS hi, lo_dist, hi_dist FROM si""",
        "samples",
    ),
    "wn04_horizon": _on(_SEEN + _CREST, f"SELECT {_KEY}, round(angle, 6) AS angle, dist FROM hz", "samples"),
    "wn05_next_lower": _on(_SEEN + _CREST, f"SELECT {_KEY}, seq, round(coalesce(lead(angle) OVER (PARTITION BY scene, ray ORDER BY angle DESC, seq), -90), 6) AS next_lower FROM crest", "samples"),
    "wn07_offsets": _on(_SEEN + _CREST, f"SELECT {_KEY}, (sum(n) OVER (PARTITION BY scene ORDER BY ray) - n)::BIGINT AS begin, (sum(n) OVER (PARTITION BY scene ORDER BY ray))::BIGINT AS \"end\" FROM (SELECT scene, ray, count(*) AS n FROM crest GROUP BY scene, ray)", "samples"),
    "hz01_samples": """WITH l AS (SELECT s_suppkey AS scene, (s_suppkey * 13) % 120 - 60 + 0.25::DOUBLE AS lat FROM supplier), a AS (SELECT scene, 156543.03::DOUBLE * cos(radians(lat)) / 4096 * 0.5 AS s1, 156543.03::DOUBLE * cos(radians(lat)) / 2048 * 0.5 AS s2 FROM l), b AS (SELECT *, floor(20000 / s1 + 1e-9)::BIGINT AS n1 FROM a),
        c AS (SELECT *, floor((21000 - n1 * s1) / s2 + 1e-9)::BIGINT AS n2 FROM b), d AS (SELECT scene, unnest(range(1, n1 + 1)) AS k, 0::BIGINT AS past, 0.0::DOUBLE AS last, s1 AS step, 12::BIGINT AS zoom FROM c UNION ALL SELECT scene, unnest(range(1, n2 + 1)), n1, n1 * s1, s2, 11 FROM c)
        SELECT scene, past + k - 1 AS i, round(last + k * step, 4) AS dist, zoom, round(pow(last + k * step, 2) / (2 * 6371000.0::DOUBLE) * 0.87::DOUBLE, 6) AS drop FROM d""",
    "hz02_tiles": """WITH o AS (SELECT s_suppkey AS scene, (s_suppkey * 13) % 120 - 60 + 0.25::DOUBLE AS lat, (s_suppkey * 47) % 360 - 180 + 0.1::DOUBLE AS lon FROM supplier), c AS (SELECT *, 16 * 156543.03::DOUBLE * cos(radians(lat)) / 512 AS coarse FROM o),
        w AS (SELECT *, unnest(range(0, 24)) AS ray FROM c), k AS (SELECT *, unnest(range(0, ceil(59000 / coarse)::BIGINT + 1)) AS k FROM w), d AS (SELECT *, least(60000, 1000 + k * coarse) / 6371000.0::DOUBLE AS de, radians(ray * 15.0::DOUBLE) AS th, radians(lat) AS ph FROM k),
        s AS (SELECT *, greatest(-sin(radians(85.05::DOUBLE)), least(sin(radians(85.05::DOUBLE)), sin(ph) * cos(de) + cos(ph) * sin(de) * cos(th))) AS s FROM d),
        p AS (SELECT scene, (radians(lon) + atan2(sin(th) * sin(de) * cos(ph), cos(de) - sin(ph) * s) + pi()) / (2 * pi()) * 131072 AS x, (0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 131072 AS y FROM s),
        t AS (SELECT scene, y, unnest(range(floor((x - 10.8) / 256)::BIGINT, floor((x + 10.8) / 256)::BIGINT + 1)) AS x FROM p), u AS (SELECT scene, x, unnest(range(greatest(0, floor((y - 10.8) / 256)::BIGINT), least(511, floor((y + 10.8) / 256)::BIGINT) + 1)) AS y FROM t)
        SELECT DISTINCT scene, 9::BIGINT AS zoom, ((x % 512) + 512) % 512 AS x, y FROM u""",
    "jn03_asof": _on(_SEEN + _CREST, f", pb AS ({_PROBE}) SELECT p.scene, p.ray::BIGINT AS ray, p.id, round(c.angle, 6) AS blocking FROM pb p ASOF LEFT JOIN crest c ON p.scene = c.scene AND p.ray = c.ray AND p.q * 400 > c.dist", "samples"),
    "jn04_band_min": _on(_SEEN + _CREST, f", pb AS ({_PROBE}) SELECT p.scene, p.ray::BIGINT AS ray, p.id, round(min(c.angle), 6) AS low FROM pb p LEFT JOIN crest c ON p.scene = c.scene AND p.ray = c.ray AND c.dist BETWEEN q * 280 AND q * 520 GROUP BY ALL", "samples"),
    "pk01_sightings": _on(_ELE, "SELECT id, round(dist, 4) AS dist, round(az, 6) AS az, round(elev, 4) AS elev FROM sight", "peaks"),
    "pk02_visible": _on(_VIS, "SELECT id, ray, round(angle, 6) AS angle FROM vis", "peaks", "samples"),
    "pk03_prominence": _on(_PROM, "SELECT id, prominence FROM prom", "peaks", "samples"),
    "tk02_rank": _on(_PROM, ", sc AS (SELECT *, 0.5::DOUBLE * greatest(0.0::DOUBLE, elev / greatest(1, max(elev) OVER (PARTITION BY scene))) + 0.5::DOUBLE * least(1.0::DOUBLE, prominence / 3) AS score FROM prom) SELECT scene, id, round(score, 6) AS score, row_number() OVER (PARTITION BY scene ORDER BY score DESC, dist, id) AS place FROM sc", "peaks", "samples"),
    "jn06_nearest": _on("+pr AS (SELECT s_suppkey AS probe, 46 + (s_suppkey * 31) % 1000 / 1000.0::DOUBLE + 0.0004::DOUBLE AS plat, 8 + (s_suppkey * 57) % 2000 / 1000.0::DOUBLE AS plon FROM supplier), d AS (SELECT probe, id, " + _D.format(a="plat", b="lat", c="plon", d="lon") + " AS d FROM pr, peaks)", "SELECT probe, id, round(d, 4) AS d FROM d WHERE d <= 4000 QUALIFY row_number() OVER (PARTITION BY probe ORDER BY d, id DESC) = 1", "peaks"),
    "ag05_median": _on(_SEEN + _CREST, ", o AS (SELECT scene, ray // 4 AS ridge, list_sort(list(dist)) AS d FROM crest GROUP BY ALL) SELECT scene, ridge, d[len(d) // 2 + 1] AS median, d[1] AS least, d[len(d)] AS most FROM o", "samples"),
    "ag06_exaggeration": _on(_SEEN + _CREST, ", o AS (SELECT scene, list_sort(list(round(angle, 6))) AS h FROM hz GROUP BY scene), r AS (SELECT scene, len(h) AS n, greatest(0.5::DOUBLE, h[floor(len(h) * 0.95::DOUBLE)::INT + 1] - h[floor(len(h) * 0.05::DOUBLE)::INT + 1]) AS r FROM o) SELECT scene, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE least(3.0::DOUBLE, greatest(1.0::DOUBLE, floor(198 / (r * 10) * 4 + 0.5::DOUBLE) / 4)) END AS exaggeration FROM r", "samples"),
    "rn06_envelope": _on(_SEEN + _CREST, ", g AS (SELECT scene, ray // 5 AS g, round(max(angle), 6) AS angle FROM hz WHERE dist > 2000 GROUP BY 1, 2), b AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY scene ORDER BY g) > 1 THEN 1 ELSE 0 END AS n FROM g) SELECT scene, (sum(n) OVER (PARTITION BY scene ORDER BY g))::BIGINT AS line, g * 5 + 2.0::DOUBLE AS at, angle FROM b", "samples"),
    "rn03_runs": "WITH r AS (SELECT c_custkey AS id, c_custkey * 7 % 360 AS a, c_custkey % 90 + 1 AS last, unnest([-360, 0, 360, 720]) AS shift FROM customer), s AS (SELECT id, shift::BIGINT AS shift, greatest(0, 299 - a - shift)::BIGINT AS i0, least(last, 431 - a - shift)::BIGINT AS i1 FROM r) SELECT * FROM s WHERE i0 <= i1",
    "rs09_sample": """WITH w AS (SELECT ceil(sqrt(count(*)))::BIGINT AS w FROM embeddings), px AS (SELECT (vec_id % w) * 8 + (k - 1) % 8 AS x, (vec_id // w) * 8 + (k - 1) // 8 AS y, embedding[k]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings, w)),
        p AS (SELECT event_id, w, event_id * 37 % (w * 800) / 100.0::DOUBLE - 0.5 AS fx, event_id * 91 % (w * 800) / 100.0::DOUBLE - 0.5 AS fy FROM events, w), q AS (SELECT event_id, fx - floor(fx) AS u, fy - floor(fy) AS v, (floor(fx)::BIGINT + 8 * w) % (8 * w) AS x, (floor(fx)::BIGINT + 8 * w + 1) % (8 * w) AS x2, least(8 * w - 2, greatest(0, floor(fy)))::BIGINT AS y FROM p)
        SELECT event_id, round((a.v * (1 - u) + b.v * u) * (1 - q.v) + (c.v * (1 - u) + d.v * u) * q.v, 6) AS elev FROM q LEFT JOIN px a ON a.x = q.x AND a.y = q.y LEFT JOIN px b ON b.x = x2 AND b.y = q.y LEFT JOIN px c ON c.x = q.x AND c.y = q.y + 1 LEFT JOIN px d ON d.x = x2 AND d.y = q.y + 1""",
    "rs10_snap": _on("+p AS (SELECT c_custkey AS id, c_custkey % (SELECT max(event_id) // 10000 + 1 FROM events) AS g, c_custkey * 17 % 1000 / 10.0::DOUBLE AS gx, c_custkey * 29 % 1000 / 10.0::DOUBLE AS gy FROM customer)", "SELECT p.id, grid * 1000 + col AS px, row::BIGINT AS py, round(z, 3) AS elev FROM p JOIN dem ON grid = g AND z IS NOT NULL AND pow(col + 0.5::DOUBLE - gx, 2) + pow(row + 0.5::DOUBLE - gy, 2) <= 36 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round(z, 3) DESC, row, col) = 1", "dem"),
    "jn09_anti": _on(_PLACES, f"SELECT id FROM pl WHERE NOT EXISTS (SELECT 1 FROM peaks q WHERE {_D.format(a='pl.lat', b='q.lat', c='pl.lon', d='q.lon')} <= 1500)", "peaks"),
    "pk04_heights": _on(_ELE + ", " + _PLACES.removeprefix("+"), f", pe AS (SELECT id, lat, lon, CASE WHEN v BETWEEN -500 AND 9000 THEN v END AS elev FROM pn), g AS (SELECT lat, lon, id % 900 * 1.0::DOUBLE AS h FROM pl WHERE id % 11 > 0) SELECT pe.id, round(coalesce(elev, (SELECT max(h) FROM g WHERE {_D.format(a='pe.lat', b='g.lat', c='pe.lon', d='g.lon')} <= 5000)), 4) AS elev FROM pe", "peaks"),
    "ag09_by_ray": _on(_SEEN + _CREST, f"SELECT {_KEY}, count(*) AS n, min(dist) AS nearest, max(dist) AS farthest, round(arg_max(angle, dist), 6) AS last_angle FROM crest GROUP BY scene, ray", "samples"),
    "rn02_scene_index": _on(_SEEN + _CREST, ", nx AS (SELECT scene, ray // 4 AS ridge, dist, lead(angle) OVER (PARTITION BY scene, ray ORDER BY angle DESC, dist) AS below FROM crest), r AS (SELECT scene, ridge, list_sort(list(dist)) AS d, count(below) AS over FROM nx GROUP BY scene, ridge), m AS (SELECT scene, ridge, d[len(d) // 2 + 1] AS dist, over FROM r) SELECT scene, ridge, dist, row_number() OVER (PARTITION BY scene ORDER BY dist DESC, ridge) AS place, over FROM m", "samples"),
    "rn02_lowest": _on(_SEEN + _CREST, f", l AS (SELECT scene, ray, min(angle) AS a FROM crest WHERE dist < 6000 GROUP BY scene, ray) SELECT h.scene, h.ray::BIGINT AS ray, round(coalesce(l.a, h.angle), 6) AS lowest FROM hz h LEFT JOIN l ON l.scene = h.scene AND l.ray = h.ray", "samples"),
    "hz03_heights": """WITH l AS (SELECT s_suppkey AS scene, (s_suppkey * 13) % 120 - 60 + 0.25::DOUBLE AS lat, (s_suppkey * 47) % 360 - 180 + 0.1::DOUBLE AS lon FROM supplier), a AS (SELECT *, 156543.03::DOUBLE * cos(radians(lat)) / 4096 * 0.5 AS s1 FROM l), b AS (SELECT *, unnest(range(0, floor(1500 / s1 + 1e-9)::BIGINT)) AS i FROM a), c AS (SELECT *, unnest(range(0, 16)) AS ray FROM b),
        d AS (SELECT *, (i + 1) * s1 / 6371000.0::DOUBLE AS de, radians(ray * 22.5::DOUBLE) AS th, radians(lat) AS ph FROM c), s AS (SELECT *, sin(ph) * cos(de) + cos(ph) * sin(de) * cos(th) AS s FROM d),
        p AS (SELECT scene, ray, i, (radians(lon) + atan2(sin(th) * sin(de) * cos(ph), cos(de) - sin(ph) * s) + pi()) / (2 * pi()) * 32768 - 0.5 AS x, (0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 32768 - 0.5 AS y FROM s),
        q AS (SELECT scene, ray, i, x - floor(x) AS u, y - floor(y) AS v, (floor(x)::BIGINT + 32768) % 32768 AS a, (floor(x)::BIGINT + 32769) % 32768 AS b, floor(y)::BIGINT AS c FROM p),
        h AS (SELECT scene, ray, i, u, v, a * 7 % 100 + c * 13 % 90 AS k, b * 7 % 100 + c * 13 % 90 AS l, a * 7 % 100 + (c + 1) * 13 % 90 AS m, b * 7 % 100 + (c + 1) * 13 % 90 AS n FROM q) SELECT scene, ray::BIGINT AS ray, i, round((k * (1 - u) + l * u) * (1 - v) + (m * (1 - u) + n * u) * v, 4) AS h FROM h""",
    "tk05_tile_order": """WITH o AS (SELECT s_suppkey AS scene, (s_suppkey * 13) % 120 - 60 + 0.25::DOUBLE AS lat, (s_suppkey * 47) % 360 - 180 + 0.1::DOUBLE AS lon FROM supplier)
        SELECT scene, 11::BIGINT AS zoom, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 2048)::BIGINT // 2 AS block_y, floor((lon + 180) / 360 * 2048)::BIGINT // 2 AS block_x FROM o""",
    "src04_cones": _on("+c AS (SELECT 46 + (s_suppkey * 31) % 1000 / 1000.0::DOUBLE AS clat, 8 + (s_suppkey * 57) % 2000 / 1000.0::DOUBLE AS clon, s_suppkey % 30 * 100.0::DOUBLE + 50 AS height, s_suppkey % 9 * 3000.0::DOUBLE + 2000 AS radius FROM supplier), d AS (SELECT id, height, radius, " + _D.format(a="lat", b="clat", c="lon", d="clon") + " AS d FROM peaks, c)", "SELECT id, round(100 + sum(CASE WHEN d < radius THEN height * (1 - d / radius) ELSE 0 END), 4) AS h FROM d GROUP BY id", "peaks"),
}
QUERIES = {n: globals()[n] for n in SQL}
