"""Visibility along rays: DataFrames (scene, ray, i, dist, h), i in order of distance, null h for no data.

Everything is a window per ray, so work spreads over rays; angles stay tangents until a row is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from .ranges import least_in_range
from .sequences import places, selected

#: Zoom by distance, sea under this height, least dip behind a crest (degrees).
BANDS = ((20_000.0, 12), (60_000.0, 11), (150_000.0, 10), (math.inf, 9))
SEA_MAX, DIP = 1.0, 0.03
RAY = ("scene", "ray")
#: Cells of ground (m) by which cones and points meet.
CONE_CELL = 10_000.0


def ray_samples(spark: SparkSession, lat: float, radius: float, step_factor: float = 0.5, max_zoom: int = 15) -> DataFrame:
    """(i, dist, band, zoom, sin_d, cos_d, drop): distances shared by all rays; each band steps on from the last distance of the band before. The bands are few, their samples come from sequences."""
    rows, start, last = [], 0.0, 0.0
    for b, (end, zoom) in enumerate(BANDS):
        if start >= radius:
            break
        end, zoom = min(end, radius), min(zoom, max_zoom)
        step = geo.EQUATOR_PIXEL_M * math.cos(math.radians(lat)) / 2**zoom * step_factor
        n = max(0, math.floor((end - last) / step + 1e-9))
        rows.append((b, zoom, last, step, n))
        last, start = last + n * step, end
    bands = spark.createDataFrame(rows, "band int, zoom int, last double, step double, n long").filter("n > 0")
    out = bands.select("band", "zoom", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"), "last", "step").withColumn("dist", F.col("last") + F.col("k") * F.col("step"))
    delta = F.col("dist") / geo.EARTH_RADIUS_M
    i = F.row_number().over(Window.orderBy("band", "k")) - 1
    return out.select(i.alias("i"), "dist", "band", "zoom", F.sin(delta).alias("sin_d"), F.cos(delta).alias("cos_d"), geo.curvature_drop(F.col("dist")).alias("drop"))


def samples_for(observers: DataFrame, radius: float, step_factor: float = 0.5, max_zoom: int = 15) -> DataFrame:
    """`ray_samples` for many observers (scene, lat): (scene, i, dist, band, zoom, drop). The few bands are columns, their samples sequences, so that observers are only rows."""
    bands, start, last, before = [], 0.0, F.lit(0.0), F.lit(0).cast("long")
    for b, (end, zoom) in enumerate(BANDS):
        if start >= radius:
            break
        end, zoom = min(end, radius), min(zoom, max_zoom)
        step = geo.metres_per_pixel(F.col("lat"), zoom) * step_factor
        n = F.greatest(F.lit(0), F.floor((end - last) / step + 1e-9))
        bands.append(F.struct(F.lit(b).alias("band"), F.lit(zoom).alias("zoom"), last.alias("last"), step.alias("step"), n.alias("n"), before.alias("before")))
        last, before, start = last + n * step, before + n, end
    out = observers.select("scene", F.explode(F.array(*bands)).alias("x")).select("scene", "x.*").filter("n > 0")
    out = out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("dist", F.col("last") + F.col("k") * F.col("step"))
    return out.select("scene", (F.col("before") + F.col("k") - 1).alias("i"), "dist", "band", "zoom", geo.curvature_drop(F.col("dist")).alias("drop"))


def by_ray(points: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """(keys, dist, angle): of ridge points (keys, dist, angle) one row per ray with both as lists, nearest first."""
    both = F.array_sort(F.collect_list(F.struct("dist", "angle")))
    return points.groupBy(*keys).agg(both.alias("_p")).select(*keys, F.col("_p.dist").alias("dist"), F.col("_p.angle").alias("angle"))


def scene_index(points: DataFrame, skyline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ridge points (scene, ridge, ray, dist, angle) to what drawing needs: (scene, ridge, dist, place), each ridge's upper median distance and its place from far to near; the points with below,
    the next lower angle on their ray (-90 under the lowest); and (scene, ray, lowest), the lowest crest of each ray of the skyline (scene, ray, angle), or the skyline where it has none."""
    ridges = selected(points, ["scene", "ridge"], "dist", dist=0.5).drop("n")
    order = places(ridges, ["scene"], [F.col("dist").desc(), "ridge"])
    below = F.coalesce(F.lead("angle").over(Window.partitionBy(*RAY).orderBy(F.col("angle").desc(), "dist")), F.lit(-90.0))
    least = points.groupBy(*RAY).agg(F.min("angle").alias("_a"))
    lowest = skyline.select(*RAY, "angle").join(least, list(RAY), "left").select(*RAY, F.coalesce("_a", "angle").alias("lowest"))
    return order, points.withColumn("below", below), lowest


def by_tile(points: DataFrame, zoom: int) -> DataFrame:
    """Points (lat, lon, ...) dealt and sorted by blocks of two by two tiles, so that lookups of one place come one after another; adds zoom, block_y and block_x."""
    x, y = geo.to_tile(F.col("lat"), F.col("lon"), zoom)
    out = points.withColumn("zoom", F.lit(zoom)).withColumn("block_y", F.floor(F.floor(y) / 2)).withColumn("block_x", F.floor(F.floor(x) / 2))
    return out.repartition("zoom", "block_y", "block_x").sortWithinPartitions("zoom", "block_y", "block_x")


def required_tiles(observers: DataFrame, zoom: int, start: float, end: float, rays: int, size: int = 256) -> DataFrame:
    """(scene, zoom, x, y): tiles that the rays of observers (scene, lat, lon) touch between two distances, with the neighbours that sampling needs; x wraps, y ends at the poles."""
    n = 2**zoom
    pixel = geo.metres_per_pixel(F.col("lat"), zoom)
    coarse = size / 16 * pixel
    walk = observers.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1)))).withColumn("coarse", coarse)
    walk = walk.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil((end - start) / F.col("coarse")).cast("int"))))
    d = F.least(F.lit(end), start + F.col("k") * F.col("coarse"))
    x, y = geo.ray_pixel(F.col("lat"), F.col("lon"), F.radians(F.col("ray") * (360.0 / rays)), d / geo.EARTH_RADIUS_M, float(size * n))
    pad = size / 16 * 0.5 * 1.1 + 2
    lo_x, hi_x, lo_y, hi_y = (F.floor((v + s) / size) for v, s in ((x, -pad), (x, pad), (y, -pad), (y, pad)))
    at = walk.select("scene", F.explode(F.sequence(lo_x, hi_x)).alias("x"), F.greatest(F.lit(0), lo_y).alias("lo"), F.least(F.lit(n - 1), hi_y).alias("hi"))
    return at.select("scene", F.lit(zoom).alias("zoom"), F.pmod("x", F.lit(n)).alias("x"), F.explode(F.sequence("lo", "hi")).alias("y")).distinct()


def visible(samples: DataFrame, observer: float | Column, keys: tuple[str, ...] = RAY) -> DataFrame:
    """Known samples with t (tangent of the apparent angle), sea and visible: t over all before it on the ray. Sea lies at height 0. observer: the eye's height, or a column that has it."""
    known = samples.filter("h IS NOT NULL").withColumn("sea", F.col("h") < SEA_MAX).withColumn("h", F.when(F.col("sea"), 0.0).otherwise(F.col("h")))
    known = known.withColumn("t", (F.col("h") - geo.curvature_drop(F.col("dist")) - observer) / F.col("dist"))
    before = F.max("t").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("before", before).withColumn("visible", F.col("before").isNull() | (F.col("t") > F.col("before")))


def crests(seen: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """(keys, seq, dist, angle, elev): the last visible sample before each hidden run that dips by DIP or more, and always the outermost one."""
    w = Window.partitionBy(*keys).orderBy("i")
    part = seen.withColumn("part", F.sum(F.col("visible").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.max(F.when(F.col("visible"), F.struct("i", "t", "dist", "h"))).alias("top")
    by = part.groupBy(*keys, "part").agg(top, F.min(F.when(~F.col("visible"), F.col("t"))).alias("low"))
    last = F.max("part").over(Window.partitionBy(*keys))
    dip = F.atan("top.t") - F.atan("low") >= math.radians(DIP)
    kept = by.withColumn("last", last).filter((F.col("part") == F.col("last")) | dip)
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("part")) - 1
    return kept.select(*keys, seq.alias("seq"), F.col("top.dist").alias("dist"), F.degrees(F.atan("top.t")).alias("angle"), F.col("top.h").alias("elev"))


def sea_intervals(seen: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """(keys, seq, lo, hi, lo_dist, hi_dist): maximal runs of sea among the visible samples; hidden ones do not part them. Angles in degrees, from the running maximum before the run."""
    w = Window.partitionBy(*keys).orderBy("i")
    line = seen.filter("visible").withColumn("run", F.sum(F.coalesce((F.col("sea") != F.lag("sea").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = line.filter("sea").groupBy(*keys, "run").agg(F.min(F.struct("i", F.coalesce("before", "t").alias("t"), "dist")).alias("a"), F.max(F.struct("i", "t", "dist")).alias("b"))
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("run")) - 1
    angle = lambda c: F.degrees(F.atan(c))
    return by.select(*keys, seq.alias("seq"), angle("a.t").alias("lo"), angle("b.t").alias("hi"), F.col("a.dist").alias("lo_dist"), F.col("b.dist").alias("hi_dist"))


def horizon(seen: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """(keys, angle, dist) of each ray's highest sample, the nearest on a tie."""
    best = F.max(F.struct("t", (-F.col("i")).alias("o"), "dist")).alias("b")
    return seen.groupBy(*keys).agg(best).select(*keys, F.degrees(F.atan("b.t")).alias("angle"), F.col("b.dist").alias("dist"))


def next_lower(crest: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """Adds next_lower, the next crest angle below on the ray (-90 under the lowest)."""
    w = Window.partitionBy(*keys).orderBy(F.col("angle").desc(), F.col("seq"))
    return crest.withColumn("next_lower", F.coalesce(F.lead("angle").over(w), F.lit(-90.0)))


def running_angle(crest: DataFrame, probes: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """As-of join: adds blocking, the angle of the last crest strictly nearer than each probe's limit (keys, id, limit); null if there is none. One shuffle by ray, no join."""
    own = [c for c in probes.columns if c not in (*keys, "limit")]
    empty = lambda names, df: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    both = crest.select(*keys, F.col("dist").alias("limit"), F.col("angle").alias("_a"), F.lit(1).alias("_tag"), *empty(own, probes)).unionByName(probes.select(*keys, "limit", F.lit(None).cast("double").alias("_a"), F.lit(0).alias("_tag"), *own))
    w = Window.partitionBy(*keys).orderBy("limit", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("blocking", F.last("_a", ignorenulls=True).over(w)).filter("_tag = 0").drop("_a", "_tag")


def lowest_in_band(crest: DataFrame, probes: DataFrame, keys: tuple[str, ...] = RAY) -> DataFrame:
    """Range join: (keys, id, low), the lowest crest angle of the ray within [lo, hi] of each probe; null if there is none. A probe meets two rows of a table of minima, whatever its range."""
    return least_in_range(crest, probes.select(*keys, "id", "lo", "hi"), keys).select(*keys, "id", "low")


def sample_tiles(points: DataFrame, tiles: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds elev at global pixels (gx, gy) from square tiles (tx, ty, elev array of size * size), bilinear between pixel centres; keys, such as the zoom, are columns of both.

    The world is as wide as the points' own `world` column in tiles; x wraps, y is held inside; null where a tile is missing. Four pixels are four rows that meet tiles by equi-join.
    """
    world = F.col("world") * size
    fx, fy = F.col("gx") - 0.5, F.col("gy") - 0.5
    p = points.withColumns({"_id": F.monotonically_increasing_id(), "_x": F.floor(fx), "_ty": fy - F.floor(fy), "_y": F.least(F.greatest(F.floor(fy), F.lit(0)), world - 2), "_tx": fx - F.floor(fx)})
    four = p.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1)))))
    four = four.withColumns({"_px": F.pmod(F.col("_x") + F.col("_c.dx"), world), "_py": F.col("_y") + F.col("_c.dy")})
    four = four.withColumns({"tx": F.floor(F.col("_px") / size), "ty": F.floor(F.col("_py") / size), "_at": (F.col("_py") % size * size + F.col("_px") % size).cast("int")})
    met = four.join(tiles, [*keys, "tx", "ty"], "left").withColumn("_v", F.get("elev", F.col("_at")))
    weight = F.abs(1 - F.col("_c.dx") - F.col("_tx")) * F.abs(1 - F.col("_c.dy") - F.col("_ty"))
    total = F.when(F.count("_v") == 4, F.sum(F.col("_v") * weight))
    return met.groupBy("_id", *points.columns).agg(total.alias("elev")).drop("_id")


def highest_near(points: DataFrame, pixels: DataFrame, radius: float, bucket: int = 16, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, px, py, elev): the highest pixel (keys, px, py, elev) whose centre lies within radius of a point (keys, id, gx, gy), the first row by row on a tie. Points visit the buckets around them.

    Several rasters have keys and places of their own each: offsets added to places would lose digits, which decide on the circle's edge.
    """
    r = radius
    reach = lambda v: F.sequence(F.floor((v - r) / bucket), F.floor((v + r) / bucket))
    p = points.select(*keys, "id", "gx", "gy", F.explode(reach(F.col("gx"))).alias("bx")).select(*keys, "id", "gx", "gy", "bx", F.explode(reach(F.col("gy"))).alias("by"))
    met = p.join(pixels.withColumns({"bx": F.floor(F.col("px") / bucket), "by": F.floor(F.col("py") / bucket)}), [*keys, "bx", "by"])
    near = met.filter(F.pow(F.col("px") + 0.5 - F.col("gx"), 2) + F.pow(F.col("py") + 0.5 - F.col("gy"), 2) <= r * r).filter("elev IS NOT NULL")
    best = F.max(F.struct("elev", (-F.col("py")).alias("y"), (-F.col("px")).alias("x"))).alias("b")
    return near.groupBy(*keys, "id").agg(best).select(*keys, "id", (-F.col("b.x")).alias("px"), (-F.col("b.y")).alias("py"), F.col("b.elev").alias("elev"))


def cone_heights(points: DataFrame, cones: DataFrame, base: float = 0.0) -> DataFrame:
    """Adds h at points (id, lat, lon): base plus the heights of cones (clat, clon, height, radius) over them; a cone visits the cells of ground that it covers, where places meet it by equi-join.

    Points of one place have one height, and equal cones count as one with their number, so copies of either cost a row each and never meet one by one.
    """
    same = cones.groupBy("clat", "clon", "height", "radius").agg(F.count("*").alias("_many"))
    c = same.withColumn("_at", F.explode(geo.ground_cells(F.col("clat"), F.col("clon"), F.col("radius"), CONE_CELL)))
    d = geo.distance(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    places_ = points.select("lat", "lon").distinct().withColumn("_at", geo.ground_cell(F.col("lat"), F.col("lon"), CONE_CELL))
    met = places_.join(c.hint("merge"), "_at").withColumn("d", d).filter(F.col("d") < F.col("radius"))
    high = met.groupBy("lat", "lon").agg(F.sum(F.col("_many") * (F.col("height") * (1 - F.col("d") / F.col("radius")))).alias("_h"))
    return points.select("id", "lat", "lon").join(high.hint("merge"), ["lat", "lon"], "left").select("id", "lat", "lon", (F.lit(base) + F.coalesce("_h", F.lit(0.0))).alias("h"))
