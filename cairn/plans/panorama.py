"""Panorama: from heights along rays to skyline, crests, sea, ridgelines and ranked visible peaks. Rays are the unit of work throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import peaks, rays, ridges


@dataclass
class Panorama:
    """samples: (scene, ray, i, dist, h) of `count` rays; observer: height of the eye in metres, or a column of samples that has it."""

    samples: DataFrame
    observer: float | Column
    count: int

    @classmethod
    def from_tiles(cls, observers: DataFrame, tiles: DataFrame, count: int, radius: float, eye: float = 2.0, max_zoom: int = 12, size: int = 256) -> Panorama:
        """From observers (scene, lat, lon) and tiles (zoom, tx, ty, elev: size * size heights): every sample of every ray by its band's zoom, and the eye `eye` metres above the ground at the finest."""
        own = observers.select("scene", "lat", "lon")
        zoom = min(max_zoom, rays.BANDS[0][1])
        x, y = geo.to_tile(F.col("lat"), F.col("lon"), zoom)
        feet = own.select("scene", (x * size).alias("gx"), (y * size).alias("gy"), F.lit(zoom).alias("zoom"), F.lit(2**zoom).cast("long").alias("world"))
        ground = rays.sample_tiles(feet, tiles, size, ("zoom",)).select("scene", (F.coalesce("elev", F.lit(0.0)) + eye).alias("eye"))
        samples = rays.samples_for(own.select("scene", "lat"), radius, max_zoom=max_zoom)
        heights = heights_along_rays(own, samples, tiles, count, size).join(ground, "scene")
        return cls(heights, F.col("eye"), count)

    def seen(self) -> DataFrame:
        return rays.visible(self.samples, self.observer)

    def crests(self) -> DataFrame:
        return rays.crests(self.seen())

    def horizon(self) -> DataFrame:
        return rays.horizon(self.seen())

    def sea(self) -> DataFrame:
        return rays.sea_intervals(self.seen())

    def ridgelines(self) -> DataFrame:
        return ridges.ridgelines(self.crests(), self.count)

    def ranked_peaks(self, named: DataFrame, lat: float, lon: float, radius: float, scene: int = 0, ground: DataFrame | None = None) -> DataFrame:
        """Visible peaks of (id, lat, lon, name, elev), best first by place. Unknown heights are those of the highest ground (lat, lon, h) around, where ground is given. The eye's height must be a number here."""
        named = named if ground is None else peaks.summit_heights(named, ground)
        crest, sky = (df.filter(F.col("scene") == scene) for df in (self.crests(), self.horizon()))
        seen = peaks.sightings(named, lat, lon, radius).withColumn("scene", F.lit(scene).cast("long"))
        visible = peaks.visible_peaks(seen, crest, self.observer, self.count)
        return peaks.rank(peaks.prominence(visible, crest, sky, self.count))


def heights_along_rays(observers: DataFrame, samples: DataFrame, tiles: DataFrame, count: int, size: int = 256) -> DataFrame:
    """(scene, ray, i, dist, h): samples (scene, i, dist, zoom) on every ray of observers (scene, lat, lon), looked up in tiles (zoom, tx, ty, elev), which meet them by an equi-join; null where one is missing."""
    # Spark takes exploded samples for as few rows as their observers and would send them to every executor by way of the driver.
    at = samples.select("scene", "i", "dist", "zoom").hint("merge").join(observers.select("scene", "lat", "lon"), "scene").withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    n = F.pow(F.lit(2.0), F.col("zoom"))
    x, y = geo.ray_pixel(F.col("lat"), F.col("lon"), F.radians(F.col("ray") * (360.0 / count)), F.col("dist") / geo.EARTH_RADIUS_M, n * size)
    points = at.select("scene", "ray", "i", "dist", "zoom", x.alias("gx"), y.alias("gy"), n.cast("long").alias("world"))
    return rays.sample_tiles(points, tiles, size, ("zoom",)).select("scene", "ray", "i", "dist", F.col("elev").alias("h"))
