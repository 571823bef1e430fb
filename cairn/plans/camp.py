"""Camp spots: terrain, water, distances and protection become one score raster; the best spots follow.

Layers are computed once and kept; a new set of wishes only scores again. An input that is not there is an unknown layer and a warning, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import format_metres, half_up
from ..operators import raster, vector

MARGIN_M, KNOWN_SHARE = 100.0, 0.05
LEVELS = {"score", "slope", "roughness"}


@dataclass
class CampAnalysis:
    """dem: (grid, row, col, z) on `geometry`; features by name: lines (grid, line, seq, e, n) or points (grid, e, n); areas: edges (grid, area, rank, e1, n1, e2, n2)."""

    dem: DataFrame
    geometry: vector.Geometry
    trails: DataFrame | None = None
    water: DataFrame | None = None
    lakes: DataFrame | None = None
    drinking: DataFrame | None = None
    areas: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)

    def known(self) -> DataFrame:
        """(grid, enough): whether a grid has enough cells with data to be analysed."""
        return self.dem.groupBy("grid").agg((F.count("z") >= KNOWN_SHARE * F.count("*")).alias("enough"))

    def _distance(self, name: str, features: DataFrame | None, mark) -> DataFrame | None:
        if features is None:
            self.warnings.append(f"{name}: no data, not counted")
            return None
        return vector.distance_map(self.dem.select("grid").distinct(), features, mark, self.geometry, MARGIN_M).withColumnRenamed("distance", name)

    def layers(self) -> DataFrame:
        """One row per cell: z, slope, roughness, water and the layers that there are. Persisted."""
        g, key = self.geometry, ["grid", "row", "col"]
        out = raster.flat_surface(raster.terrain(self.dem, cell=g.cell, grid=("grid",)), g.width, g.height, grid=("grid",)).withColumnRenamed("flat", "water")
        if self.lakes is not None:
            lake = vector.fill_polygons(self.lakes, g).select(*key).distinct().withColumn("_lake", F.lit(1))
            out = out.join(lake, key, "left").withColumn("water", F.coalesce("_lake", "water")).drop("_lake")
        out = raster.dilate(out, "water", grid=("grid",))
        for name, features, mark in (("trail", self.trails, vector.rasterise_lines), ("water_distance", self.water, vector.rasterise_lines), ("drinking", self.drinking, vector.rasterise_points)):
            d = self._distance(name, features, mark)
            out = out if d is None else out.join(d, key, "left")
        if self.areas is not None:
            order = vector.paint_order(self.areas.select("grid", "area", "rank").distinct()).select("grid", "index", "area", "rank")
            out = out.join(vector.protection_index(self.areas, g).join(order, ["grid", "index"]).drop("index"), key, "left")
        return out.persist(StorageLevel.MEMORY_AND_DISK)

    def score(self, layers: DataFrame, nearby: dict[str, float] | None = None, hide_protected: bool = False, patch: int = 1) -> DataFrame:
        """layers with score, by the wishes: signed distances, and whether areas in force are left out."""
        g, has = self.geometry, set(layers.columns)
        layer = lambda n: F.col(n) if n in has else None
        suit = layers.withColumn("score", raster.suitability(F.col("slope"), F.col("roughness"), F.col("water"), layer("canopy")))
        suit = raster.patch_minimum(suit, "score", g.width, g.height, patch, ("grid",))
        hidden = F.col("rank") == 2 if hide_protected and "rank" in has else None
        return suit.withColumn("score", raster.camp_score(F.col("score"), layer("trail"), layer("water_distance"), layer("drinking"), hidden, nearby))

    def spots(self, scored: DataFrame, count: int = 3, separation: float = 300.0, least: float = 0.5) -> DataFrame:
        """The best spots of each grid with their place and a line of text."""
        g, key = self.geometry, ["grid", "row", "col"]
        best = raster.pick_spots(scored.select(*key, "score"), cell=g.cell, count=count, separation=separation, least=least, grid=("grid",))
        about = scored.drop("score")
        e, n = g.e0 + (F.col("col") + 0.5) * g.cell, g.n0 - (F.col("row") + 0.5) * g.cell
        lat, lon = geo.from_lv95(e, n)
        parts = [F.concat(half_up(F.col("slope")), F.lit("° slope"))]
        parts += [F.when(F.col(c) == float("inf"), f"no {t} in this box").otherwise(F.concat(format_metres(F.col(c)), F.lit(f" from {t}"))) for c, t in (("trail", "a trail"), ("water_distance", "water"), ("drinking", "drinking water")) if c in about.columns]
        title = F.concat(F.lit("#"), F.col("rank_"), F.lit("   score "), half_up(F.col("score") * 100), F.lit(" %"))
        met = best.withColumnRenamed("rank", "rank_").join(about, key)
        return met.select("grid", F.col("rank_").alias("rank"), "row", "col", "score", e.alias("e"), n.alias("n"), lat.alias("lat"), lon.alias("lon"), title.alias("title"), F.concat_ws(", ", *parts).alias("detail"))
