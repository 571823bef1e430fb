"""Heights for windows of ground: tiles of rasters meet windows by their keys, and providers fill a window's cells whatever their own pixels are."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import written
from ..operators.vector import Geometry, resample
from . import rasters

#: Side of a tile (m), most pixels of one answer of a raster service.
TILE_M, MOST_PIXELS = 1000, 1000
#: Cells of windows that one task puts together.
CELLS_A_TASK = 250_000


def window_bounds(east: Column, north: Column, half: float, cell: float) -> dict[str, Column]:
    """e0, n0 (the north-west corner, on the grid of cells), width and height of a square window around a point."""
    size = F.lit(int(2 * half / cell + 0.5))
    return {"e0": F.floor((east - half) / cell) * cell, "n0": F.ceil((north + half) / cell) * cell, "width": size, "height": size}


def tiles_for_window(e0: Column, n0: Column, wide: Column, high: Column) -> Column:
    """array<struct<te, tn>> of the tiles that a window of so many metres touches, by their south-west corners in km."""
    te = F.sequence(F.floor(e0 / TILE_M), F.floor((e0 + wide - 1e-6) / TILE_M))
    tn = F.sequence(F.floor((n0 - high) / TILE_M), F.floor((n0 - 1e-6) / TILE_M))
    return F.flatten(F.transform(te, lambda e: F.transform(tn, lambda n: F.struct(e.alias("te"), n.alias("tn")))))


def load_windows(windows: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """windows(grid, e0, n0, width, height) and tiles(te, tn, west, north, width, height, data: array row by row) of one pixel size to (grid, row, col, z) of every cell; null where no tile is.

    Tiles meet the windows that touch them by an equi-join on their key, and only what both share is unpacked. Tasks are as many as the windows' cells ask for, since Spark knows neither their number nor that of what they find.
    """
    own = windows.select("grid", "e0", "n0", F.col("width").alias("w"), F.col("height").alias("h"))
    keys = own.withColumn("t", F.explode(tiles_for_window(F.col("e0"), F.col("n0"), F.col("w") * cell, F.col("h") * cell))).select("grid", "e0", "n0", "w", "h", "t.te", "t.tn")
    met = keys.join(tiles, ["te", "tn"])
    near = lambda x: F.floor(x + 0.5).cast("int")
    col, row = near((F.col("west") - F.col("e0")) / cell), near((F.col("n0") - F.col("north")) / cell)  # of the tile's first pixel in the window
    met = met.withColumns({"_c": col, "_r": row})
    span = lambda at, size, most: F.sequence(F.greatest(F.lit(0), F.col(at)), F.least(F.col(most), F.col(at) + F.col(size)) - 1)
    met = met.filter("_c < w AND _c + width > 0 AND _r < h AND _r + height > 0").withColumn("row", F.explode(span("_r", "height", "h"))).withColumn("col", F.explode(span("_c", "width", "w")))
    value = F.get("data", (F.col("row") - F.col("_r")) * F.col("width") + F.col("col") - F.col("_c"))
    tasks = 1 + (windows.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0) // CELLS_A_TASK
    found = met.select("grid", "row", "col", F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("z")).repartition(tasks, "grid", "row", "col").groupBy("grid", "row", "col").agg(F.max("z").alias("z"))
    cells = own.select("grid", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"), "w").select("grid", "row", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))
    return cells.repartition(tasks, "grid", "row", "col").join(found, ["grid", "row", "col"], "left")


def tiles_of_files(spark, path: str, step: float, windows: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """tiles for `load_windows` from the GeoTIFFs under a path, of each the level that fits a step. A row is what a block of a file has of one square kilometre, so files may be of any size; with windows (as load_windows takes them, of
    cells of size `cell`), only blocks that one of them touches are read.

    A block's pixels are told apart by the ground of their middles, so every pixel is in one row.
    """
    levels = written(rasters.level_for_step(rasters.tiff_levels(spark, path), step), "levels")
    blocks = rasters.tiff_blocks(levels, level=None)
    edge = lambda zero, at, size, sign: F.col(zero) + sign * F.col(at) * F.col(size) * F.col("pixel")
    rows = F.least(F.col("block_height"), F.col("height") - F.col("block_row") * F.col("block_height"))
    cols = F.least(F.col("block_width"), F.col("width") - F.col("block_col") * F.col("block_width"))
    blocks = blocks.withColumns({"w": edge("west", "block_col", "block_width", 1), "n": edge("north", "block_row", "block_height", -1)})
    if windows is not None:
        touched = tiles_for_window(F.col("w"), F.col("n"), cols * F.col("pixel"), rows * F.col("pixel"))
        keyed = blocks.withColumn("t", F.explode(touched)).withColumns({"te": F.col("t.te"), "tn": F.col("t.tn")})
        own = windows.select("e0", "n0", (F.col("width") * cell).alias("wide"), (F.col("height") * cell).alias("high"))
        own = own.withColumn("t", F.explode(tiles_for_window(F.col("e0"), F.col("n0"), F.col("wide"), F.col("high")))).select("t.te", "t.tn", "e0", "n0", "wide", "high")
        met = keyed.join(own, ["te", "tn"]).filter((F.col("w") < F.col("e0") + F.col("wide")) & (F.col("w") + cols * F.col("pixel") > F.col("e0")) & (F.col("n") > F.col("n0") - F.col("high")) & (F.col("n") - rows * F.col("pixel") < F.col("n0")))
        blocks = blocks.join(met.select("path", "block_row", "block_col").distinct(), ["path", "block_row", "block_col"], "left_semi")
        blocks = rasters.spread(blocks, levels.agg(F.sum(F.size("offsets"))).first()[0] or 0)

    def run(batches):
        for part in batches:
            files = {p: rasters.Pages(p) for p in part["path"].unique()}
            for b in part.itertuples():
                z = rasters.decode_block(files[b.path].read(b.offset, b.count), b.block_width, b.block_height, b.compression, b.predictor, b.sample, None if pd.isna(b.nodata) else b.nodata)
                z = z[: min(b.block_height, b.height - b.block_row * b.block_height), : min(b.block_width, b.width - b.block_col * b.block_width)]
                te = np.floor((b.w + (np.arange(z.shape[1]) + 0.5) * b.pixel) / TILE_M).astype(np.int64)
                tn = np.floor((b.n - (np.arange(z.shape[0]) + 0.5) * b.pixel) / TILE_M).astype(np.int64)
                for i in np.unique(tn):
                    for j in np.unique(te):
                        r, c = np.flatnonzero(tn == i), np.flatnonzero(te == j)
                        yield pd.DataFrame({"te": [j], "tn": [i], "west": [b.w + c[0] * b.pixel], "north": [b.n - r[0] * b.pixel], "width": [len(c)], "height": [len(r)], "data": [z[r[0] : r[-1] + 1, c[0] : c[-1] + 1].ravel()]})

    return blocks.mapInPandas(run, "te long, tn long, west double, north double, width int, height int, data array<float>")


class TerrainSource(Protocol):
    """Where a country's heights come from: both methods fill a window's cells exactly."""

    def terrain(self, grid: int, geometry: Geometry) -> DataFrame:
        """(grid, row, col, z): bare ground, one value a cell, null where there is none."""

    def surface(self, grid: int, geometry: Geometry, factor: int) -> DataFrame:
        """(grid, row, col, surface): arrays of factor * factor heights with trees and buildings, row by row within the cell."""


def _cells(spark, grid: int, geometry: Geometry) -> DataFrame:
    cells = spark.range(geometry.height).select(F.lit(grid).cast("long").alias("grid"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(geometry.width - 1))).alias("col"))
    return cells


@dataclass
class TiledSource:
    """Tiles whose pixels are the window's cells (terrain) and parts of cells (surface, of pixel cell / factor)."""

    ground: DataFrame
    above: DataFrame

    def terrain(self, grid: int, geometry: Geometry) -> DataFrame:
        return load_windows(_window(self.ground.sparkSession, grid, geometry, 1), self.ground, geometry.cell)

    def surface(self, grid: int, geometry: Geometry, factor: int) -> DataFrame:
        parts = load_windows(_window(self.above.sparkSession, grid, geometry, factor), self.above, geometry.cell / factor)
        return _grouped(parts.withColumnRenamed("z", "value"), factor)


@dataclass
class FileSource:
    """GeoTIFFs under two paths, whose pixels at the level that fits are the window's cells (ground) and parts of cells (above): only blocks that a window touches are read."""

    spark: SparkSession
    ground: str
    above: str

    def windows(self, windows: DataFrame, cell: float) -> DataFrame:
        """(grid, row, col, z) of many windows (grid, e0, n0, width, height) at once."""
        return load_windows(windows, tiles_of_files(self.spark, self.ground, cell, windows, cell), cell)

    def terrain(self, grid: int, geometry: Geometry) -> DataFrame:
        return self.windows(_window(self.spark, grid, geometry, 1), geometry.cell)

    def surface(self, grid: int, geometry: Geometry, factor: int) -> DataFrame:
        window, cell = _window(self.spark, grid, geometry, factor), geometry.cell / factor
        return _grouped(load_windows(window, tiles_of_files(self.spark, self.above, cell, window, cell), cell).withColumnRenamed("z", "value"), factor)


@dataclass
class RasterSource:
    """One raster of any pixel size for ground and one for what stands on it, as (row, col, v) from a corner: ground is taken between pixel centres, the rest from the nearest pixel."""

    ground: DataFrame
    above: DataFrame
    west: float
    north: float
    pixel: float
    width: int
    height: int

    def _taken(self, raster: DataFrame, grid: int, geometry: Geometry, factor: int, nearest: bool) -> DataFrame:
        step = geometry.cell / factor
        fine = Geometry(geometry.e0, geometry.n0, step, geometry.width * factor, geometry.height * factor)
        at = _cells(raster.sparkSession, grid, fine).withColumns({"e": geometry.e0 + (F.col("col") + 0.5) * step, "n": geometry.n0 - (F.col("row") + 0.5) * step})
        return resample(at, raster.withColumn("grid", F.lit(grid).cast("long")), self.west, self.north, self.pixel, self.width, self.height, nearest)

    def terrain(self, grid: int, geometry: Geometry) -> DataFrame:
        return self._taken(self.ground, grid, geometry, 1, False).select("grid", "row", "col", F.col("value").alias("z"))

    def surface(self, grid: int, geometry: Geometry, factor: int) -> DataFrame:
        return _grouped(self._taken(self.above, grid, geometry, factor, True), factor)


def pieces(geometry: Geometry, most: int = MOST_PIXELS) -> list[Geometry]:
    """The window in pieces of at most so many cells a side, row by row, as raster services answer."""
    rows, cols = range(0, geometry.height, most), range(0, geometry.width, most)
    return [Geometry(geometry.e0 + c * geometry.cell, geometry.n0 - r * geometry.cell, geometry.cell, min(most, geometry.width - c), min(most, geometry.height - r)) for r in rows for c in cols]


def _window(spark, grid: int, geometry: Geometry, factor: int) -> DataFrame:
    return spark.createDataFrame([(grid, geometry.e0, geometry.n0, geometry.width * factor, geometry.height * factor)], "grid long, e0 double, n0 double, width int, height int")


def _grouped(fine: DataFrame, factor: int) -> DataFrame:
    """Values of parts of cells (grid, row, col, value) as an array for each cell, row by row."""
    part = fine.withColumn("k", F.col("row") % factor * factor + F.col("col") % factor)
    cell = part.groupBy("grid", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"))
    return cell.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("surface"))
