"""Registered queries that write derived rasters and images as files and read them back through the library's formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.staging import new_path
from ..sources import formats, terrain, views
from ..sources.views import with_views
from . import vector
from .raster import _CELL

#: Side of a file in cells: every raster is in several files.
SIDE = 64


def _written(spark, sf_dir, place=None) -> str:
    """The folder of all rasters as GeoTIFFs; place: west and north of a raster."""
    formats.register(spark)
    path = new_path(spark, "rasters")
    west, north = place or (F.lit(0.0), F.lit(0.0))
    cells = views.dem(spark, sf_dir).select(F.col("grid").alias("raster"), "row", "col", "z")
    formats.save_rasters(cells.withColumns({"west": west, "north": north, "pixel": F.lit(views.CELL)}), path, SIDE)
    return path


def _cells(spark, path, **options):
    """(grid, row, col, z) of files whose rasters have their corner at 0, 0."""
    found = spark.read.format("cairn_raster").options(**options).load(path)
    grid = F.regexp_extract("path", r"([0-9]+)-[0-9]+-[0-9]+\.tif$", 1).cast("long")
    return found.select(grid.alias("grid"), F.floor(-F.col("n") / views.CELL).alias("row"), F.floor(F.col("e") / views.CELL).alias("col"), F.round(F.col("z").cast("double"), 3).alias("z"))


def src05_raster_files(spark, sf_dir):
    """All cells, by way of files."""
    return _cells(spark, _written(spark, sf_dir))


def src09_window(spark, sf_dir):
    """A window of ground of every raster, of which only the touched blocks are read."""
    return _cells(spark, _written(spark, sf_dir), east="100:150", north="-130:-40")


def src15_provider(spark, sf_dir):
    """Heights of the windows around places from files on the ground, each in its own square kilometre."""
    path = _written(spark, sf_dir, (views.E0 + F.col("raster") * 1000, F.lit(views.N0)))
    found = terrain.FileSource(spark, path, path).windows(vector.place_windows(spark, sf_dir), views.CELL)
    return found.select(*vector.L("grid", "row", "col"), F.round("z", 3).alias("z"))


def snk01_image(spark, sf_dir):
    """The painted slope layer, by way of images."""
    formats.register(spark)
    path = new_path(spark, "images")
    painted = vector.sc06_paint(spark, sf_dir)
    formats.save_images(painted.withColumnRenamed("alpha", "a").withColumnRenamed("grid", "raster"), path, SIDE)
    found = spark.read.format("cairn_image").load(path)
    part = lambda k: F.regexp_extract("name", "([0-9]+)-([0-9]+)-([0-9]+)", k).cast("long")
    shown = found.select(part(1).alias("grid"), (part(2) * SIDE + F.col("row")).alias("row"), (part(3) * SIDE + F.col("col")).alias("col"), *vector.L(*"rgb"), F.col("a").cast("long").alias("alpha"))
    return shown


_Z = "round(z::FLOAT::DOUBLE, 3) AS z"
SQL = {
    "src05_raster_files": with_views(f"SELECT {_CELL}, {_Z} FROM dem", "dem"),
    "src09_window": with_views(f"SELECT {_CELL}, {_Z} FROM dem WHERE col BETWEEN 50 AND 74 AND row BETWEEN 20 AND 64", "dem"),
    "src15_provider": vector.SQL["src13_windows"].replace("round(d.z, 6) AS z", "round(d.z::FLOAT::DOUBLE, 3) AS z").replace("(SELECT dem.* FROM dem JOIN ok ON ok.g = dem.grid) d", "dem d"),
    "snk01_image": vector.SQL["sc06_paint"],
}
QUERIES = {n: globals()[n] for n in SQL}
