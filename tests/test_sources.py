"""Files to plans: GeoTIFF tiles to camp spots, elevation tiles to a panorama, providers, levels and ranges of files."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F
from test_core import tiff

from cairn.operators.vector import Geometry
from cairn.plans.camp import CampAnalysis
from cairn.plans.panorama import Panorama
from cairn.sources import rasters, terrain

E0, N0 = 2_722_000.0, 1_205_000.0


def placed(data, west, north, pixel):
    """The GeoTIFF with its corner and pixel size set."""
    scale, tie = struct.pack("<3d", 2.0, 2.0, 0.0), struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0)
    assert scale in data and tie in data
    return data.replace(scale, struct.pack("<3d", pixel, pixel, 0.0)).replace(tie, struct.pack("<6d", 0, 0, 0, west, north, 0))


def height(e, n):
    return 1500 + 0.03 * (e - E0) + 0.3 * np.maximum(0, E0 + 60 - e) + 0.01 * (N0 - n)


def write_tiles(folder, pixel=2.0):
    """Two tiles side by side, of 100 x 100 m of ground each, about the border of two square kilometres."""
    folder.mkdir()
    for k, west in enumerate((E0 + 900, E0 + 1000)):
        size = int(100 / pixel)
        e, n = west + (np.arange(size) + 0.5) * pixel, N0 - 100 - (np.arange(size) + 0.5) * pixel
        z = height(e[None, :], n[:, None]).astype("<f4")
        (folder / f"t{k}.tif").write_bytes(placed(tiff(z, 8, 3, False, (16, 16)), west, N0 - 100, pixel))


def test_files_to_camp_spots(spark, tmp_path):
    write_tiles(tmp_path / "a")
    tiles = terrain.tiles_of_files(spark, str(tmp_path / "a"), 2.0)
    assert {(r["te"], r["tn"]) for r in tiles.collect()} == {(2722, 1204), (2723, 1204)} and max(len(r["data"]) for r in tiles.collect()) == 16 * 16
    assert sum(len(r["data"]) for r in tiles.collect()) == 2 * 50 * 50
    g = Geometry(E0 + 960, N0 - 110, 2.0, 60, 40)
    cells = terrain.TiledSource(tiles, tiles).terrain(0, g)
    got = {(r["row"], r["col"]): r["z"] for r in cells.collect()}
    assert len(got) == 60 * 40
    for (row, col), z in got.items():
        assert math.isclose(z, height(g.e0 + (col + 0.5) * 2, g.n0 - (row + 0.5) * 2), abs_tol=1e-3)
    wide = terrain.TiledSource(tiles, tiles).terrain(0, Geometry(E0 + 880, N0 - 90, 2.0, 20, 20)).collect()
    assert len(wide) == 400 and sum(r["z"] is not None for r in wide) == 10 * 15
    plan = CampAnalysis(cells, g)
    spots = plan.spots(plan.score(plan.layers()), count=2, separation=40.0, least=0.1).collect()
    assert len(spots) == 2 and all(s["score"] > 0.1 and "slope" in s["detail"] for s in spots)


def test_providers_fill_cells_and_parts_of_cells(spark):
    pixels = [(r, c, float(r * 100 + c)) for r in range(12) for c in range(10)]
    raster = spark.createDataFrame(pixels, "row int, col int, v double")
    source = terrain.RasterSource(raster, raster, 0.0, 100.0, 4.0, 10, 12)
    g = Geometry(6.0, 90.0, 2.0, 8, 6)
    for r in source.terrain(3, g).collect():
        x, y = (6.0 + (r["col"] + 0.5) * 2) / 4 - 0.5, (100 - 90.0 + (r["row"] + 0.5) * 2) / 4 - 0.5
        assert r["grid"] == 3 and math.isclose(r["z"], y * 100 + x, abs_tol=1e-9)  # a plane is kept
    above = source.surface(3, g, 2).collect()
    assert len(above) == 48
    for r in above:
        want = [math.floor((10 + r["row"] * 2 + j + 0.5) / 4) * 100 + math.floor((6 + r["col"] * 2 + i + 0.5) / 4) for j in (0, 1) for i in (0, 1)]
        assert r["surface"] == want


def test_pieces_cover_a_window_once():
    g = Geometry(10.0, 500.0, 2.0, 2300, 1001)
    parts = terrain.pieces(g)
    assert len(parts) == 6 and all(p.width <= 1000 and p.height <= 1000 for p in parts) and sum(p.width * p.height for p in parts) == 2300 * 1001
    assert {(p.e0, p.n0) for p in parts} == {(10.0 + 2000 * i, 500.0 - 2000 * j) for i in range(3) for j in range(2)}


def test_level_choice_and_ranges(spark, tmp_path, monkeypatch):
    folder = tmp_path / "l"
    write_tiles(folder)
    levels = rasters.tiff_levels(spark, str(folder))
    more = levels.withColumn("level", F.lit(1)).withColumn("pixel", F.col("pixel") * 2).unionByName(levels).unionByName(levels.withColumn("level", F.lit(2)).withColumn("pixel", F.lit(8.0)))
    pick = lambda step: {r["level"] for r in rasters.level_for_step(more, step).collect()}
    assert (pick(1.0), pick(2.0), pick(3.97), pick(100.0)) == ({0}, {0}, {1}, {2})
    read = []
    pages = rasters.Pages(f"file:{folder}/t0.tif")
    monkeypatch.setattr(pages, "read", lambda at, n, f=pages.read: read.append((at, n)) or f(at, n))
    monkeypatch.setattr(rasters, "PAGE", 128)
    assert rasters.directories(pages)[0]["width"] == 50
    size = (folder / "t0.tif").stat().st_size
    assert sum(n for _, n in read) < size / 2  # the directory at the end, not the blocks before it
    blocks = rasters.tiff_blocks(levels, (0, 0, 16, 16))
    assert blocks.count() == 2 and "data" not in blocks.columns


def cone(lat, lon):
    """A mountain of 900 m, 4 km north of the observer, on a plain of 100 m."""
    d = 6_371_000.0 * math.radians(math.hypot(lat - 46.036, (lon - 8.0) * math.cos(math.radians(46.0))))
    return 100 + max(0.0, 900 * (1 - d / 1500))


def test_elevation_tiles_to_a_panorama(spark):
    zoom, size, radius, count = 12, 64, 6000.0, 72
    n = 2**zoom
    x0, y0 = (8.0 + 180) / 360 * n, (1 - math.log(math.tan(math.radians(46)) + 1 / math.cos(math.radians(46))) / math.pi) / 2 * n
    rows = []
    for tx in range(int(x0) - 2, int(x0) + 3):
        for ty in range(int(y0) - 2, int(y0) + 3):
            at = [(math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (ty + (j + 0.5) / size) / n)))), (tx + (i + 0.5) / size) / n * 360 - 180) for j in range(size) for i in range(size)]
            rows.append((zoom, tx, ty, [cone(*p) for p in at]))
    tiles = spark.createDataFrame(rows, "zoom int, tx long, ty long, elev array<double>")
    view = Panorama.from_tiles(spark.createDataFrame([(0, 46.0, 8.0), (1, 46.0, 8.0)], "scene long, lat double, lon double"), tiles, count, radius, eye=2.0, size=size)
    sky = {(r["scene"], r["ray"]): r for r in view.horizon().collect()}
    assert len(sky) == 2 * count and sky[0, 0]["angle"] == sky[1, 0]["angle"]
    top = math.degrees(math.atan((1000 - 102) / 4003))
    assert abs(sky[0, 0]["angle"] - top) < 0.5 and abs(sky[0, 0]["dist"] - 4003) < 150
    assert all(sky[0, r]["angle"] < 0 for r in range(20, 53))
    crest = view.crests().filter("scene = 0 AND ray = 0").collect()
    assert any(abs(r["dist"] - 4003) < 150 for r in crest)
    named = spark.createDataFrame([(7, 46.036, 8.0, "Cone", None), (8, 46.05, 8.0, "Behind", 300.0), (9, 46.0362, 8.0, "Known", 990.0)], "id long, lat double, lon double, name string, elev double")
    ground = spark.createDataFrame([(46.0361, 8.0001, 1000.0), (46.0, 8.0, 100.0)], "lat double, lon double, h double")
    fixed = Panorama(view.samples.filter("scene = 0").drop("eye"), 102.0, count)
    ranked = fixed.ranked_peaks(named, 46.0, 8.0, radius, ground=ground).orderBy("place").collect()
    assert [r["id"] for r in ranked] == [7, 9] and ranked[0]["elev"] == 1000.0
