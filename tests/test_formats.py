"""Formats: what options leave is what is read, from files of any size; written files give back what went in."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import tiff

from cairn.operators.vector import Geometry
from cairn.sources import formats, rasters, terrain

E0, N0, PIXEL = 2_722_000.0, 1_205_000.0, 2.0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files of 90 x 70 cells in blocks of 16, z = 1000 * file + row * 100 + col."""
    formats.register(spark)
    path = tmp_path_factory.mktemp("rasters")
    for k in range(3):
        row, col = np.indices((90, 70))
        z = (10_000 * k + row * 100 + col).astype(np.float32)
        z[3, 4] = np.nan
        (path / f"r{k}.tif").write_bytes(formats.tiff_bytes(z, E0 + 140 * k, N0, PIXEL, block=16))
    (path / "notes.txt").write_text("no raster")
    return path


def cells(spark, folder, **options):
    reader = spark.read.format("cairn_raster")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(folder))


def test_all_cells(spark, folder):
    got = cells(spark, folder, partBytes=4000).collect()
    assert len(got) == 3 * 90 * 70 == len({(r["path"], r["row"], r["col"]) for r in got})
    for r in random.Random(1).sample(got, 300):
        k = int(r["path"][-5])
        assert r["z"] == (None if (r["row"], r["col"]) == (3, 4) else 10_000 * k + r["row"] * 100 + r["col"])
        assert (r["e"], r["n"]) == (E0 + 140 * k + (r["col"] + 0.5) * 2, N0 - (r["row"] + 0.5) * 2)


@pytest.mark.parametrize(
    ("options", "text"),
    [
        ({"rows": "20:41", "cols": ":17"}, "row BETWEEN 20 AND 40 AND col < 17"),
        ({"rows": "7"}, "row = 7"),
        ({"rows": "80:"}, "row >= 80"),
        ({"rows": "1000:2000"}, "row >= 1000"),
        ({"rows": "5:5"}, "row < 5 AND row >= 5"),
        ({"east": "2722150.9:2722160", "north": "1204990:"}, "e BETWEEN 2722150.9 AND 2722160 AND n >= 1204990"),
        ({"east": "2722151:2722153", "north": ":1204951"}, "e BETWEEN 2722151 AND 2722153 AND n <= 1204951"),
        ({"files": "*1.tif", "rows": "0"}, "path LIKE '%r1.tif' AND row = 0"),
        ({"level": "3"}, "level = 3"),
        ({"level": "all", "cols": "69:"}, "col = 69"),
    ],
)
def test_options_in_sql_equal_filters_after(spark, folder, options, text):
    given = ", ".join(f"{k} '{v}'" for k, v in (options | {"path": str(folder)}).items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW wanted USING cairn_raster OPTIONS ({given})")
    cells(spark, folder).createOrReplaceTempView("raster")
    both = [sorted(map(tuple, spark.sql(q).collect()), key=str) for q in ("SELECT * FROM wanted", f"SELECT * FROM raster WHERE {text}")]
    assert both[0] == both[1]


def test_scans_of_one_table_do_not_share_filters(spark, folder):
    df = cells(spark, folder)
    assert df.filter("row < 16").count() == 3 * 16 * 70
    assert df.count() == 3 * 90 * 70
    assert df.filter("row = 1").unionByName(df.filter("row = 50")).count() == 2 * 3 * 70


def test_why_filters_are_not_pushed(spark, folder, monkeypatch):
    """Spark 4.1 gives a scan without filters the partitions that an earlier scan's filters have left. When this fails, filters can be pushed."""

    class Pushing(formats.RasterReader):
        def pushFilters(self, filters):
            self.row = (0, 15)
            yield from filters

    class Pushed(formats.RasterFormat):
        @classmethod
        def name(cls):
            return "pushed_raster"

        def reader(self, schema):
            return Pushing({k.lower(): v for k, v in self.options.items()})

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(Pushed)
        df = spark.read.format("pushed_raster").load(str(folder))
        assert df.filter("row < 16").count() == 3 * 16 * 70
        assert df.count() == 3 * 16 * 70
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def read_bytes(monkeypatch, folder, **options):
    """Cells and bytes of blocks that a reader takes."""
    taken = []
    plain = rasters.Pages.read
    monkeypatch.setattr(rasters.Pages, "read", lambda self, at, n: taken.append((at, n)) or plain(self, at, n))
    monkeypatch.setattr(rasters, "PAGE", 256)
    reader = formats.RasterReader({"path": str(folder), **options})
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    monkeypatch.undo()
    return rows, sum(n for _, n in taken if n != 256)  # not the pages of directories


@pytest.mark.parametrize("shares", ["3000", str(1 << 30)])
def test_only_touched_blocks_are_read(monkeypatch, folder, shares):
    rows, whole = read_bytes(monkeypatch, folder, partbytes=shares)
    assert rows == 3 * 90 * 70
    rows, some = read_bytes(monkeypatch, folder, partbytes=shares, rows="16:18", cols="33")
    assert rows == 3 * 2 and some < whole / 10
    rows, one = read_bytes(monkeypatch, folder, partbytes=shares, files="r1*", rows="0")
    assert rows == 70 and one < whole / 8
    assert read_bytes(monkeypatch, folder, partbytes=shares, east="3000000:") == (0, 0)


def test_blocks_that_are_not_touched_may_be_broken(spark, folder, tmp_path):
    data = bytearray((folder / "r0.tif").read_bytes())
    level = rasters.directories(bytes(data))[0]
    for at, n in list(zip(level["offsets"], level["counts"], strict=True))[1:]:
        data[at : at + n] = b"\xff" * n
    (tmp_path / "broken.tif").write_bytes(bytes(data))
    assert cells(spark, tmp_path, rows=":16", cols=":16").agg(F.count("z")).first()[0] == 255
    with pytest.raises(Exception, match="decompress"):
        cells(spark, tmp_path).agg(F.count("z")).collect()


def test_levels_by_step(spark, folder):
    reader = formats.RasterReader({"path": str(folder), "step": "3.97"})
    levels = [{"pixel": 2.0, "level": 0}, {"pixel": 4.0, "level": 1}, {"pixel": 8.0, "level": 2}]
    assert reader.levels(levels) == [levels[1]]
    assert formats.RasterReader({"path": "", "step": "1"}).levels(levels) == [levels[0]]
    assert formats.RasterReader({"path": "", "level": "all"}).levels(levels) == levels


@pytest.mark.parametrize("kind", ["classic", "big"])
def test_other_files(spark, tmp_path, kind):
    z = np.arange(33 * 21, dtype=np.float32).reshape(33, 21)
    (tmp_path / "x.TIFF").write_bytes(tiff(z, 5, 3, kind == "big", (16, 16), nodata=5))
    got = cells(spark, tmp_path).filter("row = 20").orderBy("col").collect()
    assert [r["z"] for r in got] == z[20].tolist()
    assert cells(spark, tmp_path).filter("z IS NULL").select("row", "col").collect() == [(0, 5)]


def test_no_files(spark, tmp_path):
    formats.register(spark)
    assert cells(spark, tmp_path).count() == 0
    assert spark.read.format("cairn_tiles").load(str(tmp_path)).count() == 0


def test_tiles_are_listed_by_option(spark, tmp_path, monkeypatch):
    formats.register(spark)
    rng = np.random.default_rng(1)
    for z, x, y in [(3, 1, 2), (3, 1, 4), (3, 2, 2), (4, 1, 2), (4, 7, 7)]:
        (tmp_path / str(z) / str(x)).mkdir(parents=True, exist_ok=True)
        metres = rng.uniform(-100, 4000, (4, 4))
        raw = np.round((metres + 32768) * 256).astype(np.int64)
        pixels = np.stack([raw >> 16, raw >> 8 & 255, raw & 255, np.full((4, 4), 255)], 2).astype(np.uint8)
        (tmp_path / str(z) / str(x) / f"{y}.png").write_bytes(formats.png_bytes(pixels))
    read = spark.read.format("cairn_tiles").option("partTiles", 2).load(str(tmp_path))
    want = {tuple(r)[:3]: list(r["elev"]) for r in rasters.terrarium_tiles(spark, str(tmp_path)).collect()}
    assert {tuple(r)[:3]: list(r["elev"]) for r in read.collect()} == want and len(want) == 5
    some = lambda **o: spark.read.format("cairn_tiles").options(**o).load(str(tmp_path))
    assert {tuple(r) for r in some(z="3", x=":2").select("z", "x", "y").collect()} == {(3, 1, 2), (3, 1, 4)}
    (tmp_path / "4" / "1" / "2.png").write_bytes(b"broken")
    assert some(z="4", x="7:8").count() == 1
    listed = []
    plain = formats.fs.FileSelector
    monkeypatch.setattr(formats.fs, "FileSelector", lambda p, **k: listed.append(p) or plain(p, **k))
    reader = formats.TileReader({"path": str(tmp_path), "z": "3", "x": "2"})
    assert [t[:3] for p in reader.partitions() for t in p.tiles] == [(3, 2, 2)] and len(listed) == 3


@pytest.mark.parametrize("side", [1000, 20])
def test_written_rasters_come_back(spark, tmp_path, side):
    formats.register(spark)
    rng = random.Random(side)
    rows = [(g, r, c, None if rng.random() < 0.1 else float(np.float32(rng.uniform(-5, 4000)))) for g in (0, 7) for r in range(45) for c in range(33)]
    df = spark.createDataFrame(rows, "raster long, row int, col int, z double").withColumns({"west": F.col("raster") * 1000 + 100.0, "north": F.lit(900.0), "pixel": F.lit(2.0)})
    formats.save_rasters(df.orderBy(F.rand(3)), str(tmp_path / "out"), side)
    formats.save_rasters(df, str(tmp_path / "out"), side)  # the same rows again: the same files
    back = cells(spark, tmp_path / "out").collect()
    got = {(int((r["e"] - 100) // 1000), math.floor((900 - r["n"]) / 2), math.floor((r["e"] - 100) % 1000 / 2)): r["z"] for r in back}
    assert got == {r[:3]: r[3] for r in rows} and len(back) == len(rows)
    assert len({r["path"] for r in back}) == (2 if side == 1000 else 2 * 3 * 2)
    formats.save_rasters(df.filter("raster = 7"), str(tmp_path / "out"), side, mode="overwrite")
    assert cells(spark, tmp_path / "out").count() == 45 * 33


def test_written_images_come_back(spark, tmp_path):
    formats.register(spark)
    rng = random.Random(2)
    rows = [(g, r, c, *(rng.choice([0, 255, rng.randrange(256)]) for _ in range(4))) for g in ("a", "b") for r in range(50) for c in range(37) if (r, c) != (9, 9)]
    formats.save_images(spark.createDataFrame(rows, "raster string, row int, col int, r int, g int, b int, a int"), str(tmp_path / "out"))
    back = spark.read.format("cairn_image").load(str(tmp_path / "out"))
    got = {(r["name"][0], *r[1:3]): tuple(r[3:]) for r in back.collect()}
    assert got == {r[:3]: r[3:] for r in rows} | {(g, 9, 9): (0, 0, 0, 0) for g in "ab"}
    assert spark.read.format("cairn_image").option("files", "b-*").load(str(tmp_path / "out")).count() == 50 * 37


def test_rows_of_one_file_in_several_tasks_are_refused(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(64).select(F.lit("x").alias("name"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), *(F.lit(1).alias(c) for c in "rgba")).repartition(4)
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("cairn_image").mode("append").save(str(tmp_path / "out"))


def test_windows_read_only_their_blocks(spark, folder, tmp_path):
    """A provider over large files: cells equal the rule, and blocks away from the windows may be broken."""
    for k in range(3):
        data = bytearray((folder / f"r{k}.tif").read_bytes())
        level = rasters.directories(bytes(data))[0]
        for i, (at, n) in enumerate(zip(level["offsets"], level["counts"], strict=True)):
            if i // 5 > 2:  # rows from 48 on
                data[at : at + n] = b"\xff" * n
        (tmp_path / f"r{k}.tif").write_bytes(bytes(data))
    source = terrain.FileSource(spark, str(tmp_path), str(tmp_path))
    windows = spark.createDataFrame([(0, E0 + 20, N0 - 10, 30, 20), (1, E0 + 130, N0, 10, 40), (2, E0 - 10, N0 + 6, 8, 5)], "grid long, e0 double, n0 double, width int, height int")
    got = {(r["grid"], r["row"], r["col"]): r["z"] for r in source.windows(windows, 2.0).collect()}
    assert len(got) == 600 + 400 + 40

    def want(e, n):
        k, row = int((e - E0) // 140), int((N0 - n) // 2)
        col = int((e - E0 - 140 * k) // 2)
        return None if e < E0 or n > N0 or (row, col) == (3, 4) else 10_000.0 * k + row * 100 + col

    corner = {r["grid"]: (r["e0"], r["n0"]) for r in windows.collect()}
    assert got == {(g, r, c): want(corner[g][0] + (c + 0.5) * 2, corner[g][1] - (r + 0.5) * 2) for g, r, c in got}
    one = source.terrain(4, Geometry(E0 + 20, N0 - 10, 2.0, 30, 20)).collect()
    assert {(r["row"], r["col"]): r["z"] for r in one} == {k[1:]: v for k, v in got.items() if k[0] == 0}
    fine = source.surface(4, Geometry(E0 + 20, N0 - 10, 4.0, 5, 5), 2).collect()
    assert len(fine) == 25 and all(len(r["surface"]) == 4 for r in fine)
