"""Rasters, elevation tiles and images as formats of Spark's readers and writers.

`register` makes them known to a session; then `spark.read.format("cairn_raster").option("rows", "100:200").load(path)` and `CREATE TEMPORARY VIEW v USING cairn_raster OPTIONS (path '...', rows '100:200')` give cells, and what is
wanted of them reaches the files before anything is read:

| Format | Rows | Options that decide what is read | A task reads |
|-|-|-|-|
| cairn_raster | path, level, row, col, e, n, z of GeoTIFF cells | rows, cols, east, north, files, level or step | a share of the touched blocks of one file, by ranges of bytes |
| cairn_tiles | z, x, y, elev of Terrarium tiles .../z/x/y.png | z, x, y: folders and files that they rule out are not even listed | some tiles |
| cairn_image | name, row, col, r, g, b, a of PNG pixels | files | one file |
| cairn_raster, cairn_image (writers) | sorted cells or pixels of one file after another: use `save_rasters` and `save_images` | | one file at a time |

Ranges are "first:past" of whole numbers and "least:most" of metres, either end may be left out; files is a pattern of names such as "t1*.tif". They are options and no filters, because Spark 4.1 keeps what one scan of a loaded
table has pushed into a Python source for all other scans of it: after `df.filter(...)`, `df` itself would have the filtered rows only (`tests/test_formats.py` shows it).

Planning lists names and sizes only; a file's directory is read by the tasks that share the file. Files get their name when they are whole, and the same rows give the same name and bytes, so a task that runs again or twice does no harm.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import rasters

CELLS = pa.schema([("path", pa.string()), ("level", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("e", pa.float64()), ("n", pa.float64()), ("z", pa.float32())])
TILES = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("elev", pa.list_(pa.float32()))])
PIXELS = pa.schema([("name", pa.string()), *((c, pa.int32()) for c in ("row", "col", *"rgba"))])
#: Bytes of a file that a task reads, about, tiles that it reads, and rows of a batch.
PART_BYTES, PART_TILES, BATCH_ROWS = 128 << 20, 64, 1 << 16
#: Side of a written raster file and of its blocks.
SIDE, BLOCK = 1024, 128


def register(spark: SparkSession) -> None:
    for f in (RasterFormat, TileFormat, ImageFormat):
        spark.dataSource.register(f)


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def whole_range(text: str | None) -> tuple[float, float]:
    """First and last of "first:past"; a number alone stands for itself."""
    if text is None:
        return -math.inf, math.inf
    first, mark, past = text.partition(":")
    return int(first) if first.strip() else -math.inf, (int(past) - 1 if past.strip() else math.inf) if mark else int(first)


def metre_range(text: str | None) -> tuple[float, float]:
    least, _, most = (text or ":").partition(":")
    return float(least) if least.strip() else -math.inf, float(most) if most.strip() else math.inf


@dataclass
class FilePart(InputPartition):
    path: str
    share: int
    shares: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.files = options["path"], options.get("files", "*")
        self.row, self.col = whole_range(options.get("rows")), whole_range(options.get("cols"))
        self.e, self.n = metre_range(options.get("east")), metre_range(options.get("north"))
        self.level = None if options.get("level") == "all" else int(options.get("level", 0))
        self.step = float(options["step"]) if "step" in options else None
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[FilePart]:
        where, place = place_of(self.path)
        root = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        found = where.get_file_info(place)
        files = [found] if found.is_file else where.get_file_info(fs.FileSelector(place, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.is_file and f.path.lower().endswith((".tif", ".tiff")) and fnmatchcase(f.base_name, self.files):
                shares = max(1, -(-f.size // self.part_bytes))
                out += [FilePart(root + f.path, k, shares) for k in range(shares)]
        return out or [FilePart("", 0, 1)]

    def levels(self, found: list[dict]) -> list[dict]:
        if self.step is not None:
            fit = [d for d in found if d["pixel"] <= self.step * 1.01]
            return [max(fit, key=lambda d: (d["pixel"], d["level"]))] if fit else found[:1]
        return [d for d in found if self.level is None or d["level"] == self.level]

    def wanted(self, d: dict) -> tuple[int, int, int, int]:
        """The first and the past row and column of a level that are wanted."""
        row, col, e, n = self.row, self.col, self.e, self.n
        at = lambda x, zero, sign: sign * (x - zero) / d["pixel"] - 0.5 if math.isfinite(x) and d["pixel"] == d["pixel"] else math.copysign(math.inf, sign * x)
        r0, r1 = max(row[0], at(n[1], d["north"], -1) - 1e-9, 0), min(row[1], at(n[0], d["north"], -1) + 1e-9, d["height"] - 1)
        c0, c1 = max(col[0], at(e[0], d["west"], 1) - 1e-9, 0), min(col[1], at(e[1], d["west"], 1) + 1e-9, d["width"] - 1)
        return (math.ceil(r0), math.floor(r1) + 1, math.ceil(c0), math.floor(c1) + 1) if r0 <= r1 and c0 <= c1 else (0, 0, 0, 0)

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        file = rasters.Pages(part.path)
        touched = []
        for d in self.levels(rasters.directories(file)):
            r0, r1, c0, c1 = self.wanted(d)
            if r1 <= r0 or c1 <= c0:
                continue
            across = -(-d["width"] // d["block_width"])
            rows, cols = range(r0 // d["block_height"], (r1 - 1) // d["block_height"] + 1), range(c0 // d["block_width"], (c1 - 1) // d["block_width"] + 1)
            touched += [(d, (r0, r1, c0, c1), i, j, i * across + j) for i in rows for j in cols]
        for d, window, i, j, k in touched[len(touched) * part.share // part.shares : len(touched) * (part.share + 1) // part.shares]:
            z = rasters.decode_block(file.read(d["offsets"][k], d["counts"][k]), d["block_width"], d["block_height"], d["compression"], d["predictor"], d["sample"], d["nodata"])
            top, left = i * d["block_height"], j * d["block_width"]
            r0, r1 = max(window[0], top), min(window[1], top + d["block_height"], d["height"])
            c0, c1 = max(window[2], left), min(window[3], left + d["block_width"], d["width"])
            lines = max(1, BATCH_ROWS // (c1 - c0))
            for a in range(r0, r1, lines):
                b = min(r1, a + lines)
                v = z[a - top : b - top, c0 - left : c1 - left].ravel()
                row, col = np.repeat(np.arange(a, b), c1 - c0), np.tile(np.arange(c0, c1), b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]).take(pa.array(np.zeros(len(v), np.int32))), pa.array(np.full(len(v), d["level"], np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(d["west"] + (col + 0.5) * d["pixel"]), pa.array(d["north"] - (row + 0.5) * d["pixel"]), pa.array(v, mask=np.isnan(v))],
                    schema=CELLS,
                )


class RasterFormat(DataSource):
    """Options: path; level (0, the finest; "all") or step (of each file the coarsest level whose pixels are no larger); rows, cols, east, north (of cells' middles); files; partBytes."""

    @classmethod
    def name(cls) -> str:
        return "cairn_raster"

    def schema(self) -> str:
        return "path string, level int, row int, col int, e double, n double, z float"

    def reader(self, schema) -> RasterReader:
        return RasterReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], overwrite)


@dataclass
class TilePart(InputPartition):
    tiles: list[tuple[int, int, int, str]]


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.many = options["path"], int(options.get("parttiles", PART_TILES))
        self.wanted = {c: whole_range(options.get(c)) for c in "zxy"}

    def partitions(self) -> list[TilePart]:
        where, place = place_of(self.path)
        root = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""

        def below(folder: str, name: str, pattern: str) -> list[tuple[int, str]]:
            found = ((re.fullmatch(pattern, f.base_name), f.path) for f in where.get_file_info(fs.FileSelector(folder)))
            return sorted((int(m[1]), p) for m, p in found if m and self.wanted[name][0] <= int(m[1]) <= self.wanted[name][1])

        tiles = [(z, x, y, root + p) for z, a in below(place, "z", "([0-9]+)") for x, b in below(a, "x", "([0-9]+)") for y, p in below(b, "y", r"([0-9]+)\.png")]
        return [TilePart(tiles[k : k + self.many]) for k in range(0, len(tiles), self.many)] or [TilePart([])]

    def read(self, part: TilePart) -> Iterator[pa.RecordBatch]:
        for z, x, y, path in part.tiles:
            file = rasters.Pages(path)
            c = rasters.png_pixels(file.read(0, file.file.size())).astype(np.float64)
            elev = (c[..., 0] * 256.0 + c[..., 1] + c[..., 2] / 256.0 - 32768).astype(np.float32).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([x], pa.int32()), pa.array([y], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(elev)], pa.int32()), pa.array(elev))], schema=TILES)


class TileFormat(DataSource):
    """Options: path (its folders are zooms); z, x, y; partTiles."""

    @classmethod
    def name(cls) -> str:
        return "cairn_tiles"

    def schema(self) -> str:
        return "z int, x int, y int, elev array<float>"

    def reader(self, schema) -> TileReader:
        return TileReader({k.lower(): v for k, v in self.options.items()})


def tiff_bytes(z: np.ndarray, west: float, north: float, pixel: float, block: int = BLOCK) -> bytes:
    """A little-endian GeoTIFF of float32 rows in deflated blocks; NaN is no data."""
    height, width = z.shape
    blocks = []
    for r in range(0, height, block):
        for c in range(0, width, block):
            full = np.full((block, block), np.nan, "<f4")
            part = z[r : r + block, c : c + block]
            full[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(full.tobytes(), 6))
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b)
    at += at % 2
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [32]), (259, "H", [8]), (277, "H", [1]), (322, "I", [block]), (323, "I", [block]), (324, "I", offsets), (325, "I", [len(b) for b in blocks]), (339, "H", [3]), (33550, "d", [pixel, pixel, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0])]
    kinds, entries, far = {"H": 3, "I": 4, "d": 12}, b"", b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        data = struct.pack(f"<{len(values)}{kind}", *values)
        entries += struct.pack("<HHI", tag, kinds[kind], len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(far)))
        far += data if len(data) > 4 else b""
    return (struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks)).ljust(at, b"\0") + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + far


def png_bytes(pixels: np.ndarray) -> bytes:
    """An RGBA PNG (height, width, 4); of each row's five filters the one with the least sum of differences is taken."""
    height, width, n = pixels.shape
    x = pixels.reshape(height, width * n).astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, n:], up[1:] = x[:, :-n], x[:-1]
    both = np.zeros_like(x)
    both[1:, n:] = x[:-1, :-n]
    p = left + up - both
    pa_, pb, pc = np.abs(p - left), np.abs(p - up), np.abs(p - both)
    paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, both))
    lines = np.stack([x, x - left, x - up, x - (left + up) // 2, x - paeth]).astype(np.uint8)
    cost = np.abs(lines.view(np.int8).astype(np.int32)).sum(2)
    kind = cost.argmin(0)
    raw = np.concatenate([kind[:, None].astype(np.uint8), lines[kind, np.arange(height)]], 1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Writes the rows of one file after another: a change of `name` ends a file."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        where, place = place_of(path)
        if overwrite and where.get_file_info(place).type != fs.FileType.NotFound:
            where.delete_dir_contents(place)
        where.create_dir(place, recursive=True)

    def content(self, rows: pa.Table) -> tuple[str, bytes]:
        """The file's ending and bytes."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, place = place_of(self.path)
        names, rows, now = [], [], None

        def close():
            ending, data = self.content(pa.Table.from_batches(rows))
            part = f"{place}/.{uuid.uuid4().hex}"
            with where.open_output_stream(part) as out:
                out.write(data)
            where.move(part, f"{place}/{now}{ending}")
            names.append(now + ending)

        for batch in iterator:
            key = batch.column("name").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b > a and key[a] != now:
                    if rows:
                        close()
                    rows, now = [], key[a]
                if b > a:
                    rows.append(batch.slice(a, b - a))
        if rows:
            close()
        return Written(names)

    def commit(self, messages) -> None:
        names = [n for m in messages if m for n in m.names]
        if len(names) != len(set(names)):
            raise ValueError("rows of one file came from several tasks: sort them by save_rasters or save_images")

    def abort(self, messages) -> None:
        where, place = place_of(self.path)
        for name in (n for m in messages if m for n in m.names):
            if where.get_file_info(f"{place}/{name}").is_file:
                where.delete_file(f"{place}/{name}")


class RasterWriter(FileWriter):
    def content(self, rows: pa.Table) -> tuple[str, bytes]:
        row, col = (rows.column(c).to_numpy() for c in ("row", "col"))
        top, left = row.min(), col.min()
        z = np.full((row.max() - top + 1, col.max() - left + 1), np.nan, np.float32)
        z[row - top, col - left] = rows.column("z").cast(pa.float32()).to_numpy(zero_copy_only=False)
        west, north, pixel = (rows.column(c)[0].as_py() for c in ("west", "north", "pixel"))
        return ".tif", tiff_bytes(z, west + left * pixel, north - top * pixel, pixel)


class ImageWriter(FileWriter):
    def content(self, rows: pa.Table) -> tuple[str, bytes]:
        row, col = (rows.column(c).to_numpy() for c in ("row", "col"))
        top, left = row.min(), col.min()
        pixels = np.zeros((row.max() - top + 1, col.max() - left + 1, 4), np.uint8)
        for k, c in enumerate("rgba"):
            pixels[row - top, col - left, k] = rows.column(c).fill_null(0).cast(pa.uint8()).to_numpy()
        return ".png", png_bytes(pixels)


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.files = options["path"], options.get("files", "*")

    def partitions(self) -> list[FilePart]:
        where, place = place_of(self.path)
        root = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(place)) if f.is_file and f.extension == "png" and fnmatchcase(f.base_name, self.files))
        return [FilePart(root + f, 0, 1) for f in files] or [FilePart("", 0, 1)]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        file = rasters.Pages(part.path)
        x = rasters.png_pixels(file.read(0, file.file.size()))
        name = part.path.rpartition("/")[2][:-4]
        lines = max(1, BATCH_ROWS // x.shape[1])
        for a in range(0, len(x), lines):
            v = x[a : a + lines]
            n = v.shape[0] * v.shape[1]
            bands = [pa.array(v[..., k].ravel().astype(np.int32)) if k < v.shape[2] else pa.array(np.full(n, 255, np.int32)) for k in range(4)]
            row, col = np.indices(v.shape[:2])
            yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(n, np.int32))), pa.array((row + a).ravel().astype(np.int32)), pa.array(col.ravel().astype(np.int32)), *bands], schema=PIXELS)


class ImageFormat(DataSource):
    """Options: path, a folder of PNGs; files."""

    @classmethod
    def name(cls) -> str:
        return "cairn_image"

    def schema(self) -> str:
        return "name string, row int, col int, r int, g int, b int, a int"

    def reader(self, schema) -> ImageReader:
        return ImageReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], overwrite)


def _by_file(cells: DataFrame, side: int, *columns) -> DataFrame:
    """Cells dealt and sorted by file: pieces of `side` x `side` cells of each raster, named by raster and piece."""
    piece = [F.floor(F.col(c) / side).cast("long") for c in ("row", "col")]
    named = cells.select(F.concat_ws("-", F.col("raster").cast("string"), *piece).alias("name"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *columns)
    return named.repartition("name").sortWithinPartitions("name", "row", "col")


def save_rasters(cells: DataFrame, path: str, side: int = SIDE, mode: str = "append") -> None:
    """cells(raster, row, col, z, west, north, pixel; the corner and pixel size of the raster) as GeoTIFFs of at most side x side cells, RASTER-I-J.tif; null is no data. One file is one task's at a time."""
    number = [F.col(c).cast("double").alias(c) for c in ("z", "west", "north", "pixel")]
    _by_file(cells, side, *number).write.format("cairn_raster").mode(mode).save(path)


def save_images(pixels: DataFrame, path: str, side: int = SIDE, mode: str = "append") -> None:
    """pixels(raster, row, col, r, g, b, a; 0 to 255) as PNGs of at most side x side pixels, RASTER-I-J.png. What has no row, and null, is transparent."""
    _by_file(pixels, side, *(F.col(c).cast("int").alias(c) for c in "rgba")).write.format("cairn_image").mode(mode).save(path)
