"""Raster files as DataFrames: GeoTIFF directories, blocks and cells, and Terrarium PNG tiles.

GeoTIFFs are read by ranges of bytes: their directories in pages, then a row for each block, and blocks, not files, are the unit of reading and decoding. So a file of any size spreads over tasks,
and a window reads only the blocks that it touches. Executors reach the files through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: bytes of a field type; tags that are read.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
TAGS = {254: "subfile", 256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "block_height", 279: "counts", 317: "predictor", 322: "block_width", 323: "block_height", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 33922: "tiepoint", 42113: "nodata"}
SAMPLES = {(16, 1): "<u2", (16, 2): "<i2", (32, 3): "<f4", (64, 3): "<f8"}
LEVEL = "level int, width int, height int, block_width int, block_height int, compression int, predictor int, sample string, nodata double, pixel double, west double, north double, offsets array<bigint>, counts array<bigint>"


#: Blocks that one task decodes.
BLOCKS_A_TASK = 32
PAGE = 1 << 16


class Pages:
    """A file read by ranges; what directories take comes in pages that are read once."""

    def __init__(self, path: str):
        where, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        self.file, self.pages = where.open_input_file(place), {}

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def unpack(self, kind: str, at: int) -> tuple:
        n = struct.calcsize(kind)
        first, last = at // PAGE, (at + max(n, 1) - 1) // PAGE
        for k in range(first, last + 1):
            if k not in self.pages:
                self.pages[k] = self.read(k * PAGE, PAGE)
        return struct.unpack_from(kind, b"".join(self.pages[k] for k in range(first, last + 1)), at - first * PAGE)


class Whole:
    """The same of bytes in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def unpack(self, kind: str, at: int) -> tuple:
        return struct.unpack_from(kind, self.data, at)


def directories(data) -> list[dict]:
    """The image levels of a little-endian TIFF or BigTIFF, given as bytes or Pages; masks are passed over, what is not supported is an error. Overviews have the ground of the first level."""
    data = Whole(data) if isinstance(data, bytes) else data
    if data.unpack("<2s", 0)[0] != b"II":
        raise ValueError("not a little-endian TIFF")
    big = {42: False, 43: True}.get(data.unpack("<H", 2)[0])
    if big is None:
        raise ValueError("not a TIFF")
    word, entry = ("<Q", 20) if big else ("<I", 12)
    at, out, seen = data.unpack(word, 8 if big else 4)[0], [], set()
    while at and at not in seen:
        seen.add(at)
        n = data.unpack("<Q" if big else "<H", at)[0]
        at += 8 if big else 2
        tags = {}
        for k in range(n):
            p = at + k * entry
            tag, kind = data.unpack("<HH", p)
            count = data.unpack("<Q" if big else "<I", p + 4)[0]
            if tag not in TAGS or kind not in FIELD:
                continue
            place = p + (12 if big else 8)
            if struct.calcsize(f"<{count}{FIELD[kind]}") > (8 if big else 4):
                place = data.unpack(word, place)[0]
            tags[TAGS[tag]] = data.unpack(f"<{count}{FIELD[kind]}", place)
        at = data.unpack(word, at + n * entry)[0]
        one = lambda name, default=None, t=tags: t.get(name, (default,))[0]
        if one("subfile", 0) & 4:
            continue
        sample = SAMPLES.get((one("bits"), one("format", 1)))
        if sample is None or one("samples", 1) != 1 or one("compression", 1) not in (1, 5, 8, 32946) or one("predictor", 1) not in (1, 3):
            raise ValueError("unsupported samples, compression or predictor")
        base = out[0] if out else {"pixel": float("nan"), "west": float("nan"), "north": float("nan"), "width": one("width")}
        scale = tags.get("scale", (base["pixel"] * base["width"] / one("width"),))
        tie = tags.get("tiepoint", (0, 0, 0, base["west"], base["north"], 0))
        out.append({
            "level": len(out), "width": one("width"), "height": one("height"), "block_width": one("block_width", one("width")), "block_height": min(one("block_height", one("height")), one("height")) if "block_width" not in tags else one("block_height"),
            "compression": one("compression", 1), "predictor": one("predictor", 1), "sample": sample, "nodata": float(tags["nodata"][0].rstrip(b"\0 ")) if "nodata" in tags else None,
            "pixel": scale[0], "west": tie[3], "north": tie[4], "offsets": list(tags["offsets"]), "counts": list(tags["counts"]),
        })
    return out


def lzw(data: bytes, size: int) -> bytes:
    """TIFF's variant: most significant bits first, codes of 9 to 12 bits that grow one code early."""
    out, table, width, code_at, prev = bytearray(), [], 9, 0, b""
    bits, n = 0, 0
    start = [bytes([c]) for c in range(256)] + [b"", b""]
    table = list(start)
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            code = bits >> n - width & (1 << width) - 1
            n -= width
            bits &= (1 << n) - 1
            if code == 256:
                table, width, prev = list(start), 9, b""
            elif code == 257 or len(out) >= size:
                return bytes(out[:size])
            else:
                if code < len(table):
                    word = table[code]
                elif prev and code == len(table):
                    word = prev + prev[:1]
                else:
                    raise ValueError("corrupt LZW data")
                out += word
                if prev:
                    table.append(prev + word[:1])
                prev = word
                width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out[:size])


def decode_block(data: bytes, width: int, height: int, compression: int, predictor: int, sample: str, nodata: float | None) -> np.ndarray:
    """float32 rows of a block; no data is NaN."""
    kind = np.dtype(sample)
    size = width * height * kind.itemsize
    raw = data[:size] if compression == 1 else lzw(data, size) if compression == 5 else zlib.decompress(data)[:size]
    raw = raw.ljust(size, b"\0")
    if predictor == 3:  # byte planes, most significant first, each byte the difference to the one before in its row
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(height, -1), axis=1, dtype=np.uint8).reshape(height, kind.itemsize, width)
        values = np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).view(kind).reshape(height, width)
    else:
        values = np.frombuffer(raw, kind).reshape(height, width)
    out = values.astype(np.float32)
    if nodata is not None:
        out[values == (kind.type(nodata) if kind.kind == "f" else nodata)] = np.nan
    return out


def tiff_levels(spark: SparkSession, path: str) -> DataFrame:
    """(path, level...) of every image level of the GeoTIFF files under a path; no more than their directories is read."""

    def run(batches):
        for part in batches:
            rows = [{"path": p, **d} for p in part["path"] for d in directories(Pages(p))]
            if rows:
                yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, f"path string, {LEVEL}")


def level_for_step(levels: DataFrame, step: float) -> DataFrame:
    """Of each file the coarsest level whose pixels are no larger than a step, with a hundredth of slack; the first where none is so fine."""
    fit = F.max(F.when(F.col("pixel") <= step * 1.01, F.struct("pixel", "level"))).alias("fit")
    chosen = levels.groupBy("path").agg(fit).select("path", F.coalesce("fit.level", F.lit(0)).alias("level"))
    return levels.join(chosen, ["path", "level"], "left_semi")


def tiff_blocks(levels: DataFrame, window: tuple[int, int, int, int] | None = None, level: int | None = 0) -> DataFrame:
    """One row per block of a level (of all given levels if None), spread over tasks: with a window (row, col, height, width) only the blocks that it touches."""
    across = F.ceil(F.col("width") / F.col("block_width")).cast("int")
    rows = (levels if level is None else levels.filter(F.col("level") == level)).select("*", F.posexplode(F.arrays_zip("offsets", "counts")).alias("k", "b"))
    rows = rows.withColumns({"block_row": F.floor(F.col("k") / across).cast("int"), "block_col": (F.col("k") % across).cast("int")})
    if window:
        r, c, h, w = window
        touches = lambda at, size, lo, n: (F.col(at) * F.col(size) < lo + n) & ((F.col(at) + 1) * F.col(size) > lo)
        rows = rows.filter(touches("block_row", "block_height", r, h) & touches("block_col", "block_width", c, w))
    rows = rows.select("path", "width", "height", "block_width", "block_height", "compression", "predictor", "sample", "nodata", "pixel", "west", "north", "block_row", "block_col", F.col("b.offsets").alias("offset"), F.col("b.counts").alias("count"))
    return spread(rows)


def spread(blocks: DataFrame, many: int | None = None) -> DataFrame:
    """Blocks over as many tasks as their number asks for (many: that number, if it is known). The rows are tiny before they are decoded, so by their size Spark would join them all in one task."""
    return blocks.repartition(1 + (blocks.count() if many is None else many) // BLOCKS_A_TASK, "path", "block_row")


def tiff_cells(blocks: DataFrame) -> DataFrame:
    """(path, row, col, z) of all cells inside the image; null for no data."""

    def run(batches):
        for part in batches:
            files = {p: Pages(p) for p in part["path"].unique()}
            for b in part.itertuples():
                rows = min(b.block_height, b.height - b.block_row * b.block_height)
                z = decode_block(files[b.path].read(b.offset, b.count), b.block_width, b.block_height, b.compression, b.predictor, b.sample, None if pd.isna(b.nodata) else b.nodata)
                z = z[:rows, : min(b.block_width, b.width - b.block_col * b.block_width)]
                r, c = np.indices(z.shape)
                yield pd.DataFrame({"path": b.path, "row": (r + b.block_row * b.block_height).ravel().astype(np.int32), "col": (c + b.block_col * b.block_width).ravel().astype(np.int32), "z": z.ravel()})

    out = blocks.drop("pixel", "west", "north").mapInPandas(run, "path string, row int, col int, z float")
    return out.withColumn("z", F.nanvl("z", F.lit(None).cast("float")))


def tiff_window(spark: SparkSession, path: str, window: tuple[int, int, int, int], level: int = 0) -> DataFrame:
    """(path, row, col, z) of a window (row, col, height, width), counted from its corner."""
    r, c, h, w = window
    cells = tiff_cells(tiff_blocks(tiff_levels(spark, path), window, level)).filter(F.col("row").between(r, r + h - 1) & F.col("col").between(c, c + w - 1))
    return cells.select("path", (F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), "z")


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Metres of a Terrarium pixel."""
    return r * 256 + g + b / 256.0 - 32768


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit RGB or RGBA PNG that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    width, height, depth, colour, *_, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    if depth != 8 or colour not in (2, 6) or interlaced:
        raise ValueError("unsupported PNG")
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        packed += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += size + 12
    n = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width + 1, n), np.uint8)  # with a row and a column of zeros before
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, n)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 2:
            out[y + 1, 1:] = line + up
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        else:
            for x in range(width):
                a, b, c = (v.astype(np.int16) for v in (out[y + 1, x], out[y, x + 1], out[y, x]))
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (line[x] + guess).astype(np.uint8)
    return out[1:, 1:]


def terrarium_tiles(spark: SparkSession, path: str, wanted: DataFrame | None = None, retries: int = 2) -> DataFrame:
    """(z, x, y, elev array<float>) of Terrarium tiles stored as .../z/x/y.png, each tile once; with wanted (z, x, y), only those, and no other is read. A read that fails is tried again, after 500 ms, 1 s and so on."""

    def run(batches):
        for part in batches:
            elev = []
            for p in part["path"]:
                for k in range(retries + 1):
                    try:
                        pages = Pages(p)
                        data = pages.read(0, pages.file.size())
                        break
                    except OSError:
                        if k == retries:
                            raise
                        time.sleep(0.5 * 2**k)
                c = png_pixels(data).astype(np.float64)
                elev.append((c[..., 0] * 256.0 + c[..., 1] + c[..., 2] / 256.0 - 32768).astype(np.float32).ravel())
            yield part.assign(elev=elev).drop(columns="path")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path).select("path")
    key = lambda k: F.regexp_extract("path", r"([0-9]+)/([0-9]+)/([0-9]+)\.png$", k).cast("int")
    files = files.select(key(1).alias("z"), key(2).alias("x"), key(3).alias("y"), "path").dropDuplicates(["z", "x", "y"])
    if wanted is not None:
        files = files.join(wanted.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")
    return files.mapInPandas(run, "z int, x int, y int, elev array<float>")
