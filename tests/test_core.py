"""Operators without a SQL form, file formats, plans and streams."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators import labels, peaks, raster, rays, ridges, vector
from cairn.plans.camp import CampAnalysis
from cairn.plans.panorama import Panorama
from cairn.sources import features, rasters
from cairn.streaming import requests


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_known_values(spark):
    e, n = geo.Laea().forward(50.0, 5.0)
    r = one(spark, drop=geo.curvature_drop(100_000.0), e=e, n=n)
    assert math.isclose(r["drop"], 682.8, abs_tol=0.1) and math.isclose(r["e"], 3962799.45, abs_tol=0.05) and math.isclose(r["n"], 2999718.85, abs_tol=0.05)


def test_laea_and_lv95_round_trips(spark):
    pts = spark.range(200).select((44 + F.col("id") * 0.03).alias("lat"), (4 + F.col("id") * 0.07).alias("lon"))
    g = geo.Laea()
    e, n = g.forward(F.col("lat"), F.col("lon"))
    lat, lon = g.inverse(F.col("e"), F.col("n"))
    off = pts.withColumns({"e": e, "n": n}).select(F.greatest(F.max(F.abs(lat - F.col("lat"))), F.max(F.abs(lon - F.col("lon"))))).first()[0]
    assert off < 1e-8  # the published series ends at the sixth power: half a millimetre


def grid(spark, z, name=0):
    return spark.createDataFrame([(name, r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "grid long, row int, col int, z double")


def test_ramp_slope_and_flat_roughness(spark):
    z = np.fromfunction(lambda r, c: 0.5 * c * 2.0, (6, 7))
    z[4, 5] = math.nan
    out = {(r["row"], r["col"]): r for r in raster.terrain(grid(spark, z), grid=("grid",)).collect()}
    assert math.isclose(out[2, 2]["slope"], math.degrees(math.atan(0.5))) and abs(out[2, 2]["roughness"]) < 1e-12
    assert out[0, 3]["slope"] is None and out[3, 4]["slope"] is None and out[4, 5]["slope"] is None


def test_distances_equal_brute_force(spark):
    rng = random.Random(7)
    marks = {(rng.randrange(20), rng.randrange(20)) for _ in range(6)}
    cells = spark.range(400).select(F.lit(0).cast("long").alias("grid"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    m = spark.createDataFrame([(0, r, c) for r, c in marks], "grid long, row int, col int")
    got = {(r["row"], r["col"]): r["distance"] for r in vector.distances(cells, m, 2.0).collect()}
    assert all(math.isclose(got[r, c], min(math.hypot(r - a, c - b) for a, b in marks) * 2) for r in range(20) for c in range(20))
    assert {r["distance"] for r in vector.distances(cells, m.limit(0), 2.0).collect()} == {math.inf}


def test_spots_equal_greedy(spark):
    rng = random.Random(3)
    z = np.array([[rng.choice([0.4, 0.6, 0.7, 0.8, 0.8, 0.9]) for _ in range(60)] for _ in range(60)])
    cells = grid(spark, z).withColumnRenamed("z", "score")
    got = [(r["row"], r["col"]) for r in raster.pick_spots(cells, separation=40.0, grid=("grid",)).orderBy("rank").collect()]
    blocks = [max(((z[r, c], -r, -c) for r in range(a, a + 5) for c in range(b, b + 5))) for a in range(0, 60, 5) for b in range(0, 60, 5)]
    want = []
    for s, r, c in sorted(blocks, key=lambda x: -x[0]):
        if s >= 0.5 and len(want) < 3 and all(math.hypot(-r - p, -c - q) * 2 >= 40 for p, q in want):
            want.append((-r, -c))
    assert got == want


def walked_crests(h, dist, obs):
    top, run, out, low = -math.inf, None, [], None
    for x, d in zip(h, dist, strict=True):
        if x is None:
            continue
        t = ((0 if x < 1 else x) - d * d / (2 * 6371000) * 0.87 - obs) / d
        if t > top:
            if low is not None and math.atan(run[0]) - math.atan(low) >= math.radians(0.03):
                out.append(run)
            run, low, top = (t, d), None, t
        else:
            low = t if low is None else min(low, t)
    return [d for _, d in [*out, run]] if run else []


def test_crests_equal_a_walk(spark):
    rng = random.Random(1)
    data = {ray: [None if rng.random() < 0.1 else rng.choice([0.0, 100.0, 300.0, rng.random() * 800]) for _ in range(30)] for ray in range(150)}
    df = spark.createDataFrame([(0, ray, i, (i + 1) * 500.0, h) for ray, hs in data.items() for i, h in enumerate(hs)], "scene long, ray int, i int, dist double, h double")
    got = {}
    for r in rays.crests(rays.visible(df, 150.0)).orderBy("ray", "seq").collect():
        got.setdefault(r["ray"], []).append(r["dist"])
    assert got == {ray: want for ray, hs in data.items() if (want := walked_crests(hs, [(i + 1) * 500.0 for i in range(30)], 150.0))}


def test_ring_ridge_is_one_line_and_gaps_part_it(spark):
    ring = [(0, r, 0, 15000.0, 3.0) for r in range(360)]
    out = ridges.ridgelines(spark.createDataFrame(ring, "scene long, ray int, seq int, dist double, angle double"), 360)
    assert out.count() == 360 and out.select("ridge").distinct().count() == 1
    part = [(0, r, 0, 15000.0, 3.0) for r in range(360) if r not in (100, 200)] + [(0, 100, 0, 30000.0, 3.0)]
    out = ridges.ridgelines(spark.createDataFrame(part, "scene long, ray int, seq int, dist double, angle double"), 360)
    sizes = sorted(r["count"] for r in out.groupBy("ridge").count().collect())
    assert sizes == [99, 259]
    seam = out.filter("ray IN (0, 359)").orderBy("place").collect()
    assert [r["ray"] for r in seam] == [359, 0] and seam[1]["place"] == seam[0]["place"] + 1


def test_stitch():
    assert ridges.stitch([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)]]) == [[(1, 1), (0, 0), (1, 0), (1, 1)]]
    assert ridges.stitch([[(0, 0), (1, 0)], [(5, 5), (6, 6)]]) == []


def test_labels_do_not_collide_and_are_stable(spark):
    c = spark.createDataFrame([(0, i, i, (i * 37 % 3600) / 10, 2.0 + i % 5, 60.0) for i in range(60)] + [(1, 0, 0, 359.9, 2.0, 60.0), (1, 1, 1, 0.1, 2.0, 60.0)], "scene long, id long, place int, az double, angle double, width double")
    got = {(r["scene"], r["id"]): r for r in labels.layout(c, 10.0, 20.0).collect()}
    assert got[1, 0]["dy"] != got[1, 1]["dy"] or got[1, 0]["dx"] != got[1, 1]["dx"]
    boxes = [((i * 37 % 3600) + got[0, i]["dx"], (20 - 2.0 - i % 5) * 10 + got[0, i]["dy"], got[0, i]["w"]) for i in range(60) if (0, i) in got]
    assert not any(abs((x + w / 2) - (u + v / 2)) < (w + v) / 2 and abs(y - t) < labels.HEIGHT for k, (x, y, w) in enumerate(boxes) for u, t, v in boxes[:k])


def tiff(z, compression=1, predictor=1, big=False, tile=None, nodata=None, kind="<f4"):
    """A GeoTIFF in bytes."""
    h, w = z.shape
    th, tw = tile or (h, w)
    blocks = []
    for a in range(0, h, th):
        for b in range(0, w, tw):
            block = np.zeros((th, tw), kind)
            part = z[a : a + th, b : b + tw]
            block[: part.shape[0], : part.shape[1]] = part
            raw = block.tobytes()
            if predictor == 3:
                planes = block.view(np.uint8).reshape(th, tw, -1).transpose(0, 2, 1)[:, ::-1].reshape(th, -1)
                raw = np.diff(planes, axis=1, prepend=0).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(raw) if compression == 8 else lzw_encode(raw) if compression == 5 else raw)
    fmt = {"<f4": (32, 3), "<f8": (64, 3), "<i2": (16, 2)}[kind]
    q, word = (16, "<Q") if big else (4, "<I")
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [fmt[0]]), (259, 3, [compression]), (317, 3, [predictor]), (339, 3, [fmt[1]]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0, 0, 0, 100.0, 200.0, 0])]
    tags += [(322, 4, [tw]), (323, 4, [th]), (324, q, None), (325, q, [len(b) for b in blocks])] if tile else [(278, 4, [th]), (273, q, None), (279, q, [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, 2, str(nodata).encode() + b"\0"))
    code = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
    head = 16 if big else 8
    at, offsets = head, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    body, extra, entries = b"".join(blocks), b"", []
    for tag, t, v in sorted(tags):
        v = offsets if v is None else v
        data = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{code[t]}", *v)
        n = len(v)
        room = 8 if big else 4
        if len(data) > room:
            field = struct.pack(word, head + len(body) + len(extra))
            extra += data
        else:
            field = data.ljust(room, b"\0")
        entries.append(struct.pack("<HH", tag, t) + struct.pack(word, n) + field)
    ifd = head + len(body) + len(extra)
    top = struct.pack("<2sHHHQ", b"II", 43, 8, 0, ifd) if big else struct.pack("<2sHI", b"II", 42, ifd)
    return top + body + extra + struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + struct.pack(word, 0)


def lzw_encode(data):
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> n - 8 & 255)
            n -= 8

    table, width, word = {bytes([c]): c for c in range(256)}, 9, b""
    put(256, 9)
    size = 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        put(table[word], width)
        table[word + bytes([c])] = size
        size += 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4093:
            put(256, min(12, width))
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        word = bytes([c])
    if word:
        put(table[word], width)
    put(257, width)
    if n:
        put(0, 8 - n)
    return bytes(out)


def test_lzw_round_trip():
    rng = random.Random(2)
    for data in (b"", b"a", b"a" * 5000, bytes(rng.randrange(256) for _ in range(9000)), bytes(rng.choice(b"abc") for _ in range(30000))):
        assert rasters.lzw(lzw_encode(data), len(data)) == data


@pytest.mark.parametrize(("compression", "predictor", "big", "tile", "kind"), [(1, 1, False, None, "<f4"), (8, 3, True, (16, 16), "<f4"), (5, 1, False, (16, 32), "<f4"), (5, 3, True, None, "<f8"), (8, 1, False, (16, 16), "<i2")])
def test_tiff(spark, tmp_path, compression, predictor, big, tile, kind):
    z = np.round(np.fromfunction(lambda r, c: 100 + r * 3 + c, (37, 45))).astype(kind)
    z[3, 4] = -99
    (tmp_path / "a.tif").write_bytes(tiff(z, compression, predictor, big, tile, -99, kind))
    levels = rasters.tiff_levels(spark, str(tmp_path)).first()
    assert (levels["width"], levels["height"], levels["pixel"], levels["west"], levels["north"]) == (45, 37, 2.0, 100.0, 200.0)
    got = {(r["row"], r["col"]): r["z"] for r in rasters.tiff_window(spark, str(tmp_path), (2, 3, 20, 30)).collect()}
    assert len(got) == 600 and got.pop((1, 1)) is None
    assert all(v == float(np.float32(z[r + 2, c + 3])) for (r, c), v in got.items())


def test_tiff_reads_only_touched_blocks(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(np.zeros((64, 64), "<f4"), tile=(16, 16)))
    assert rasters.tiff_blocks(rasters.tiff_levels(spark, str(tmp_path)), (0, 15, 16, 2)).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        rasters.directories(tiff(np.zeros((4, 4), "<f4"), compression=7))
    with pytest.raises(ValueError, match="little-endian"):
        rasters.directories(b"MM\0*")


def test_terrarium_png(spark, tmp_path):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    lines, before = [], np.zeros((8, 3), np.int16)
    for y, line in enumerate(px.astype(np.int16)):
        row = np.vstack([np.zeros((1, 3), np.int16), line])
        a, b, c = row[:-1], before[1:], before[:-1]
        p = a + b - c
        da, db, dc = abs(p - a), abs(p - b), abs(p - c)
        guess = [0 * a, a, b, (a + b) // 2, np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))][y % 5]
        lines.append(bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        before = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (rasters.png_pixels(png) == px).all()
    (tmp_path / "12/5").mkdir(parents=True)
    (tmp_path / "12/5/6.png").write_bytes(png)
    r = rasters.terrarium_tiles(spark, str(tmp_path)).first()
    assert (r["z"], r["x"], r["y"]) == (12, 5, 6) and r["elev"][0] == np.float32(px[0, 0, 0] * 256.0 + px[0, 0, 1] + px[0, 0, 2] / 256 - 32768)


def test_camp_plan(spark):
    g = vector.Geometry(2_722_000.0, 1_205_000.0, 2.0, 60, 60)
    z = np.fromfunction(lambda r, c: np.where((r < 12) & (c < 12), 1421.0, np.where(c < 35, 1430 + c * 0.06 + r * 0.02, 1432 + (c - 35) * 1.4)), (60, 60))
    lake = [(0, 1, 2, 2_722_060.0, 1_204_900.0, 2_722_068.0, 1_204_900.0), (0, 1, 2, 2_722_068.0, 1_204_900.0, 2_722_068.0, 1_204_892.0), (0, 1, 2, 2_722_068.0, 1_204_892.0, 2_722_060.0, 1_204_892.0), (0, 1, 2, 2_722_060.0, 1_204_892.0, 2_722_060.0, 1_204_900.0)]
    edges = spark.createDataFrame(lake, "grid long, area long, rank int, e1 double, n1 double, e2 double, n2 double")
    trail = spark.createDataFrame([(0, 1, 0, 2_722_000.0, 1_204_950.0), (0, 1, 1, 2_722_120.0, 1_204_950.0)], "grid long, line long, seq int, e double, n double")
    plan = CampAnalysis(grid(spark, z), g, trails=trail, lakes=edges, areas=edges)
    layers = plan.layers()
    assert plan.warnings and plan.known().first()["enough"] and layers.count() == 3600
    at = {(r["row"], r["col"]): r for r in plan.score(layers).collect()}
    assert at[5, 5]["score"] == 0 and at[30, 50]["score"] == 0 and at[52, 32]["score"] == 0 and at[25, 20]["trail"] <= 2
    assert at[25, 20]["score"] < at[40, 20]["score"]
    spot = plan.spots(plan.score(layers, hide_protected=True), separation=20.0, least=0.2).orderBy("rank").first()
    assert spot["rank"] == 1 and spot["col"] < 35 and not (spot["row"] < 14 and spot["col"] < 14) and spot["title"].startswith("#1   score ") and "slope" in spot["detail"] and "trail" in spot["detail"]
    assert at[51, 31]["rank"] == 2
    layers.unpersist()


def test_panorama_plan(spark):
    rows = [(0, ray, i, (i + 1) * 500.0, 900.0 if i == 9 else 1200.0 if i == 39 and ray == 90 else 0.5 if i < 5 else 100.0) for ray in range(360) for i in range(60)]
    p = Panorama(spark.createDataFrame(rows, "scene long, ray int, i int, dist double, h double"), 100.0, 360)
    assert p.ridgelines().filter("dist = 5000").count() == 360
    assert p.sea().filter("ray = 5").first()["hi_dist"] == 2500.0
    lat, lon = (r := one(spark, a=geo.destination(46.0, 8.0, 90.0, 20_000.0)[0], b=geo.destination(46.0, 8.0, 90.0, 20_000.0)[1]))["a"], r["b"]
    named = spark.createDataFrame([(1, lat, lon, "Hidden", 1200.0), (2, lat, lon, "Tall", 4200.0), (3, lat, lon, "None", None)], "id long, lat double, lon double, name string, elev double")
    assert [r["name"] for r in p.ranked_peaks(named, 46.0, 8.0, 50_000.0).orderBy("place").collect()] == ["Tall"]


def test_peaks_rank_isolated_over_ridge(spark):
    crest = spark.createDataFrame([(0, r, 0, 10_000.0, 4.0 if r == 40 else 3.9) for r in range(20, 61)] + [(0, 200, 0, 10_000.0, 5.0)], "scene long, ray int, seq int, dist double, angle double")
    sky = spark.createDataFrame([(0, r, 0.0) for r in range(360)], "scene long, ray int, angle double")
    vis = spark.createDataFrame([(0, 1, 200.0, 10_000.0, 2000.0, 5.0), (0, 2, 40.0, 10_000.0, 2000.0, 4.0)], "scene long, id long, az double, dist double, elev double, angle double")
    out = {r["id"]: r for r in peaks.rank(peaks.prominence(vis, crest, sky, 360)).collect()}
    assert math.isclose(out[2]["prominence"], 0.1) and out[1]["prominence"] == 5.0 and out[1]["place"] == 1


def test_elements_from_json(spark):
    import json

    data = {"type": "node", "id": 7, "lat": 46.0, "lon": 8.0, "tags": {"natural": "peak", "name": " Horn ", "ele": "9,000 ft"}}
    e = spark.createDataFrame([(json.dumps(data),), ("{broken",)], "j string").select(F.from_json("j", features.OSM_SCHEMA).alias("e")).select("e.*")
    (r,) = features.named_peaks(e).collect()
    assert (r["id"], r["lat"], r["lon"], r["name"]) == (7, 46.0, 8.0, "Horn") and math.isclose(r["ele"], 2743.2)


def test_stream_forms(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    live = requests.stream(spark, str(tmp_path / "in"), ddl)
    q = requests.stream_first(live, ["user_id", "event_type"]).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == events.select("user_id", "event_type").distinct().count()
    q = requests.upsert_latest(live, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = requests.latest(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, requests.latest(events).collect()))
    sessions = requests.stream_debounced(live, "30 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    sessions.awaitTermination(120)
    assert 0 < spark.table("sessions").count() <= requests.debounced(events, "30 minutes").count()
    stale = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "user_id int, seq int")
    assert sorted(map(tuple, requests.unstale(stale).collect())) == [(1, 2), (2, 5)]
