"""Sequential rules against plain loops on random input: greedy links and chains around the circle, stitched rings, the queue of one place, catalogue pages, wanted tiles."""

import datetime
import json
import math
import random
import struct
import zlib


from cairn.operators import ridges
from cairn.sources import features, rasters
from cairn.streaming import requests


def plain_ridges(crests, rays):
    """crests: {ray: [(dist, angle)]}. Chains of (ray, seq): neighbours linked best first, then chains joined over the last ray."""

    def match(a, b):
        pairs = []
        for j, (db, ab) in enumerate(crests.get(b, [])):
            for i, (da, aa) in enumerate(crests.get(a, [])):
                rel, turn = abs(da - db) / min(da, db), abs(aa - ab)
                if rel < ridges.NEAR and turn < ridges.LEVEL:
                    pairs.append((rel / ridges.NEAR + turn / ridges.LEVEL, j, i))
        out, seen = [], set()
        for _, j, i in sorted(pairs):
            if ("a", i) not in seen and ("b", j) not in seen:
                seen |= {("a", i), ("b", j)}
                out.append((i, j))
        return out

    chain, chains = {}, []
    for r in range(rays):
        if r:
            for i, j in match(r - 1, r):
                chain[r, j] = chain[r - 1, i]
                chain[r, j].append((r, j))
        for j in range(len(crests.get(r, []))):
            if (r, j) not in chain:
                chain[r, j] = [(r, j)]
                chains.append(chain[r, j])
    after = {}
    for i, j in match(rays - 1, 0):
        if chain[rays - 1, i] is not chain[0, j]:
            after[id(chain[rays - 1, i])] = chain[0, j]
    targets = {id(c) for c in after.values()}
    out, used = [], set()
    for start in [c for c in chains if id(c) not in targets] + sorted((c for c in chains if id(c) in targets), key=lambda c: c[0]):
        line, c = [], start
        while c is not None and id(c) not in used:
            used.add(id(c))
            line += c
            c = after.get(id(c))
        if line and len(line) >= math.ceil(ridges.SPAN * rays / 360 - 1e-9) + 1:
            out.append(line)
    return sorted(out)


def test_ridgelines_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    rows, want = [], {}
    rays = 40
    for scene in range(6):
        crests = {}
        for r in range(rays):
            lines = sorted({round(4000 + 900 * k + 60 * math.sin(r / 3 + k) + rng.uniform(-150, 150), 3) for k in range(6) if rng.random() < (0.97 if scene else 1.0)})
            crests[r] = [(d, rng.uniform(0, 0.25)) for d in lines]
        want[scene] = plain_ridges(crests, rays)
        rows += [(scene, r, s, d, a) for r, c in crests.items() for s, (d, a) in enumerate(c)]
    df = spark.createDataFrame(rows, "scene long, ray int, seq int, dist double, angle double")
    got = {}
    for r in ridges.ridgelines(df, rays).orderBy("scene", "ridge", "place").collect():
        got.setdefault(r["scene"], {}).setdefault(r["ridge"], []).append((r["ray"], r["seq"]))
    assert {s: sorted(v.values()) for s, v in got.items()} == want
    assert any(a[0] == rays - 1 and b[0] == 0 for v in want.values() for line in v for a, b in zip(line[:-1], line[1:], strict=True))


def test_rings_from_random_cuts(spark):
    """Polygons cut into lines, turned round and shuffled come back as rings of the same points; with a line missing they do not."""
    rng = random.Random(6)
    rows, whole = [], {}
    for i in range(40):
        n = rng.randint(4, 9)
        ring = [(float(i), math.cos(2 * math.pi * k / n) + i * 10) for k in range(n)]
        ring = [(math.sin(2 * math.pi * k / n), math.cos(2 * math.pi * k / n) + i * 10) for k in range(n)] + [(math.sin(0.0), math.cos(0.0) + i * 10)]
        cuts = sorted({0, n, *rng.sample(range(1, n), rng.randint(0, 3))})
        lines = [ring[a : b + 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if i % 5 == 0 and len(lines) > 1:
            lines.pop()
        else:
            whole[i] = set(ring)
        rng.shuffle(lines)
        rows += [(i, k, [p[0] for p in x], [p[1] for p in x]) for k, x in enumerate(x[::-1] if rng.random() < 0.5 else x for x in lines)]
    got = {}
    for r in ridges.stitched_rings(spark.createDataFrame(rows, "id long, part int, x array<double>, y array<double>")).collect():
        assert (r["x"][0], r["y"][0]) == (r["x"][-1], r["y"][-1])
        got[r["id"]] = set(zip(r["x"], r["y"], strict=True))
    assert got == whole


def test_queue_of_one_place(spark):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((u, e, start + datetime.timedelta(seconds=rng.randrange(600))) for e, u in enumerate([u for u in range(5) for _ in range(60)]))
    want = {}
    for u in range(5):
        free, waiting = start, None
        for _, e, at in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            if waiting is not None and at >= free:
                want[waiting], waiting, free = free, None, free + datetime.timedelta(seconds=20)
            if at >= free:
                want[e], free = at, at + datetime.timedelta(seconds=20)
            else:
                if waiting is not None:
                    want[waiting] = None
                waiting = e
        if waiting is not None:
            want[waiting] = free
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz")
    assert {r["event_id"]: r["started"] for r in requests.coalesced(df, 20.0).collect()} == want
    assert requests.coalesced(df.limit(0), 20.0).count() == 0


def test_catalogue_pages(spark, tmp_path):
    page = lambda *ids: json.dumps({"features": [{"id": i, "assets": {"a": {"href": f"h{i}.tif", "type": "image/tiff; application=geotiff", "eo:gsd": 2.0}}} for i in ids], "links": [{"rel": "next", "href": "x"}]})
    for name, text in {"p1.json": page("alti_2019_2700-1200", "alti_2020_2701-1200"), "p2.json": page("alti_2021_2700-1200"), "p3.json": "<html>busy</html>"}.items():
        (tmp_path / name).write_text(text)
    items, failed = features.catalogue_pages(spark, str(tmp_path))
    assert [r["path"].rpartition("/")[2] for r in failed.collect()] == ["p3.json"]
    assert [r["id"] for r in items.orderBy("seq").collect()] == ["alti_2019_2700-1200", "alti_2020_2701-1200", "alti_2021_2700-1200"]
    assert {r["tile"]: r["year"] for r in features.latest_assets(items, 2.0).collect()} == {"2700-1200": 2021, "2701-1200": 2020}


def test_catalogue_pages_by_their_links(spark, tmp_path):
    def page(name, ids, following):
        links = [{"rel": "self", "href": "https://x.org/c/none.json"}] + [{"rel": "next", "href": f"https://x.org/c/{f}"} for f in following]
        (tmp_path / name).write_text(json.dumps({"features": [{"id": i, "assets": {}} for i in ids], "links": links}))

    order = [f"p{(7 * k) % 11}.json" for k in range(11)]
    for k, name in enumerate(order):
        page(name, [f"a{k}", f"b{k}"], order[k + 1 : k + 2])
    page("other.json", ["z"], ["p0.json"])
    items, failed = features.catalogue_chain(spark, str(tmp_path), order[0])
    assert [r["id"] for r in items.orderBy("seq").collect()] == [x + str(k) for k in range(11) for x in "ab"] and failed.count() == 0
    assert [r["id"] for r in features.catalogue_chain(spark, str(tmp_path), order[9])[0].orderBy("seq").collect()] == ["a9", "b9", "a10", "b10"]
    (tmp_path / order[6]).write_text("<html>busy</html>")
    page(order[4], ["a4"], ["gone.json"])
    page(order[10], ["c"], [order[9]])  # leads back
    assert [r["name"] for r in features.catalogue_chain(spark, str(tmp_path), order[5])[1].collect()] == [order[6]]
    items, failed = features.catalogue_chain(spark, str(tmp_path), order[3])
    assert [r["id"] for r in items.orderBy("seq").collect()] == ["a3", "b3", "a4"] and [r["name"] for r in failed.collect()] == ["gone.json"]
    assert [r["id"] for r in features.catalogue_chain(spark, str(tmp_path), order[9])[0].orderBy("seq").collect()] == ["a9", "b9", "c"]


def test_only_wanted_tiles_are_read(spark, tmp_path):
    def png(v):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes([128, v, 0]))) + chunk(b"IEND", b"")

    for y in range(4):
        (tmp_path / "5/3").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"5/3/{y}.png").write_bytes(png(y) if y < 3 else b"broken")
    wanted = spark.createDataFrame([(5, 3, 1), (5, 3, 1), (5, 3, 9), (4, 3, 1)], "z int, x int, y int")
    got = rasters.terrarium_tiles(spark, str(tmp_path), wanted).collect()
    assert [(r["z"], r["x"], r["y"], r["elev"]) for r in got] == [(5, 3, 1, [1.0])]


def test_answers_of_several_layers(spark, tmp_path):
    for name, text in {"a/1.json": {"results": [{"layerBodId": "l1", "id": 3, "properties": {"name": "X"}}, {"layerBodId": "l1", "id": 4}]}, "b/1.json": {"results": []}, "b/2.json": "busy"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text if isinstance(text, str) else json.dumps(text))
    out = features.answers(spark, {k: str(tmp_path / k) for k in "ab"}, features.GEOJSON).collect()
    assert sorted((r["layer"], [x["id"] for x in r["results"] or ()]) for r in out) == [("a", [3, 4]), ("b", []), ("b", [])]
    assert sum(r["results"] is None for r in out) == 1
