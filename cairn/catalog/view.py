"""Registered queries of views, exports, noise, lakes, probes and seed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import known_text, near_text
from ..operators import raster, vector, view
from ..sources import rules, views
from ..sources.features import rules_for
from ..sources.views import table, with_views
from .raster import _FLAT, _TERRAIN, GRID
from .vector import _DISTS, _FILLED, GEO, _all_distances


def rn01_view(spark, sf_dir):
    k = F.col("event_id")
    x = view.x_of(k % 360 * 1.0, F.lit(350.0), F.lit(12.5), F.lit(800.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("x"), F.round(view.y_of(k % 40 - 10.0, F.lit(30.0), F.lit(12.5), k % 3 + 1.0), 6).alias("y"))


def rn04_tiles(spark, sf_dir):
    k = F.col("c_custkey")
    t = view.visible_tiles(view.level_for(k % 300 + 0.5), k % 360 * 1.0, F.lit(12.0), k % 300 + 0.5, F.lit(700.0), F.lit(500.0), F.lit(15.0), F.lit(-20.0))
    return table(spark, sf_dir, "customer").select("c_custkey", view.level_for(k % 300 + 0.5).cast("long").alias("n"), F.explode(t).alias("t")).select("c_custkey", "n", F.col("t.kx").cast("long").alias("kx"), F.col("t.ky").cast("long").alias("ky"))


def rn06_rays_per_vertex(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", view.rays_per_vertex(3600, F.col("event_id") % 97 / 10.0 + 0.05, 24.0).cast("long").alias("k"))


def rn12_export_plan(spark, sf_dir):
    k = F.col("c_custkey")
    p = view.export_plan(k % 330 + 30.0, k % 25 + 5.0, F.lit(1.5), k % 90 + 10.0)
    return table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.px", 6).alias("px"), *(F.col(f"p.{c}").cast("long").alias(c) for c in ("width", "height", "footer")))


def js15_noise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(view.noise(F.lit(7), F.col("event_id") % 5000 / 13.0), 9).alias("n"), F.round(view.noise(F.lit(3), F.col("event_id") % 500 / 7.0, 40), 9).alias("p"))


def js03_names(spark, sf_dir):
    """The first known name under several keys."""
    k = F.col("p_partkey")
    keys = (F.when(k % 3 == 0, " "), F.when(k % 5 == 0, "None").when(k % 5 == 1, F.concat(F.lit(" a "), k)), F.when(k % 2 == 0, F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(*map(known_text, keys), F.lit("Unnamed area")).alias("name"))


def sf07_progress(spark, sf_dir):
    k = F.col("event_id")
    share = F.when(k % 7 > 0, F.least(F.lit(1.0), k % 11 / (k % 7))).otherwise(0.0)
    stage = F.when(k % 4 == 0, 0.05 + 0.6 * share).when(k % 4 == 1, 0.7).when(k % 4 == 2, 0.7 + 0.15 * share)
    return table(spark, sf_dir, "events").select("event_id", F.round(stage, 9).alias("fraction"))


def rs04_lakes(spark, sf_dir):
    """Flat ground and lakes, grown by the shore; a lake counts over unknown ground too."""
    lake = vector.fill_polygons(views.areas(spark, sf_dir), GEO).select("grid", "row", "col").distinct().withColumn("lake", F.lit(1))
    flat = raster.flat_surface(views.dem(spark, sf_dir), views.WIDTH, views.HEIGHT, grid=GRID).join(lake.hint("merge"), ["grid", "row", "col"], "left")  # Spark guesses the size of filled cells from the suppliers'
    out = raster.dilate(flat.withColumn("water", F.when(F.col("lake") == 1, 1).otherwise(F.col("flat"))), "water", grid=GRID)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("grid", "row", "col", "water")))


def vr11_paint_order(spark, sf_dir):
    order = vector.paint_order(views.areas(spark, sf_dir).select("grid", "area", "rank").distinct())
    return order.select(*(F.col(c).cast("long").alias(c) for c in ("grid", "area", "rank", "index")))


def vr15_describe(spark, sf_dir):
    """What is known at probed points: the cell under each, and how far trails and drinking water are."""
    k = F.col("c_custkey")
    probes = table(spark, sf_dir, "customer").select(k.alias("id"), (k % views.grids(spark, sf_dir)).alias("grid"), GEO.row(views.N0 - k * 31 % 2400 / 10.0).alias("row"), GEO.col(views.E0 + k * 17 % 2300 / 10.0).alias("col"))
    near = _all_distances(spark, sf_dir).groupBy("grid", "row", "col").agg(*(F.max(F.when(F.col("kind") == c, F.round("distance", 6))).alias(c) for c in ("trail", "drinking")))
    met = probes.filter(GEO.inside()).join(near, ["grid", "row", "col"])
    return met.select("id", F.concat_ws(", ", near_text("a trail", F.col("trail")), near_text("drinking water", F.col("drinking"))).alias("line"))


def rl02_rules(spark, sf_dir):
    """Seed rules that apply to suppliers placed in cantons by their key."""
    codes = F.array(*map(F.lit, sorted(rules.CANTONS)))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.lit("CH").alias("country"), F.get(codes, (F.col("s_suppkey") % 26).cast("int")).alias("region"), F.when(F.col("s_suppkey") % 3 == 0, "Grindelwald").alias("commune"))
    seed = rules.rule_rows(spark)
    return rules_for(places, seed).join(seed.select("entry", "name", "stance"), "entry").select("place", F.col("position").cast("long").alias("position"), "name", "stance")


def _values(columns: str, rows: list[tuple]) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) v({columns})"


_H = "(xor(h3, h3 >> 15))"
_NOISE = """, {n}a AS (SELECT event_id, f, j, xor(({s} * 2654435761) % 4294967296, (i::HUGEINT * 2246822519 % 4294967296)::BIGINT) AS h FROM {n}), {n}b AS (SELECT event_id, f, j, (xor(h, h >> 15)::HUGEINT * 739982445 % 4294967296)::BIGINT AS h FROM {n}a),
 {n}c AS (SELECT event_id, f, j, (xor(h, h >> 12)::HUGEINT * 695872825 % 4294967296)::BIGINT AS h FROM {n}b), {n}d AS (SELECT event_id, f, max(CASE WHEN j = 0 THEN xor(h, h >> 15) / 4294967296.0::DOUBLE * 2 - 1 END) AS a, max(CASE WHEN j = 1 THEN xor(h, h >> 15) / 4294967296.0::DOUBLE * 2 - 1 END) AS b FROM {n}c GROUP BY event_id, f)"""
_KM = "CASE WHEN {d} < 1000 THEN (floor({d} / 10 + 0.5) * 10)::BIGINT || ' m' WHEN {d} / 1000 < 10 THEN printf('%.1f km', {d} / 1000) ELSE floor({d} / 1000 + 0.5)::BIGINT || ' km' END"
SQL = {
    "rn01_view": "SELECT event_id, round(400 + (fmod(fmod(event_id % 360 - 350.0::DOUBLE + 180, 360) + 360, 360) - 180) * 12.5::DOUBLE, 6) AS x, round((30 - (event_id % 40 - 10.0::DOUBLE)) * 12.5::DOUBLE * (event_id % 3 + 1), 6) AS y FROM events",
    "rn04_tiles": f"""WITH c AS (SELECT c_custkey, c_custkey % 300 + 0.5::DOUBLE AS px, (c_custkey % 360)::DOUBLE AS l FROM customer), n AS (SELECT *, coalesce((SELECT min(n) FROM {_values("n", [(x,) for x in view.LEVELS])} WHERE n * 512 / 360.0::DOUBLE >= px * 0.97::DOUBLE), 256) AS n FROM c),
        x AS (SELECT c_custkey, n, px, unnest(range(floor(l * n / 360.0::DOUBLE)::BIGINT, floor((l + 700 / px) * n / 360.0::DOUBLE)::BIGINT + 1)) AS kx FROM n)
        SELECT c_custkey, n::BIGINT AS n, kx, unnest(range(greatest(0, floor(3 * (n * 512 / 360.0::DOUBLE) / 512)::BIGINT), least(ceil(35 * (n * 512 / 360.0::DOUBLE) / 512)::BIGINT - 1, floor((3 + 500 / px) * (n * 512 / 360.0::DOUBLE) / 512)::BIGINT) + 1)) AS ky FROM x""",
    "rn06_rays_per_vertex": "WITH d AS (SELECT k FROM range(1, 3601) r(k) WHERE 3600 % k = 0), w AS (SELECT event_id, greatest(1, floor(24 / (event_id % 97 / 10.0::DOUBLE + 0.05::DOUBLE)))::BIGINT AS w FROM events) SELECT event_id, max(k) AS k FROM w JOIN d ON k <= w GROUP BY event_id",
    "rn12_export_plan": """WITH c AS (SELECT c_custkey, c_custkey % 330 + 30.0::DOUBLE AS f, c_custkey % 25 + 5.0::DOUBLE AS s, (c_custkey % 90 + 10) AS w FROM customer), k AS (SELECT *, unnest(range(0, 201)) AS k FROM c), p AS (SELECT *, w * pow(0.95::DOUBLE, k) AS px FROM k),
        q AS (SELECT c_custkey, k, px, greatest(1, floor(f * px + 0.5))::BIGINT AS width, greatest(1, floor(s * px * 1.5::DOUBLE + 0.5))::BIGINT AS height FROM p), r AS (SELECT *, floor(least(48, greatest(14, floor(width / 90 + 0.5))) * 4.2::DOUBLE + 0.5)::BIGINT AS footer FROM q)
        SELECT c_custkey, round(px, 6) AS px, width, height, footer FROM r WHERE width * (height + footer) <= 16000000 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY k) = 1""",
    "js15_noise": "WITH e AS (SELECT event_id, event_id % 5000 / 13.0::DOUBLE AS x, event_id % 500 / 7.0::DOUBLE AS y FROM events), n1 AS (SELECT event_id, x - floor(x) AS f, j, floor(x)::BIGINT + j AS i FROM e, (VALUES (0), (1)) v(j)), n2 AS (SELECT event_id, y - floor(y) AS f, j, (floor(y)::BIGINT + j) % 40 AS i FROM e, (VALUES (0), (1)) v(j))" + _NOISE.format(n="n1", s="7::BIGINT") + _NOISE.format(n="n2", s="3::BIGINT") + " SELECT p.event_id, round(p.a + (p.b - p.a) * p.f * p.f * (3 - 2 * p.f), 9) AS n, round(q.a + (q.b - q.a) * q.f * q.f * (3 - 2 * q.f), 9) AS p FROM n1d p JOIN n2d q USING (event_id)",
    "js03_names": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'a ' || p_partkey WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Unnamed area' END AS name FROM part",
    "sf07_progress": "WITH x AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN least(1.0::DOUBLE, event_id % 11 / (event_id % 7)::DOUBLE) ELSE 0 END AS s FROM events) SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN 0.05::DOUBLE + 0.6::DOUBLE * s WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.7::DOUBLE + 0.15::DOUBLE * s END, 9) AS fraction FROM x",
    "rs04_lakes": with_views(f"{_TERRAIN}{_FLAT}, {_FILLED.removeprefix('+')}, lk AS (SELECT f.grid, f.row, f.col, CASE WHEN EXISTS (SELECT 1 FROM filled x WHERE x.grid = f.grid AND x.row = f.row AND x.col = f.col) THEN 1 ELSE flat END AS w FROM flat f) SELECT l.grid, l.row::BIGINT AS row, l.col::BIGINT AS col, (CASE WHEN EXISTS (SELECT 1 FROM lk o WHERE o.w = 1 AND o.grid = l.grid AND o.row BETWEEN l.row - 2 AND l.row + 2 AND o.col BETWEEN l.col - 2 AND l.col + 2) THEN 1 ELSE w END)::BIGINT AS water FROM lk l", "dem", "areas"),
    "vr11_paint_order": with_views(f"{_FILLED} SELECT grid, area, rank::BIGINT AS rank, index FROM paint", "areas"),
    "vr15_describe": with_views(f"{_DISTS}, pr AS (SELECT c_custkey AS id, c_custkey % (SELECT max(event_id) // 10000 + 1 FROM events) AS grid, floor((c_custkey * 31 % 2400 / 10.0::DOUBLE) / 2)::BIGINT AS row, floor((c_custkey * 17 % 2300 / 10.0::DOUBLE) / 2)::BIGINT AS col FROM customer), rd AS (SELECT grid, row, col, kind, round(distance, 6) AS d FROM dist) SELECT id, CASE WHEN isinf(t.d) THEN 'no a trail in this box' ELSE {_KM.format(d='t.d')} || ' from a trail' END || ', ' || CASE WHEN isinf(w.d) THEN 'no drinking water in this box' ELSE {_KM.format(d='w.d')} || ' from drinking water' END AS line FROM pr p JOIN rd t ON t.kind = 'trail' AND t.grid = p.grid AND t.row = p.row AND t.col = p.col JOIN rd w ON w.kind = 'drinking' AND w.grid = p.grid AND w.row = p.row AND w.col = p.col", "dem", "tracks", "points"),
    "rl02_rules": f"""WITH c AS (SELECT * FROM {_values("i, code, name, stance", [(i, c, rules.CANTONS[c], rules.STANCE.get(c, "local")) for i, c in enumerate(sorted(rules.CANTONS))])}), p AS (SELECT s_suppkey AS place, s_suppkey % 3 = 0 AND s_suppkey % 26 = 3 AS com, name, stance FROM supplier JOIN c ON i = s_suppkey % 26)
        SELECT place, 1::BIGINT AS position, 'Grindelwald' AS name, 'ban' AS stance FROM p WHERE com UNION ALL SELECT place, 1 + com::BIGINT, name, stance FROM p UNION ALL SELECT place, 2 + com::BIGINT, 'Switzerland', 'local' FROM p""",
}
QUERIES = {n: globals()[n] for n in SQL}
