"""Registered queries of parsed features, catalogues, rules, caches, labels and ridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, ridges
from ..sources import features
from ..sources.views import table
from ..streaming import requests
from . import rays


def _elements(spark, sf_dir):
    """Map elements from customers: tags by the remainders of the key; ways of 2 to 6 points, some closed."""
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 12).alias("c"))
    pairs = {0: ("highway", "path"), 1: ("highway", "motorway"), 2: ("waterway", "stream"), 3: ("natural", "water"), 4: ("amenity", "drinking_water"), 5: ("natural", "spring"), 6: ("man_made", "water_tap"), 7: ("amenity", "fountain"), 8: ("natural", "water"), 9: ("natural", "peak"), 10: ("amenity", "water_point"), 11: ("highway", "track")}
    tag = lambda i: F.create_map(*(F.lit(x) for c, kv in pairs.items() for x in (c, kv[i])))[F.col("c")]
    extra = F.when(F.col("id") % 5 == 0, F.lit("no")).when(F.col("id") % 5 == 1, F.lit("yes"))
    name = F.when(F.col("id") % 4 == 1, F.concat(F.lit(" P"), F.col("id"))).when(F.col("id") % 4 == 0, F.lit("  "))
    tags = F.map_filter(F.map_from_arrays(F.array(tag(0), F.lit("drinking_water"), F.lit("access"), F.lit("name"), F.lit("ele")), F.array(tag(1), extra, F.when(F.col("id") % 7 == 0, "private"), name, (F.col("id") % 9500).cast("string"))), lambda _, v: v.isNotNull())
    kind = F.when(F.col("c").isin(5, 6, 7, 9), "node").when(F.col("c") == 8, "relation").otherwise("way")
    point = lambda i: F.struct((46 + (F.col("id") * 3 + i % (3 + F.col("id") % 3)) % 100 / 100.0).alias("lat"), (8 + (F.col("id") * 7 + i % (3 + F.col("id") % 3)) % 50 / 50.0).alias("lon"))
    line = F.transform(F.sequence(F.lit(0), (F.col("id") % 5 + 1).cast("int")), point)
    return e.select("id", kind.alias("type"), F.when(kind == "node", point(F.lit(0))["lat"]).alias("lat"), F.when(kind == "node", point(F.lit(0))["lon"]).alias("lon"), tags.alias("tags"), F.when(kind == "way", line).alias("geometry"), F.when(kind == "relation", F.array(F.struct(F.lit("outer").alias("role"), line.alias("geometry")), F.struct(F.lit("inner").alias("role"), line.alias("geometry")))).alias("members"))


def js04_classify(spark, sf_dir):
    return _elements(spark, sf_dir).select("id", features.feature_class(F.col("type"), F.col("tags")).alias("class"), features.drinking_kind(F.col("tags")).alias("kind"))


def js04_lines(spark, sf_dir):
    return features.lines(_elements(spark, sf_dir)).select("id", "class", F.col("part").cast("long").alias("part"), F.size("geometry").cast("long").alias("points"), "closed")


def js04_drinking(spark, sf_dir):
    return features.drinking_points(_elements(spark, sf_dir)).select("id", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def src17_named_peaks(spark, sf_dir):
    return features.named_peaks(_elements(spark, sf_dir).filter("tags['natural'] = 'peak'")).select("id", "name", F.round("lat", 6).alias("lat"), "ele")


def js06_areas(spark, sf_dir):
    """Protected areas of an identify answer, and the strictness of designated ones."""
    k = F.col("p_partkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    p = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("label", "name", "objname", "kategorie", "best_de", "schutzzeit"))), F.array(F.when(k % 4 == 0, "None").when(k % 4 == 1, F.concat(F.lit(" L"), k)), F.when(k % 3 == 0, F.concat(F.lit("N"), k)), F.when(k % 2 == 0, F.lit("O")), F.when(k % 11 == 0, "SNP"), F.when(k % 5 == 0, " no entry "), F.when(k % 6 < 4, F.concat(two(k % 28 + 1), F.lit("."), two(k % 12 + 1), F.lit(". - 30.04."))))), lambda _, v: v.isNotNull())
    r = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("layer"), k % 6).alias("layer"), (k % 8 != 0).alias("has_geometry"), p.alias("properties"))
    layers = table(spark, sf_dir, "region").select(F.concat(F.lit("layer"), F.col("r_regionkey")).alias("layer"), F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 100))).alias("kind"), (F.col("r_regionkey") % 2 == 0).alias("restricts"))
    return features.protected_areas(r, layers, F.lit(2), F.lit(10))


def js06_designated(spark, sf_dir):
    k = F.col("p_partkey")
    a = F.create_map(F.lit("iucnCategory"), F.element_at(F.array(*map(F.lit, ("Ia", "Ib", "II", "VI", "None", "x"))), (k % 6 + 1).cast("int")), F.lit("strictProtection"), F.when(k % 4 == 0, "yes").otherwise("no"), F.lit("siteName"), F.when(k % 5 == 0, " ").otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").withColumn("a", a).select("p_partkey", *(c.alias(n) for n, c in features.designated_areas(F.col("a")).items()))


def js05_rings(spark, sf_dir):
    """Corners of GeoJSON rings on the metric grid."""
    k = F.col("s_suppkey")
    ring = F.array(*(F.array(8 + (k + dx) / 100.0, 46.5 + (k + dy) / 200.0) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 0))))
    n = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(features.rings_to_grid(F.array(ring))).alias("r"))
    return n.select("s_suppkey", F.posexplode("r").alias("i", "p")).select("s_suppkey", F.col("i").cast("long").alias("i"), F.round("p.e", 3).alias("e"), F.round("p.n", 3).alias("n"))


def js07_places(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("place_id"), F.when(k % 9 == 0, "bad").otherwise((45 + k % 300 / 100.0).cast("string")).alias("lat"), F.lit("8.5").alias("lon"), F.when(k % 3 == 0, "").otherwise("Town").alias("name"), F.concat(F.col("s_name"), F.lit(" , Land")).alias("display_name"), F.when(k % 2 == 0, "natural").otherwise("place").alias("category"), F.when(k % 4 == 0, "peak").otherwise("town").alias("type"), F.when(k % 5 == 0, None).otherwise(F.array(F.lit("46"), F.lit("47"), F.lit("8"), (8 + k % 50 / 4.0).cast("string"))).alias("boundingbox"))
    return features.places(rows).select("id", "name", F.round("lat", 6).alias("lat"), "lon", "is_peak", F.col("zoom").cast("long").alias("zoom"))


def js08_suggest(spark, sf_dir):
    k = F.col("s_suppkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("<i>Alpiner Gipfel</i> <b>Horn  "), k, F.lit("|Corne</b> (VS) - Ort"))).when(k % 3 == 1, F.concat(F.lit("<i>Ort</i> <b>Dorf"), k, F.lit("</b>"))).otherwise(F.concat(F.lit("Plain <u>"), k, F.lit("</u>")))
    return table(spark, sf_dir, "supplier").withColumn("label", label).select("s_suppkey", *(c.alias(n) for n, c in features.suggestion(F.col("label")).items()))


def js09_commune(spark, sf_dir):
    """The newest commune of each region of an identify answer."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 7 + 2018).alias("year"), "c_custkey", "c_name")
    return features.latest_by(rows, ["c_nationkey"], [F.col("year").desc(), F.col("c_custkey")]).select("c_nationkey", "year", F.col("c_name").alias("commune"))


def src12_latest(spark, sf_dir):
    k = F.col("p_partkey")
    asset = lambda kind, gsd, end: F.struct(F.concat(F.lit("h"), k, F.lit(end)).alias("href"), F.lit(kind).alias("type"), gsd.cast("double").alias("gsd"))
    items = table(spark, sf_dir, "part").select(k.alias("seq"), F.concat(F.when(k % 13 == 0, "odd").otherwise("alti"), F.lit("_"), F.lit(2013) + k % 8, F.when(k % 17 == 0, "-").otherwise("_"), F.lit(2700) + k % 20, F.lit("-"), F.lit(1200) + k % 10).alias("id"), F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(asset("application/zip", F.lit(2), ".zip"), asset("image/tiff; application=geotiff", F.when(k % 5 == 0, 0.5).otherwise(2.0), ".tif"), asset("image/tiff; application=geotiff", F.lit(0.5), "-fine.tif"))).alias("assets"))
    return features.latest_assets(items, 2.0).select("tile", F.col("year").cast("long").alias("year"), "href")


def src14_prune(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = k * 991 % 3000 - 300.0, k * 577 % 2300 - 100.0
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(features.tiles_in_box(x, y, x + 300, y + 300, 3)).alias("t")).select("s_suppkey", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))


def rl01_rules(spark, sf_dir):
    """Rules of commune, region and country for places, the narrowest first."""
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_nationkey") % 5).alias("country"), F.col("s_nationkey").alias("region"), (F.col("s_suppkey") % 10).alias("commune"))
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), (F.col("n_nationkey") % 5).alias("country"), F.col("n_nationkey").alias("region"), (F.col("n_nationkey") % 10).alias("commune"))
    level = F.explode(F.array(*map(F.lit, ("country", "region", "commune"))))
    rules = base.withColumn("level", level).filter("level <> 'country' OR entry < 5")
    return features.rules_for(places, rules).select("place", F.col("position").cast("long").alias("position"), "level", "entry")


def src21_cache(spark, sf_dir):
    """Entries of a cache with a lifetime: the last saved of each key, if it is young enough."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("double").alias("saved_at"))
    return features.fresh(cache, F.lit(20000.0), 15000.0)


def sm01_latest(spark, sf_dir):
    return requests.latest(table(spark, sf_dir, "events")).select("user_id", "event_id", "event_type")


def sm04_sessions(spark, sf_dir):
    """Debounce: the last event of each run of a user's events that are under 30 minutes apart."""
    return requests.debounced(table(spark, sf_dir, "events"), "30 minutes").select("user_id", "event_id", "events")


def sm06_in_flight(spark, sf_dir):
    return requests.first_requests(table(spark, sf_dir, "events"), "1 hour").select("user_id", "event_type", "event_id")


def sm02_coalesced(spark, sf_dir):
    """Which requests of each user run when one at a time takes two hours and only the newest waits."""
    out = requests.coalesced(table(spark, sf_dir, "events"), 7200.0)
    return out.select("user_id", "event_id", F.col("started").isNotNull().alias("runs"))


def st01_union(spark, sf_dir):
    """Layers of several services as one, tagged by service."""
    a = table(spark, sf_dir, "supplier").select(F.lit("a").alias("layer"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.lit("b").alias("layer"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(b)


def tk08_hit(spark, sf_dir):
    k = F.col("c_custkey")
    boxes = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7 % 1500).alias("place"), (k * 37 % 6000 * 1.0).alias("x"), (k * 53 % 800 * 1.0).alias("y"), (k % 90 + 10.0).alias("w"), F.lit(18.0).alias("h"))
    e = F.col("event_id")
    return labels.hits(boxes, table(spark, sf_dir, "events").select(e.alias("probe"), (e * 11 % 6100 * 1.0).alias("px"), (e * 17 % 830 * 1.0).alias("py"))).select("probe", "id")


def ag13_seam(spark, sf_dir):
    k = F.col("c_custkey")
    lo = k * 7919 % 36000 / 100.0
    e = table(spark, sf_dir, "customer").select((k % 20).alias("scene"), (lo - k % 9).alias("lo"), (lo + k % 12 / 2.0).alias("hi"))
    return labels.best_seam(e)


def tk06_limit(spark, sf_dir):
    """Six best-matching places by name, the shortest first."""
    return table(spark, sf_dir, "part").filter(F.lower("p_name").contains("a")).orderBy(F.length("p_name"), "p_partkey").limit(6).select("p_partkey", "p_name")


def hz05_link(spark, sf_dir):
    crest = rays._crests(spark, sf_dir).withColumn("dist", 5000 + F.col("dist") % 4000).withColumn("angle", F.col("angle") % 1.0)
    return ridges.ridgelines(crest, rays.RAYS)


def vr13_stitch(spark, sf_dir):
    """Rings from the sides of squares, cut into lines, some turned round, some missing."""
    k = F.col("c_custkey")
    side = F.explode(F.sequence(F.lit(0), F.lit(3)))
    s = table(spark, sf_dir, "customer").select(k.alias("id"), side.alias("s")).filter("NOT (id % 6 = 0 AND s = 2)")
    px = lambda i: F.when((i % 4).isin(1, 2), 1.0).otherwise(0.0) + F.col("id")
    py = lambda i: F.when((i % 4).isin(2, 3), 1.0).otherwise(0.0)
    turn = (F.col("id") + F.col("s")) % 3 == 0
    way = lambda f: F.when(turn, F.array(f(F.col("s") + 1), f(F.col("s")))).otherwise(F.array(f(F.col("s")), f(F.col("s") + 1)))
    lines = s.select("id", ((F.col("s") * 3 + F.col("id")) % 4).cast("int").alias("part"), way(px).alias("x"), way(py).alias("y"))
    return ridges.stitched_rings(lines).select("id", "ring", F.size("x").alias("points"), F.array_min("x").alias("x0"), F.array_max("x").alias("x1"))


def tk03_labels(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select((k % 10).cast("long").alias("scene"), k.cast("long").alias("id"), (k / 10).cast("int").alias("place"), (k * 7919 % 36000 / 100.0).alias("az"), (k % 70 / 10.0).alias("angle"), (F.length("c_name") * 6.0).alias("width"))
    return labels.layout(c, 12.0, 20.0)


_TAG = "CASE c WHEN 0 THEN 'path' WHEN 1 THEN 'motorway' WHEN 2 THEN 'stream' WHEN 3 THEN 'water' WHEN 4 THEN 'drinking_water' WHEN 5 THEN 'spring' WHEN 6 THEN 'tap' WHEN 7 THEN 'fountain' WHEN 8 THEN 'relation' WHEN 9 THEN 'peak' WHEN 10 THEN 'water_point' ELSE 'track' END"
_OSM = f"""WITH e AS (SELECT c_custkey AS id, c_custkey % 12 AS c FROM customer), t AS (SELECT *, {_TAG} AS t, id % 5 = 0 OR id % 7 = 0 AS shut FROM e),
 k AS (SELECT *, CASE WHEN NOT shut AND (t IN ('drinking_water', 'water_point', 'tap', 'spring') OR (t = 'fountain' AND id % 5 = 1)) THEN t END AS kind FROM t),
 f AS (SELECT *, CASE WHEN kind IS NOT NULL THEN 'drinking' WHEN t IN ('path', 'track') THEN 'trail' WHEN t IN ('stream', 'water') THEN 'water' WHEN t = 'relation' THEN 'relation_water' END AS class, id % 5 + 2 AS n, 3 + id % 3 AS m FROM k)"""
SQL = {
    "js04_classify": _OSM + " SELECT id, class, kind FROM f",
    "js04_lines": _OSM + " SELECT id, class, 0::BIGINT AS part, n AS points, t = 'water' AND n >= 4 AND (n - 1) % m = 0 AS closed FROM f WHERE class IN ('trail', 'water') UNION ALL SELECT id, 'water', unnest([0, 1])::BIGINT, n, false FROM f WHERE class = 'relation_water'",
    "js04_drinking": _OSM + ", p AS (SELECT id, kind, m, unnest(range(0, CASE WHEN c IN (5, 6, 7, 9) THEN 1 ELSE n END)) AS i FROM f WHERE kind IS NOT NULL) SELECT id, kind, round(avg(46 + (id * 3 + i % m) % 100 / 100.0::DOUBLE), 6) AS lat, round(avg(8 + (id * 7 + i % m) % 50 / 50.0::DOUBLE), 6) AS lon FROM p GROUP BY id, kind",
    "src17_named_peaks": _OSM + " SELECT id, 'P' || id AS name, round(46 + (id * 3) % 100 / 100.0::DOUBLE, 6) AS lat, CASE WHEN id % 9500 <= 9000 THEN (id % 9500)::DOUBLE END AS ele FROM f WHERE t = 'peak' AND id % 4 = 1",
    "js06_areas": """WITH p AS (SELECT p_partkey AS k, (p_partkey % 12 + 1) * 100 + p_partkey % 28 + 1 AS a FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 6 < 5), q AS (SELECT p.*, initcap(r_name) AS kind, r_regionkey % 2 = 0 AS res FROM (SELECT r_regionkey, upper(r_name[1]) || lower(r_name[2:]) AS r_name FROM region) r JOIN p ON r_regionkey = k % 6)
        SELECT k AS id, 'layer' || k % 6 AS layer, CASE WHEN k % 11 = 0 THEN 'Swiss National Park' ELSE kind END AS kind, CASE WHEN k % 4 = 1 THEN 'L' || k WHEN k % 3 = 0 THEN 'N' || k WHEN k % 2 = 0 THEN 'O' ELSE 'Unnamed area' END AS name, CASE WHEN k % 5 = 0 THEN 'no entry' END AS rule,
        CASE WHEN k % 6 < 4 THEN lpad((k % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '. - 30.04.' END AS period, CASE WHEN k % 6 >= 4 THEN true WHEN a <= 430 THEN 210 BETWEEN a AND 430 ELSE 210 >= a OR 210 <= 430 END AS in_force, res OR k % 11 = 0 AS restricts FROM q""".replace("initcap(r_name)", "r_name"),
    "js06_designated": """WITH x AS (SELECT p_partkey, p_name, ['Ia','Ib','II','VI',NULL,'x'][p_partkey % 6 + 1] AS i, p_partkey % 4 = 0 AS s FROM part)
        SELECT p_partkey, CASE i WHEN 'Ia' THEN 'Strict nature reserve (IUCN Ia)' WHEN 'Ib' THEN 'Wilderness area (IUCN Ib)' WHEN 'II' THEN 'National park (IUCN II)' WHEN 'VI' THEN 'Protected area with sustainable use (IUCN VI)' ELSE 'Protected area' END AS kind,
        CASE WHEN p_partkey % 5 = 0 THEN 'Unnamed area' ELSE trim(p_name) END AS name, CASE WHEN s THEN 'Strictly protected (EEA)' END AS rule, s OR coalesce(i IN ('Ia', 'Ib'), false) AS restricts FROM x""",
    "js05_rings": """WITH c AS (SELECT s_suppkey, i, 8 + (s_suppkey + dx) / 100.0::DOUBLE AS lon, 46.5::DOUBLE + (s_suppkey + dy) / 200.0::DOUBLE AS lat FROM supplier, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 0)) v(i, dx, dy)), x AS (SELECT *, (lat * 3600 - 169028.66::DOUBLE) / 10000 AS p, (lon * 3600 - 26782.5::DOUBLE) / 10000 AS l FROM c)
        SELECT s_suppkey, i::BIGINT AS i, round(2600072.37::DOUBLE + 211455.93::DOUBLE*l - 10938.51::DOUBLE*l*p - 0.36::DOUBLE*l*p*p - 44.54::DOUBLE*l*l*l, 3) AS e, round(1200147.07::DOUBLE + 308807.95::DOUBLE*p + 3745.25::DOUBLE*l*l + 76.63::DOUBLE*p*p - 194.56::DOUBLE*l*l*p + 119.79::DOUBLE*p*p*p, 3) AS n FROM x""",
    "js07_places": """WITH s AS (SELECT *, s_suppkey AS k, (s_suppkey % 50) / 4.0::DOUBLE AS w FROM supplier) SELECT k AS id, CASE WHEN k % 3 = 0 THEN s_name ELSE 'Town' END AS name, CASE WHEN k % 9 <> 0 THEN round(45 + k % 300 / 100.0::DOUBLE, 6) END AS lat, 8.5::DOUBLE AS lon, k % 4 = 0 AS is_peak,
        CASE WHEN k % 4 = 0 OR k % 5 = 0 OR w = 0 THEN 14 ELSE greatest(3, least(15, floor(log2(360 / w)) + 1)) END::BIGINT AS zoom FROM s""",
    "js08_suggest": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Horn ' || s_suppkey WHEN 1 THEN 'Dorf' || s_suppkey ELSE 'Plain ' || s_suppkey END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Alpiner Gipfel' WHEN 1 THEN 'Ort' ELSE '' END AS kind, s_suppkey % 3 = 0 AS is_peak FROM supplier",
    "js09_commune": "SELECT c_nationkey, c_custkey % 7 + 2018 AS year, c_name AS commune FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 DESC, c_custkey) = 1",
    "src12_latest": "SELECT tile, year, href FROM (SELECT p_partkey AS k, (2013 + p_partkey % 8)::BIGINT AS year, (2700 + p_partkey % 20) || '-' || (1200 + p_partkey % 10) AS tile, 'h' || p_partkey || '.tif' AS href FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY tile ORDER BY year DESC, k) = 1",
    "src14_prune": "WITH b AS (SELECT s_suppkey, s_suppkey * 991 % 3000 - 300 AS x, s_suppkey * 577 % 2300 - 100 AS y FROM supplier), c AS (SELECT s_suppkey, y, unnest(range(floor(x / 256.0)::BIGINT, floor((x + 300) / 256.0)::BIGINT + 1)) AS tx FROM b) SELECT DISTINCT s_suppkey, ((tx % 8) + 8) % 8 AS x, unnest(range(greatest(0, floor(y / 256.0)::BIGINT), least(7, floor((y + 300) / 256.0)::BIGINT) + 1)) AS y FROM c",
    "rl01_rules": """WITH p AS (SELECT s_suppkey AS place, s_nationkey AS n, s_suppkey % 10 AS m FROM supplier), r AS (SELECT place, 2 AS o, 'country' AS level, n_nationkey AS entry FROM p JOIN nation ON n_nationkey % 5 = n % 5 AND n_nationkey < 5
        UNION ALL SELECT place, 1, 'region', n FROM p UNION ALL SELECT place, 0, 'commune', n FROM p WHERE m = n % 10) SELECT place, row_number() OVER (PARTITION BY place ORDER BY o, entry) AS position, level, entry FROM r""",
    "src21_cache": "SELECT o_custkey AS key, max(o_orderkey)::DOUBLE AS saved_at FROM orders WHERE 20000 - o_orderkey < 15000 GROUP BY o_custkey",
    "sm01_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "sm04_sessions": """WITH a AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
        SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM b GROUP BY user_id, s""",
    "sm06_in_flight": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts)",
    "st01_union": "SELECT 'a' AS layer, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'b', c_custkey, c_name FROM customer",
    "tk08_hit": """WITH b AS (SELECT c_custkey AS id, c_custkey * 7 % 1500 AS place, c_custkey * 37 % 6000 + (c_custkey % 90 + 10) / 2.0::DOUBLE AS cx, c_custkey * 53 % 800 + 9.0::DOUBLE AS cy, greatest(c_custkey % 90 + 10, 44) / 2.0::DOUBLE AS w FROM customer)
        SELECT event_id AS probe, arg_min(id, (place, id)) AS id FROM events JOIN b ON abs(event_id * 11 % 6100 - cx) <= w AND abs(event_id * 17 % 830 - cy) <= 22 GROUP BY event_id""",
    "ag13_seam": """WITH e AS (SELECT c_custkey % 20 AS scene, c_custkey * 7919 % 36000 / 100.0::DOUBLE - c_custkey % 9 AS lo, c_custkey * 7919 % 36000 / 100.0::DOUBLE + c_custkey % 12 / 2.0::DOUBLE AS hi FROM customer), g AS (SELECT unnest(range(0, 720)) / 2.0::DOUBLE AS az),
        c AS (SELECT scene, az, count(*) FILTER (az BETWEEN lo AND hi OR az - 360 BETWEEN lo AND hi OR az + 360 BETWEEN lo AND hi) AS cost FROM e, g GROUP BY scene, az) SELECT scene, az, cost FROM c QUALIFY row_number() OVER (PARTITION BY scene ORDER BY cost, least(az, 360 - az), az) = 1""",
    "tk06_limit": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' ORDER BY length(p_name), p_partkey LIMIT 6",
}
QUERIES = {n: globals()[n] for n in (*SQL, "hz05_link", "vr13_stitch", "tk03_labels", "sm02_coalesced")}
