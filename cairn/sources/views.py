"""Terrain, features, samples and texts derived from the star-schema tables, so that every operator runs on data that grows with them.

VIEW_SQL states the same views for a SQL engine that has the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rasters of 100 x 100 cells of 2 m; grid g lies g * 1000 m east of the first.
WIDTH, HEIGHT, CELL, E0, N0 = 100, 100, 2.0, 2_722_000.0, 1_205_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grids(spark: SparkSession, sf_dir: str) -> int:
    """How many rasters there are."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 10000 + 1


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, row, col, z, id): heights with a flat lake; one cell in 997 is unknown."""
    i = F.col("event_id")
    out = table(spark, sf_dir, "events").select((i / 10000).cast("long").alias("grid"), ((i % 10000) / 100).cast("int").alias("row"), (i % 100).cast("int").alias("col"), i.alias("id"), "value")
    lake = (F.col("row") % 50).between(20, 32) & F.col("col").between(60, 79)
    slope = 1500 + 4 * F.sin(F.col("col") / 9.0) + 3 * F.cos(F.col("row") / 7.0) + 0.0003 * F.col("value")
    return out.select("grid", "row", "col", "id", F.when(F.col("id") % 997 == 13, None).when(lake, 1480.0).otherwise(slope).alias("z"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(te, tn, west, north, width, height, data): the rasters as tiles of ground, one in each square kilometre."""
    z = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "z"))), lambda x: x["z"])
    by = dem(spark, sf_dir).groupBy("grid").agg(z.alias("data"))
    whole = by.filter(F.size("data") == WIDTH * HEIGHT)
    return whole.select((F.col("grid") + int(E0 // 1000)).alias("te"), F.lit(int(N0 // 1000) - 1).cast("long").alias("tn"), (E0 + F.col("grid") * 1000).alias("west"), F.lit(N0).alias("north"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "data")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, line, seq, e, n): points of way lines, a few in each grid."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 280).cast("long").alias("grid"), F.col("o_custkey").alias("line"), k.alias("seq"))
    return rows.select("grid", "line", "seq", (E0 + F.col("seq") * 37 % 200).cast("double").alias("e"), (N0 - F.col("seq") * 53 % 200).cast("double").alias("n"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, id, e, n)"""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 3).cast("long").alias("grid"), k.alias("id"), (E0 + k * 71 % 230 - 10).cast("double").alias("e"), (N0 - k * 43 % 215 + 5).cast("double").alias("n"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, area, rank, part, i, e1, n1, e2, n2): edges of slanted quads, 25 to a grid, every fifth with a square hole."""
    k = F.col("s_suppkey")
    e, n, w, h = E0 + k * 29 % 150, N0 - 20 - k * 41 % 150, 15 + k * 7 % 30, 12 + k * 11 % 25
    corner = lambda x, y: F.struct(x.cast("double").alias("e"), y.cast("double").alias("n"))
    outer = F.array(corner(e, n), corner(e + w, n + 3), corner(e + w + 4, n - h), corner(e - 2, n - h - 1))
    hole = F.array(corner(e + 4, n - 4), corner(e + 9, n - 4), corner(e + 9, n - 9), corner(e + 4, n - 9))
    rings = F.when(k % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    out = table(spark, sf_dir, "supplier").select((k / 25).cast("long").alias("grid"), k.cast("long").alias("area"), (F.col("s_nationkey") % 3).cast("int").alias("rank"), F.posexplode(rings).alias("part", "ring"))
    out = out.select("grid", "area", "rank", "part", "ring", F.posexplode("ring").alias("i", "p"))
    q = F.get("ring", (F.col("i") + 1) % F.size("ring"))
    return out.select("grid", "area", "rank", "part", "i", F.col("p.e").alias("e1"), F.col("p.n").alias("n1"), q["e"].alias("e2"), q["n"].alias("n2"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, ray, i, dist, h): heights along 360 rays of several scenes; one in 89 unknown, some on the sea."""
    k = F.col("l_orderkey")
    part = F.pmod(k * 7 + F.col("l_linenumber") * 13, F.lit(40)).cast("int")
    by = table(spark, sf_dir, "lineitem").groupBy((k / 30000).cast("long").alias("scene"), (k % 360).cast("int").alias("ray"), part.alias("i")).agg(F.min("l_extendedprice").cast("double").alias("p"))
    dist = (F.col("i") + 1) * 500.0
    h = F.when(F.floor("p") % 89 == 3, None).when(F.floor("p") % 7 == 0, 0.0).otherwise(F.col("p") / 40)
    return by.select("scene", "ray", "i", dist.alias("dist"), h.alias("h"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat, lon, name, ele_text)"""
    k = F.col("c_custkey")
    n = F.pmod(k * 37, F.lit(4200)) + 300
    text = (
        F.when(k % 8 == 0, F.concat(n, F.lit(" m")))
        .when(k % 8 == 1, F.concat(n, F.lit(",5")))
        .when(k % 8 == 2, F.concat((n / 1000).cast("int"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0")))
        .when(k % 8 == 3, F.concat((n / 1000).cast("int") + 9, F.lit("'"), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(" ft")))
        .when(k % 8 == 4, F.concat(F.lit("ca. "), n, F.lit(".25")))
        .when(k % 8 == 5, F.lit("~"))
        .when(k % 8 == 6, F.concat(n, F.lit("0")))
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), (46 + k * 7919 % 1000 / 1000.0).alias("lat"), (8 + k * 104729 % 2000 / 1000.0).alias("lon"), F.col("c_name").alias("name"), text.alias("ele_text"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, period, month, day)"""
    k = F.col("p_partkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    one = F.concat(two(k % 28 + 1), F.lit("."), two(k % 12 + 1), F.lit(". - "), two(k * 5 % 28 + 1), F.lit("."), two(k * 7 % 12 + 1), F.lit("."))
    more = F.concat(one, F.lit(" / 1.5.-15.07"))
    text = F.when(k % 9 == 0, None).when(k % 9 == 1, "ganzjaehrig").when(k % 9 < 5, more).otherwise(one)
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("period"), (k * 3 % 12 + 1).cast("int").alias("month"), (k * 11 % 28 + 1).cast("int").alias("day"))


VIEW_SQL = {
    "dem": """SELECT event_id // 10000 AS grid, CAST((event_id % 10000) // 100 AS INT) AS row, CAST(event_id % 100 AS INT) AS col, event_id AS id,
      CASE WHEN event_id % 997 = 13 THEN NULL WHEN (((event_id % 10000) // 100) % 50) BETWEEN 20 AND 32 AND event_id % 100 BETWEEN 60 AND 79 THEN 1480.0::DOUBLE
      ELSE 1500 + 4 * sin((event_id % 100) / 9.0::DOUBLE) + 3 * cos(((event_id % 10000) // 100) / 7.0::DOUBLE) + 0.0003::DOUBLE * value END AS z FROM events""",
    "tracks": """SELECT o_orderkey % 280 AS grid, o_custkey AS line, o_orderkey AS seq, 2722000.0::DOUBLE + (o_orderkey * 37) % 200 AS e, 1205000.0::DOUBLE - (o_orderkey * 53) % 200 AS n
      FROM orders""",
    "points": """SELECT s_suppkey % 3 AS grid, s_suppkey AS id, 2722000.0::DOUBLE + (s_suppkey * 71) % 230 - 10 AS e, 1205000.0::DOUBLE - (s_suppkey * 43) % 215 + 5 AS n FROM supplier""",
    "areas": """SELECT grid, area, rank, part, i, r[i + 1].e AS e1, r[i + 1].n AS n1, r[(i + 1) % 4 + 1].e AS e2, r[(i + 1) % 4 + 1].n AS n2 FROM (
      SELECT grid, area, rank, part, unnest([0, 1, 2, 3]) AS i, CASE part WHEN 0 THEN
        [{'e': e, 'n': n}, {'e': e + w, 'n': n + 3}, {'e': e + w + 4, 'n': n - h}, {'e': e - 2, 'n': n - h - 1}] ELSE
        [{'e': e + 4, 'n': n - 4}, {'e': e + 9, 'n': n - 4}, {'e': e + 9, 'n': n - 9}, {'e': e + 4, 'n': n - 9}] END AS r FROM (
        SELECT s_suppkey // 25 AS grid, s_suppkey AS area, (s_nationkey % 3)::BIGINT AS rank, 2722000.0::DOUBLE + (s_suppkey * 29) % 150 AS e, 1204980.0::DOUBLE - (s_suppkey * 41) % 150 AS n,
          15 + (s_suppkey * 7) % 30 AS w, 12 + (s_suppkey * 11) % 25 AS h, unnest(CASE WHEN s_suppkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS part FROM supplier))""",
    "samples": """SELECT scene, ray, i, (i + 1) * 500.0::DOUBLE AS dist, CASE WHEN floor(p)::BIGINT % 89 = 3 THEN NULL WHEN floor(p)::BIGINT % 7 = 0 THEN 0.0::DOUBLE ELSE p / 40 END AS h FROM (
      SELECT l_orderkey // 30000 AS scene, l_orderkey % 360 AS ray, (l_orderkey * 7 + l_linenumber * 13) % 40 AS i, min(l_extendedprice)::DOUBLE AS p FROM lineitem GROUP BY 1, 2, 3)""",
    "peaks": """SELECT k AS id, 46 + (k * 7919) % 1000 / 1000.0::DOUBLE AS lat, 8 + (k * 104729) % 2000 / 1000.0::DOUBLE AS lon, name, CASE k % 8
      WHEN 0 THEN n || ' m' WHEN 1 THEN n || ',5' WHEN 2 THEN (n // 1000) || ',' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN 3 THEN (n // 1000 + 9) || '''' || lpad((n % 1000)::VARCHAR, 3, '0') || ' ft'
      WHEN 4 THEN 'ca. ' || n || '.25' WHEN 5 THEN '~' WHEN 6 THEN n || '0' END AS ele_text FROM (SELECT c_custkey AS k, c_name AS name, (c_custkey * 37) % 4200 + 300 AS n FROM customer)""",
    "periods": """SELECT id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN 'ganzjaehrig' WHEN id % 9 < 5 THEN one || ' / 1.5.-15.07' ELSE one END AS period, month, day FROM (
      SELECT p_partkey AS id, lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '. - ' || lpad((p_partkey * 5 % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((p_partkey * 7 % 12 + 1)::VARCHAR, 2, '0') || '.' AS one,
        (p_partkey * 3) % 12 + 1 AS month, (p_partkey * 11) % 28 + 1 AS day FROM part)""",
}


def with_views(query: str, *names: str) -> str:
    """The query with the named views before it."""
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {head}{', ' if query.lstrip().startswith('+') else ' '}{query.lstrip().removeprefix('+')}"
