"""Registered raster queries, each with its statement for a SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster
from ..sources import views
from ..sources.views import HEIGHT, WIDTH, with_views

GRID = ("grid",)


def layers(spark, sf_dir) -> DataFrame:
    """dem with slope, roughness, and water: flat ground, which stands for open water, grown by the shore."""
    cells = raster.terrain(views.dem(spark, sf_dir), grid=GRID)
    cells = raster.flat_surface(cells, WIDTH, HEIGHT, grid=GRID)
    return raster.dilate(cells.withColumnRenamed("flat", "water"), "water", grid=GRID)


def scored(spark, sf_dir) -> DataFrame:
    cells = layers(spark, sf_dir).withColumn("score", raster.suitability(F.col("slope"), F.col("roughness"), F.col("water")))
    return raster.patch_minimum(cells, "score", WIDTH, HEIGHT, grid=GRID)


def _key(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("grid").cast("long"), F.col("row").cast("long"), F.col("col").cast("long"), *columns)


def rs01_slope(spark, sf_dir):
    return _key(raster.terrain(views.dem(spark, sf_dir), grid=GRID), F.round("slope", 6).alias("slope"))


def rs02_roughness(spark, sf_dir):
    return _key(raster.terrain(views.dem(spark, sf_dir), grid=GRID), F.round("roughness", 6).alias("roughness"))


def rs03_flat_mask(spark, sf_dir):
    return _key(raster.flat_surface(views.dem(spark, sf_dir), WIDTH, HEIGHT, grid=GRID), F.col("flat").cast("long").alias("flat"))


def rs05_dilate(spark, sf_dir):
    return _key(layers(spark, sf_dir), F.col("water").cast("long").alias("water"))


def sc01_suitability(spark, sf_dir):
    return _key(layers(spark, sf_dir), F.round(raster.suitability(F.col("slope"), F.col("roughness"), F.col("water")), 6).alias("score"))


def rs06_patch_min(spark, sf_dir):
    return _key(scored(spark, sf_dir), F.round("score", 6).alias("score"))


def ag04_block_argmax(spark, sf_dir):
    cells = scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return _key(raster.block_best(cells, "score", 5, GRID), F.col("block_row").cast("long").alias("block_row"), F.col("block_col").cast("long").alias("block_col"), "score")


def tk01_pick_spots(spark, sf_dir):
    cells = scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return _key(raster.pick_spots(cells, separation=40.0, least=0.2, grid=GRID), F.col("rank").cast("long").alias("rank"), "score")


def ag10_known_share(spark, sf_dir):
    """Share of cells with data; the analysis refuses a grid under one twentieth."""
    by = views.dem(spark, sf_dir).groupBy("grid").agg(F.count("z").alias("known"), F.count("*").alias("cells"))
    return by.select("grid", "known", "cells", (F.col("known") >= 0.05 * F.col("cells")).alias("enough"))


_JOINED = "q.grid, q.row, q.col, q.z, " + ", ".join(f"{n}.z AS {n}z" for n in "abcdfghk") + " FROM dem q " + " ".join(
    f"LEFT JOIN dem {n} ON {n}.grid = q.grid AND {n}.row = q.row + {dy} AND {n}.col = q.col + {dx}" for (dy, dx), n in raster.NEIGHBOURS.items() if n != "z"
)
_TERRAIN = f"""+nb AS (SELECT {_JOINED}),
 gr AS (SELECT *, CASE WHEN z IS NOT NULL THEN (cz + 2*fz + kz - az - 2*dz - gz) / 16 END AS gx0, CASE WHEN z IS NOT NULL THEN (az + 2*bz + cz - gz - 2*hz - kz) / 16 END AS gy0 FROM nb),
 gg AS (SELECT *, CASE WHEN gy0 IS NOT NULL THEN gx0 END AS gx, CASE WHEN gx0 IS NOT NULL THEN gy0 END AS gy FROM gr),
 terrain AS (SELECT grid, row, col, z, degrees(atan(sqrt(gx*gx + gy*gy))) AS slope,
   sqrt((pow(az - (z - 2*gx + 2*gy), 2) + pow(bz - (z + 2*gy), 2) + pow(cz - (z + 2*gx + 2*gy), 2) + pow(dz - (z - 2*gx), 2) + pow(fz - (z + 2*gx), 2)
     + pow(gz - (z - 2*gx - 2*gy), 2) + pow(hz - (z - 2*gy), 2) + pow(kz - (z + 2*gx - 2*gy), 2)) / 8) AS roughness FROM gg)"""
_FLAT = """, flat AS (SELECT d.grid, d.row, d.col, CASE WHEN d.z IS NULL OR d.row < 2 OR d.col < 2 OR d.row >= 98 OR d.col >= 98 THEN NULL
   WHEN (SELECT max(o.z) - min(o.z) FROM dem o WHERE o.grid = d.grid AND o.row BETWEEN d.row - 2 AND d.row + 2 AND o.col BETWEEN d.col - 2 AND d.col + 2) < 0.02 THEN 1 ELSE 0 END AS flat FROM dem d),
 wet AS (SELECT f.grid, f.row, f.col, CASE WHEN EXISTS (SELECT 1 FROM flat o WHERE o.flat = 1 AND o.grid = f.grid AND o.row BETWEEN f.row - 2 AND f.row + 2 AND o.col BETWEEN f.col - 2 AND f.col + 2) THEN 1 ELSE f.flat END AS water FROM flat f),
 suit AS (SELECT t.grid, t.row, t.col, CASE WHEN slope IS NULL OR roughness IS NULL THEN NULL WHEN water = 1 THEN 0.0::DOUBLE ELSE
   (1 - pow(ts, 2) * (3 - 2*ts)) * (1 - pow(tr, 2) * (3 - 2*tr)) END AS score FROM
   (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (slope - 5) / 5)) AS ts, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (roughness - 0.08::DOUBLE) / (0.3::DOUBLE - 0.08::DOUBLE))) AS tr FROM terrain) t JOIN wet w USING (grid, row, col))"""
_PATCH = """, patch AS (SELECT s.grid, s.row, s.col, CASE WHEN s.row < 1 OR s.col < 1 OR s.row >= 99 OR s.col >= 99 THEN 0.0::DOUBLE ELSE
   (SELECT min(coalesce(o.score, 0)) FROM suit o WHERE o.grid = s.grid AND o.row BETWEEN s.row - 1 AND s.row + 1 AND o.col BETWEEN s.col - 1 AND s.col + 1) END AS score FROM suit s),
 best AS (SELECT grid, row // 5 AS block_row, col // 5 AS block_col, row, col, round(score, 6) AS score,
   row_number() OVER (PARTITION BY grid, row // 5, col // 5 ORDER BY round(score, 6) DESC, row, col) AS k FROM patch)"""
_PICK = """, c0 AS (SELECT * FROM best WHERE k = 1 AND score >= 0.2), p1 AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY score DESC, block_row, block_col) AS o FROM c0),
 s1 AS (SELECT * FROM p1 WHERE o = 1),
 p2 AS (SELECT c.grid, c.row, c.col, c.score, row_number() OVER (PARTITION BY c.grid ORDER BY c.score DESC, c.block_row, c.block_col) AS o FROM c0 c JOIN s1 ON c.grid = s1.grid WHERE pow((c.row - s1.row)*2, 2) + pow((c.col - s1.col)*2, 2) >= 1600),
 s2 AS (SELECT * FROM p2 WHERE o = 1),
 p3 AS (SELECT c.grid, c.row, c.col, c.score, row_number() OVER (PARTITION BY c.grid ORDER BY c.score DESC, c.block_row, c.block_col) AS o FROM c0 c JOIN s1 ON c.grid = s1.grid JOIN s2 ON c.grid = s2.grid
   WHERE pow((c.row - s1.row)*2, 2) + pow((c.col - s1.col)*2, 2) >= 1600 AND pow((c.row - s2.row)*2, 2) + pow((c.col - s2.col)*2, 2) >= 1600)"""


def _sql(head: str, tail: str) -> str:
    return with_views(f"{head} {tail}", "dem")


_CELL = "grid::BIGINT AS grid, row::BIGINT AS row, col::BIGINT AS col"
SQL = {
    "rs01_slope": _sql(_TERRAIN, f"SELECT {_CELL}, round(slope, 6) AS slope FROM terrain"),
    "rs02_roughness": _sql(_TERRAIN, f"SELECT {_CELL}, round(roughness, 6) AS roughness FROM terrain"),
    "rs03_flat_mask": _sql(_TERRAIN + _FLAT, f"SELECT {_CELL}, flat::BIGINT AS flat FROM flat"),
    "rs05_dilate": _sql(_TERRAIN + _FLAT, f"SELECT {_CELL}, water::BIGINT AS water FROM wet"),
    "sc01_suitability": _sql(_TERRAIN + _FLAT, f"SELECT {_CELL}, round(score, 6) AS score FROM suit"),
    "rs06_patch_min": _sql(_TERRAIN + _FLAT + _PATCH, f"SELECT {_CELL}, round(score, 6) AS score FROM patch"),
    "ag04_block_argmax": _sql(_TERRAIN + _FLAT + _PATCH, f"SELECT {_CELL}, block_row::BIGINT AS block_row, block_col::BIGINT AS block_col, score FROM best WHERE k = 1"),
    "tk01_pick_spots": _sql(_TERRAIN + _FLAT + _PATCH + _PICK, f"SELECT {_CELL}, 1::BIGINT AS rank, score FROM s1 UNION ALL SELECT {_CELL}, 2, score FROM s2 UNION ALL SELECT {_CELL}, 3, score FROM p3 WHERE o = 1"),
    "ag10_known_share": _sql("", "SELECT grid, count(z) AS known, count(*) AS cells, count(z) >= 0.05 * count(*) AS enough FROM dem GROUP BY grid"),
}
QUERIES = {f.__name__: f for f in (rs01_slope, rs02_roughness, rs03_flat_mask, rs05_dilate, sc01_suitability, rs06_patch_min, ag04_block_argmax, tk01_pick_spots, ag10_known_share)}
