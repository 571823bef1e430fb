"""Work is spread over tasks by what rows become, not by how small they are before."""

from pyspark.sql import functions as F
from test_sources import E0, N0

from cairn.sources import formats, rasters, terrain


def test_blocks_and_window_cells_are_spread(spark, tmp_path, monkeypatch):
    """81 files of one block each, and windows of 18,000 cells."""
    formats.register(spark)
    cells = spark.range(90 * 90).select(F.lit(1).alias("raster"), F.floor(F.col("id") / 90).cast("int").alias("row"), (F.col("id") % 90).cast("int").alias("col"))
    z = F.col("row") * 100.0 + F.col("col")
    formats.save_rasters(cells.withColumns({"z": z, "west": F.lit(E0), "north": F.lit(N0), "pixel": F.lit(2.0)}), str(tmp_path / "out"), 10)
    blocks = rasters.tiff_blocks(rasters.tiff_levels(spark, str(tmp_path / "out")))
    by_task = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 81 and len(by_task) > 1
    monkeypatch.setattr(terrain, "CELLS_A_TASK", 500)
    windows = spark.createDataFrame([(k, E0 + 20.0 * k, N0, 20, 180 if k == 0 else 90) for k in range(9)], "grid long, e0 double, n0 double, width int, height int")
    found = terrain.FileSource(spark, str(tmp_path / "out"), "").windows(windows, 2.0)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    rows = found.collect()
    assert len(rows) == 20 * 180 + 8 * 20 * 90
    assert all(r["z"] == (r["row"] * 100.0 + r["col"] + 10 * r["grid"] if r["row"] < 90 and r["col"] + 10 * r["grid"] < 90 else None) for r in rows)
