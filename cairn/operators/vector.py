"""Vector features on rasters: rasterising lines and polygons, containment, exact distances, reprojection.

Rasters are described by Geometry; features and cells carry the columns `grid`. Edges, rows and cells meet by equi-joins on derived keys, never by comparing all with all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import places


@dataclass(frozen=True)
class Geometry:
    e0: float
    n0: float
    cell: float
    width: int
    height: int

    def padded(self, cells: int) -> Geometry:
        return Geometry(self.e0 - cells * self.cell, self.n0 + cells * self.cell, self.cell, self.width + 2 * cells, self.height + 2 * cells)

    def row(self, n: Column) -> Column:
        return F.floor((self.n0 - n) / self.cell).cast("int")

    def col(self, e: Column) -> Column:
        return F.floor((e - self.e0) / self.cell).cast("int")

    def inside(self) -> Column:
        return F.col("row").between(0, self.height - 1) & F.col("col").between(0, self.width - 1)


def rasterise_points(points: DataFrame, geo: Geometry, keys: tuple[str, ...] = ("grid",)) -> DataFrame:
    """(keys, row, col) of the cells that hold a point (e, n); points outside mark nothing."""
    return points.select(*keys, geo.row(F.col("n")).alias("row"), geo.col(F.col("e")).alias("col")).filter(geo.inside()).distinct()


def rasterise_lines(points: DataFrame, geo: Geometry, line: tuple[str, ...] = ("grid", "line"), keys: tuple[str, ...] = ("grid",)) -> DataFrame:
    """(keys, row, col) of the cells that lines touch, sampled every half cell; points (line, seq, e, n) in order, a line of one point marks its cell."""
    w = Window.partitionBy(*line).orderBy("seq", "e", "n")
    seg = points.withColumn("e2", F.lead("e").over(w)).withColumn("n2", F.lead("n").over(w)).withColumn("first", F.row_number().over(w) == 1)
    seg = seg.filter("e2 IS NOT NULL OR first").withColumns({"e2": F.coalesce("e2", "e"), "n2": F.coalesce("n2", "n")})
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("e2") - F.col("e"), F.col("n2") - F.col("n")) / (geo.cell / 2)))
    at = seg.withColumn("steps", steps).select("*", F.explode(F.sequence(F.lit(0), F.col("steps").cast("int"))).alias("k"))
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("steps")
    return rasterise_points(at.select(*keys, along("e", "e2").alias("e"), along("n", "n2").alias("n")), geo, keys)


def fill_polygons(edges: DataFrame, geo: Geometry, keys: tuple[str, ...] = ("grid", "area")) -> DataFrame:
    """(keys, row, col) of the cells whose centre lies in a polygon by the even-odd rule; edges (keys, e1, n1, e2, n2) of all its rings.

    Every edge visits only the rows it can cross; crossings of a row are sorted and taken in pairs.
    """
    low = F.floor((geo.n0 - F.greatest("n1", "n2")) / geo.cell - 0.5).cast("int")
    high = F.ceil((geo.n0 - F.least("n1", "n2")) / geo.cell - 0.5).cast("int")
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(geo.height - 1))
    rows = edges.withColumn("lo", low).withColumn("hi", high).filter("hi >= lo").select("*", F.explode(F.sequence("lo", "hi")).alias("row"))
    n = geo.n0 - (F.col("row") + 0.5) * geo.cell
    cross = rows.withColumn("n", n).filter((F.col("n1") <= F.col("n")) != (F.col("n2") <= F.col("n")))
    x = F.col("e1") + (F.col("n") - F.col("n1")) / (F.col("n2") - F.col("n1")) * (F.col("e2") - F.col("e1"))
    lines = cross.withColumn("x", x).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pair = lines.select(*keys, "row", "xs", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)).alias("p"))
    a = F.greatest(F.lit(0), F.ceil((F.get("xs", F.col("p") * 2) - geo.e0) / geo.cell - 0.5)).cast("int")
    b = F.least(F.lit(geo.width - 1), F.floor((F.get("xs", F.col("p") * 2 + 1) - geo.e0) / geo.cell - 0.5)).cast("int")
    return pair.withColumn("a", a).withColumn("b", b).filter("b >= a").select(*keys, "row", F.explode(F.sequence("a", "b")).alias("col")).distinct()


def paint_order(areas: DataFrame) -> DataFrame:
    """(grid, area, rank) with index, the 1-based order of painting: stricter ranks later. A grid may have any number of areas."""
    return places(areas, ["grid"], ["rank", "area"], "index")


def protection_index(edges: DataFrame, geo: Geometry) -> DataFrame:
    """(grid, row, col, index): of each covered cell the area painted last."""
    order = paint_order(edges.select("grid", "area", "rank").distinct()).select("grid", "area", "index")
    placed = edges.join(order.hint("merge"), ["grid", "area"])  # before they are filled: edges are fewer than cells
    return fill_polygons(placed, geo, ("grid", "area", "index")).groupBy("grid", "row", "col").agg(F.max("index").alias("index"))


def edge_cells(edges: DataFrame, bucket: float) -> DataFrame:
    """(grid, area, be, bn): the cells of ground that a polygon's edges touch, row by row, with a hair of slack."""
    low, high = F.least("n1", "n2"), F.greatest("n1", "n2")
    slack = bucket * 1e-6
    rows = edges.select("grid", "area", "e1", "n1", "e2", "n2", F.explode(F.sequence(F.floor((low - slack) / bucket), F.floor((high + slack) / bucket))).alias("bn"))
    at = lambda n: F.when(F.col("n1") == F.col("n2"), None).otherwise(F.col("e1") + (F.least(high, F.greatest(low, n)) - F.col("n1")) / (F.col("n2") - F.col("n1")) * (F.col("e2") - F.col("e1")))
    one, two = F.coalesce(at(F.col("bn") * bucket - slack), "e1"), F.coalesce(at((F.col("bn") + 1) * bucket + slack), "e2")
    cells = rows.select("grid", "area", "bn", F.explode(F.sequence(F.floor((F.least(one, two) - slack) / bucket), F.floor((F.greatest(one, two) + slack) / bucket))).alias("be"))
    return cells.distinct()


def containing(points: DataFrame, edges: DataFrame, bucket: float = 32.0) -> DataFrame:
    """(grid, id, area, rank) of each polygon that contains a point (grid, id, e, n), by an even number of edges to pass strictly upwards or not.

    Points and polygons meet by cells of ground. A cell that no edge touches lies inside or outside as a whole: its middle is asked once and its points meet no edges. Points of other cells meet the polygon's edges by slabs of northing, as high as
    the polygon's mean edge, so that an edge is in about two slabs and a point meets about as many edges as a line through the polygon crosses.
    """
    height = F.abs(F.col("n2") - F.col("n1"))
    spans = (F.floor(f(F.least(f"{c}1", f"{c}2") if f is F.min else F.greatest(f"{c}1", f"{c}2")) / bucket).alias(f"{c}{k}") for c in "en" for k, f in (("_lo", F.min), ("_hi", F.max)))
    areas = edges.groupBy("grid", "area", "rank").agg(*spans, F.avg(height).alias("_h"))
    areas = areas.withColumn("_h", F.when(F.col("_h") > 0, F.col("_h")).otherwise(bucket))
    cover = areas.select("grid", "area", "rank", "_h", F.explode(F.sequence("e_lo", "e_hi")).alias("be"), "n_lo", "n_hi").select("grid", "area", "rank", "_h", "be", F.explode(F.sequence("n_lo", "n_hi")).alias("bn"))
    cover = cover.join(edge_cells(edges, bucket).withColumn("_edge", F.lit(True)), ["grid", "area", "be", "bn"], "left")
    at = points.select(F.monotonically_increasing_id().alias("_row"), "grid", "id", "e", "n", F.floor(F.col("e") / bucket).alias("be"), F.floor(F.col("n") / bucket).alias("bn"))
    middle = lambda c: (F.col(c) + 0.5) * bucket
    whole = cover.filter("_edge IS NULL").select("grid", "area", "rank", "_h", "be", "bn", middle("be").alias("e"), middle("bn").alias("n"))
    near = at.join(cover.filter("_edge").drop("_edge"), ["grid", "be", "bn"])
    asked = near.drop("be", "bn").withColumns({"be": F.lit(None).cast("long"), "bn": F.lit(None).cast("long")}).unionByName(whole, allowMissingColumns=True)
    slab = lambda n: F.floor(n / F.col("_h"))
    cut = edges.join(areas.select("grid", "area", "_h"), ["grid", "area"]).filter(height > 0)
    cut = cut.select("grid", "area", F.explode(F.sequence(slab(F.least("n1", "n2")), slab(F.greatest("n1", "n2")))).alias("_slab"), "e1", "n1", "e2", "n2")
    met = asked.withColumn("_slab", slab(F.col("n"))).join(cut, ["grid", "area", "_slab"])
    passes = ((F.col("n1") > F.col("n")) != (F.col("n2") > F.col("n"))) & (F.col("e") < (F.col("e2") - F.col("e1")) * (F.col("n") - F.col("n1")) / (F.col("n2") - F.col("n1")) + F.col("e1"))
    odd = met.groupBy("_row", "grid", "id", "area", "rank", "be", "bn").agg(F.count_if(passes).alias("k")).filter("k % 2 = 1")
    inside = odd.filter("bn IS NOT NULL").select("grid", "be", "bn", "area", "rank")
    return odd.filter("bn IS NULL").select("grid", "id", "area", "rank").unionByName(at.join(inside, ["grid", "be", "bn"]).select("grid", "id", "area", "rank"))


def areas_at(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The polygons at each point, strictest first: (grid, id, place, area, rank)."""
    place = F.row_number().over(Window.partitionBy("grid", "id").orderBy(F.col("rank").desc(), F.col("area").desc()))
    return containing(points, edges).withColumn("place", place)


def nearest_in_rows(gap: np.ndarray) -> np.ndarray:
    """For each place of each row (rows x columns) the least of (column - other column)**2 + gap(other column)**2; infinite where the row has no finite gap.

    The best other column never falls as the column grows, so the middle column of a range bounds both halves: width * log(width) steps, for all rows at once.
    """
    rows, width = gap.shape
    square = gap * gap
    column = np.arange(width, dtype=np.float64)
    best, cost = np.zeros((rows, width + 2), np.int64), np.empty((rows, width))
    best[:, width] = width - 1  # stands to the right of all; the last one, 0, to the left
    step = 1 << max(0, width - 1).bit_length()
    while step > 1:
        at = np.arange(step // 2, width, step)
        left, right = at - step // 2, np.minimum(at + step // 2, width)
        low, high = best[:, np.where(left > 0, left, width + 1)].ravel(), best[:, right].ravel()
        size = high - low + 1
        begin = np.cumsum(size) - size
        which = np.repeat(np.arange(len(size)), size)
        x = np.arange(size.sum()) - begin[which] + low[which]
        value = (column[np.tile(at, rows)][which] - column[x]) ** 2 + square[which // len(at), x]
        least = np.minimum.reduceat(value, begin)
        chosen = np.minimum.reduceat(np.where(value == least[which], x, width), begin)
        best[:, at], cost[:, at] = chosen.reshape(rows, -1), least.reshape(rows, -1)
        step //= 2
    cost[:, 0] = (column**2 + square).min(1)
    return cost


def distances(cells: DataFrame, marks: DataFrame, cell: float, keys: tuple[str, ...] = ("grid",), band: int = 64) -> DataFrame:
    """Adds distance, metres to the nearest marked cell's centre; infinite where there is none. cells: (keys, row, col) of full rows; marks: (keys, row, col), which may lie above or below them too.

    Exact, in two shuffles: by column, where windows down and up give the vertical distance, and by bands of rows, where every row takes the least of vertical² + horizontal² in NumPy.
    """
    place = [*keys, "row", "col"]
    both = cells.select(*place, F.lit(1).alias("_c"), F.lit(0).alias("_m")).unionByName(marks.select(*place, F.lit(0).alias("_c"), F.lit(1).alias("_m")))
    marked = both.repartition(*keys, "col").groupBy(*place).agg(F.max("_c").alias("_c"), F.max("_m").alias("_m"))
    w = Window.partitionBy(*keys, "col").orderBy("row")
    at = F.when(F.col("_m") == 1, F.col("row"))
    above = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("row") - above, below - F.col("row"))  # least passes over a null
    lines = marked.withColumn("_gap", F.coalesce(gap.cast("double"), F.lit(float("inf")))).filter("_c = 1").drop("_m", "_c").withColumn("_band", F.floor(F.col("row") / band))
    kept = [*place, "distance"]

    def envelope(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        order = np.lexsort((col, row))
        row, col, g = row[order], col[order], table.column("_gap").to_numpy()[order]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        first, width = np.minimum.reduceat(col, begin), int(np.diff(np.append(begin, len(row))).max())
        full = np.full((len(begin), width), np.inf)
        line = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(row))))
        full[line, col - first[line]] = g
        cost = nearest_in_rows(full)[line, col - first[line]]
        out = table.take(pa.array(order)).drop(["_gap", "_band"])
        return out.append_column("distance", pa.array(np.sqrt(cost) * cell)).select(kept)

    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    ddl = ", ".join(f"`{c}` {kind[c]}" for c in place) + ", distance double"
    return lines.groupBy(*keys, "_band").applyInArrow(envelope, ddl)


def distance_map(grids: DataFrame, features: DataFrame, mark, geo: Geometry, margin: float = 100.0) -> DataFrame:
    """(grid, row, col, distance) for every cell of each grid (grid): metres to the nearest cell that mark(features, geometry) marks, up to `margin` metres outside the raster too."""
    pad = int(-(-margin // geo.cell))
    wide = geo.padded(pad)
    cells = grids.select("grid").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(wide.height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(wide.width - 1))))
    out = distances(cells, mark(features, wide), geo.cell)
    return out.select("grid", (F.col("row") - pad).alias("row"), (F.col("col") - pad).alias("col"), "distance").filter(geo.inside())


def resample(targets: DataFrame, source: DataFrame, origin_e: float, origin_n: float, pixel: float, width: int, height: int, nearest: bool = False) -> DataFrame:
    """Adds value at targets (grid, e, n) from source pixels (grid, row, col, v): bilinear between pixel centres, clamped at the edge; where one of the four is unknown, the nearest pixel; null outside."""
    from .raster import with_neighbours

    px, py = (F.col("e") - origin_e) / pixel - 0.5, (F.lit(origin_n) - F.col("n")) / pixel - 0.5
    inside = px.between(-0.5, width - 0.5) & py.between(-0.5, height - 0.5)
    clamp = lambda x, hi: F.least(F.lit(hi), F.greatest(F.lit(0), x))
    t = targets.withColumns({"_px": px, "_py": py, "_in": inside})
    t = t.withColumns({"_x": clamp(F.floor("_px"), max(0, width - 2)).cast("int"), "_y": clamp(F.floor("_py"), max(0, height - 2)).cast("int")})
    t = t.withColumns({"_fx": clamp(F.col("_px") - F.col("_x"), 1.0), "_fy": clamp(F.col("_py") - F.col("_y"), 1.0)})
    four = with_neighbours(source, "v", ("grid",)).select("grid", F.col("row").alias("_y"), F.col("col").alias("_x"), F.col("z").alias("_a"), F.col("f").alias("_b"), F.col("h").alias("_c"), F.col("k").alias("_d"))
    t = t.join(four, ["grid", "_y", "_x"], "left")
    fx, fy = F.col("_fx"), F.col("_fy")
    mixed = (F.col("_a") * (1 - fx) + F.col("_b") * fx) * (1 - fy) + (F.col("_c") * (1 - fx) + F.col("_d") * fx) * fy
    near = F.when((fx < 0.5) & (fy < 0.5), F.col("_a")).when(fy < 0.5, F.col("_b")).when(fx < 0.5, F.col("_c")).otherwise(F.col("_d"))
    return t.withColumn("value", F.when(F.col("_in"), near if nearest else F.coalesce(mixed, near))).select(*targets.columns, "value")


def vegetation(cells: DataFrame, surface: str, layer: str, width: int, height: int, grid: tuple[str, ...] = ("grid",)) -> DataFrame:
    """Adds canopy: the second highest of four surface heights (array column, sub-rows then sub-columns, null for unknown) over the bilinear ground below each, at least 0."""
    from .raster import with_neighbours

    out = with_neighbours(cells.withColumn("_v", F.col(layer)), "_v", grid)
    name = {(-1, -1): "a", (-1, 0): "b", (-1, 1): "c", (0, -1): "d", (0, 0): "z", (0, 1): "f", (1, -1): "g", (1, 0): "h", (1, 1): "k"}

    def line(sub: int, axis: str, size: int) -> list[tuple[Column, int, int, float]]:
        """Cases (condition, low offset, high offset, fraction) along one axis."""
        at = F.col(axis)
        if sub == 0:
            return [(at == 0, 0, 1, -0.25), (at > 0, -1, 0, 0.75)]
        return [(at == size - 1, -1, 0, 1.25), (at < size - 1, 0, 1, 0.25)]

    heights = []
    for j in (0, 1):
        for i in (0, 1):
            ground = None
            for cy, y0, y1, ty in line(j, "row", height):
                for cx, x0, x1, tx in line(i, "col", width):
                    g = (F.col(name[y0, x0]) * (1 - tx) + F.col(name[y0, x1]) * tx) * (1 - ty) + (F.col(name[y1, x0]) * (1 - tx) + F.col(name[y1, x1]) * tx) * ty
                    ground = F.when(cy & cx, g) if ground is None else ground.when(cy & cx, g)
            over = F.get(surface, F.lit(2 * j + i)) - ground
            heights.append(F.when(over.isNotNull(), F.greatest(F.lit(0.0), over)))
    order = F.sort_array(F.array_compact(F.array(*heights)), asc=False)
    return out.withColumn("canopy", F.get(order, F.least(F.lit(1), F.size(order) - 1))).select(*cells.columns, "canopy")
