"""Operators on rasters in long form: DataFrames (*grid, row, col, layers...), row 0 in the north, null for no data.

Windows are partitioned by (*grid, row) or (*grid, col), so that work spreads over rows and columns of all grids and no task holds a whole grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import CLEARANCE_M, FLOORS, ON_TRAIL, fade, nearness, preference, remoteness, trail_quiet
from .staging import written

#: Fixed values of suitability: comfortable and worst slope (degrees), roughness (m) and vegetation height (m).
SLOPE, ROUGH, CANOPY = (5.0, 10.0), (0.08, 0.3), (0.5, 3.0)
FLAT_RADIUS, FLAT_RANGE, SHORE = 2, 0.02, 2
NEIGHBOURS = {(-1, -1): "a", (-1, 0): "b", (-1, 1): "c", (0, -1): "d", (0, 0): "z", (0, 1): "f", (1, -1): "g", (1, 0): "h", (1, 1): "k"}


def _rows(grid: Sequence[str]) -> Window:
    return Window.partitionBy(*grid, "row").orderBy("col")


def _cols(grid: Sequence[str]) -> Window:
    return Window.partitionBy(*grid, "col").orderBy("row")


def with_neighbours(cells: DataFrame, layer: str, grid: Sequence[str] = ()) -> DataFrame:
    """Adds columns a..k, the 3 x 3 neighbourhood of a layer (north row a b c, middle d z f, south g h k); null beyond the edge or where a cell is missing. Two shuffles."""
    w, v = _rows(grid), _cols(grid)
    beside = lambda k: F.when((F.lag if k < 0 else F.lead)("col", 1).over(w) == F.col("col") + k, (F.lag if k < 0 else F.lead)(layer, 1).over(w))
    out = cells.withColumn("_line", F.struct(beside(-1).alias("w"), F.col(layer).alias("m"), beside(1).alias("e")))
    above = lambda k: F.when((F.lag if k < 0 else F.lead)("row", 1).over(v) == F.col("row") + k, (F.lag if k < 0 else F.lead)("_line", 1).over(v))
    out = out.withColumn("_north", above(-1)).withColumn("_south", above(1))
    part = {-1: "_north", 0: "_line", 1: "_south"}
    return out.withColumns({name: F.col(f"{part[dy]}.{'wme'[dx + 1]}") for (dy, dx), name in NEIGHBOURS.items()}).drop("_line", "_north", "_south")


def gradient(cell: float) -> tuple[Column, Column]:
    """Horn's gradient from a neighbourhood; null if one of the nine is."""
    c = {n: F.col(n) for n in NEIGHBOURS.values()}
    known = F.col("z").isNotNull()
    east = (c["c"] + 2 * c["f"] + c["k"] - c["a"] - 2 * c["d"] - c["g"]) / (8 * cell)
    north = (c["a"] + 2 * c["b"] + c["c"] - c["g"] - 2 * c["h"] - c["k"]) / (8 * cell)
    whole = known & east.isNotNull() & north.isNotNull()
    return F.when(whole, east), F.when(whole, north)


def terrain(cells: DataFrame, layer: str = "z", cell: float = 2.0, grid: Sequence[str] = ()) -> DataFrame:
    """Adds slope (degrees) and roughness (root mean square of the neighbours' heights over the local plane)."""
    out = with_neighbours(cells.withColumn("_kept", F.col(layer)), "_kept", grid)
    east, north = gradient(cell)
    out = out.withColumn("_gx", east).withColumn("_gy", north)
    residuals = [F.pow(F.col(n) - (F.col("z") + F.col("_gx") * dx * cell - F.col("_gy") * dy * cell), 2) for (dy, dx), n in NEIGHBOURS.items() if (dy, dx) != (0, 0)]
    out = out.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).withColumn("roughness", F.sqrt(sum(residuals[1:], residuals[0]) / 8))
    return out.select(*(c for c in cells.columns if c not in ("slope", "roughness") and c != layer), F.col("_kept").alias(layer), "slope", "roughness")


def box_aggregate(cells: DataFrame, radius: int, grid: Sequence[str] = (), down_first: bool = False, **parts) -> DataFrame:
    """Adds name=(function, value) over the (2 radius + 1)² cells around each, all of them in one pass along the rows and one along the columns.

    The passes commute: one that begins as the operator before it ended needs no shuffle there.
    """
    one, two = (w.rangeBetween(-radius, radius) for w in ((_cols(grid), _rows(grid)) if down_first else (_rows(grid), _cols(grid))))
    out = cells.withColumns({f"_{n}": how(value).over(one) for n, (how, value) in parts.items()})
    return out.withColumns({n: how(f"_{n}").over(two) for n, (how, _) in parts.items()}).drop(*(f"_{n}" for n in parts))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def on_border(width: Column, height: Column, radius: int) -> Column:
    return (F.col("col") < radius) | (F.col("row") < radius) | (F.col("col") >= width - radius) | (F.col("row") >= height - radius)


def flat_surface(cells: DataFrame, width, height, layer: str = "z", grid: Sequence[str] = ()) -> DataFrame:
    """Adds flat: 1 where the heights around differ by less than FLAT_RANGE, else 0; null on the border and without data. Unknown neighbours don't count."""
    out = box_aggregate(cells, FLAT_RADIUS, grid, True, _high=(F.max, F.col(layer)), _low=(F.min, F.col(layer)))
    border = on_border(_col(width), _col(height), FLAT_RADIUS)
    return out.withColumn("flat", F.when(border | F.col(layer).isNull(), None).otherwise((F.col("_high") - F.col("_low") < FLAT_RANGE).cast("int"))).drop("_high", "_low")


def dilate(cells: DataFrame, layer: str, radius: int = SHORE, grid: Sequence[str] = ()) -> DataFrame:
    """Marks (1) everything within `radius` cells of a marked cell, unknown cells too; the others stay as they are."""
    out = box_aggregate(cells, radius, grid, _near=(F.max, F.coalesce((F.col(layer) == 1).cast("int"), F.lit(0))))
    return out.withColumn(layer, F.when(F.col("_near") == 1, 1).otherwise(F.col(layer))).drop("_near")


def patch_minimum(cells: DataFrame, layer: str, width, height, radius: int = 1, grid: Sequence[str] = ()) -> DataFrame:
    """The smallest value of the patch around each cell: unknown counts as 0, and so does everything beyond the border."""
    out = box_aggregate(cells, radius, grid, True, _least=(F.min, F.coalesce(F.col(layer), F.lit(0.0))))
    return out.withColumn(layer, F.when(on_border(_col(width), _col(height), radius), 0.0).otherwise(F.col("_least"))).drop("_least")


def suitability(slope: Column, roughness: Column, water: Column, canopy: Column | None = None) -> Column:
    """Product of fades; 0 on water, null without slope or roughness; unknown vegetation does not count."""
    score = fade(slope, *SLOPE) * fade(roughness, *ROUGH)
    if canopy is not None:
        score = score * F.coalesce(fade(canopy, *CANOPY), F.lit(1.0))
    return F.when(slope.isNull() | roughness.isNull(), None).when(water == 1, 0.0).otherwise(score)


def camp_score(suit: Column, trail: Column | None = None, water: Column | None = None, drinking: Column | None = None, hidden: Column | None = None, nearby: dict[str, float] | None = None) -> Column:
    """Suitability times the signed preferences; a layer that is None is unknown and does not count; null and 0 stay."""
    from ..functions.factors import NEARBY

    wish = NEARBY | (nearby or {})
    score = suit
    if trail is not None and wish["trail"] > 0:
        score = score * trail_quiet(trail) * nearness(trail, wish["trail"], FLOORS["trail"])
    elif trail is not None and wish["trail"] < 0:
        score = score * F.when(trail < CLEARANCE_M, ON_TRAIL).otherwise(remoteness(trail, -wish["trail"], FLOORS["trail"]))
    for name, d in (("water", water), ("drinking", drinking)):
        if d is not None and wish[name]:
            score = score * preference(d, wish[name], FLOORS[name])
    if hidden is not None:
        score = F.when(F.coalesce(hidden, F.lit(False)), 0.0).otherwise(score)
    return F.when(suit.isNull() | (suit == 0), suit).otherwise(score)


def block_best(cells: DataFrame, score: str, block: int, grid: Sequence[str] = ()) -> DataFrame:
    """The best cell of each block x block square: the first in row-major order on a tie; unknown cells don't count."""
    key = F.struct(F.col(score), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))
    by = cells.filter(F.col(score).isNotNull()).groupBy(*grid, F.floor(F.col("row") / block).alias("block_row"), F.floor(F.col("col") / block).alias("block_col"))
    return by.agg(F.max(key).alias("_b")).select(*grid, "block_row", "block_col", (-F.col("_b.r")).alias("row"), (-F.col("_b.c")).alias("col"), F.col(f"_b.{score}").alias(score))


def pick_spots(cells: DataFrame, score: str = "score", cell: float = 2.0, count: int = 3, separation: float = 300.0, least: float = 0.5, grid: Sequence[str] = ()) -> DataFrame:
    """The best spots that keep their distance from better ones: rank, row, col, score for each grid.

    Candidates are one cell a block of 10 m. The greedy choice goes in rounds: a candidate that no better one is near is chosen, and those near it leave. It is the best of its square, whose diagonal is the separation, and meets the candidates of
    the 25 squares around by equi-join. Candidates worse than `count` chosen ones of their grid leave too, so a few rounds do, whatever the grid's size; no task holds a grid.
    """
    block, keys = max(1, int(10 / cell + 0.5)), [*grid, "_all"]
    side = max(separation, 1e-6) / math.sqrt(2) / cell
    square = [*keys, "_y", "_x"]
    place = [F.floor(F.col("row") / side).alias("_y"), F.floor(F.col("col") / side).alias("_x")]
    order = F.struct(F.col(score).alias("s"), (-F.col("block_row")).alias("r"), (-F.col("block_col")).alias("c"))
    best = block_best(cells, score, block, grid).filter(F.col(score) >= least).withColumn("_all", F.lit(0))
    left = written(best.select(*keys, "row", "col", order.alias("_o"), *place), "spots")
    near = F.hypot((F.col("row") - F.col("_r")) * cell, (F.col("col") - F.col("_c")) * cell) < separation
    nearby = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2))

    def meet(spots: DataFrame, how: str) -> DataFrame:
        """Candidates with the spots of the 25 squares around."""
        own = spots.select(*(F.col(k).alias(f"_of_{k}") for k in square), F.col("_o").alias("_t"), F.col("row").alias("_r"), F.col("col").alias("_c"))
        around = own.withColumn("_of__y", nearby("_of__y")).withColumn("_of__x", nearby("_of__x"))
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) if k in grid else F.col(k) == F.col(f"_of_{k}") for k in square]
        return left.join(around, [*same, *([near | (F.col("_o") == F.col("_t"))] if how == "left_anti" else [])], how)

    found = None
    while True:
        tops = left.groupBy(*square).agg(F.max(F.struct("_o", "row", "col")).alias("_b")).select(*square, "_b.*")
        beaten = F.max(near & (F.col("_o") > F.col("_t"))).alias("_beaten")
        free = meet(tops, "inner").groupBy(*keys, "_t", "_r", "_c").agg(beaten).filter("NOT _beaten")
        new = written(free.select(*keys, F.col("_t").alias("_o"), F.col("_r").alias("row"), F.col("_c").alias("col")).select("*", *place), "new")
        found = new if found is None else found.unionByName(new)
        chosen = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_o").desc()))).filter(F.col("rank") <= count)
        last = chosen.filter(F.col("rank") == count).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_o").alias("_last"))
        rest = meet(new, "left_anti").join(last, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
        left = written(rest.filter("_last IS NULL OR _o > _last").select(*left.columns), "spots")
        if left.isEmpty():
            return chosen.select(*grid, "rank", "row", "col", F.col("_o.s").cast("double").alias(score))
