"""Geometry of a panorama view and of its export as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import wrap180
from ..functions.text import half_up, hash_pair

#: Pixels of a tile, share of the wanted resolution that a level must have, tiles around the circle of each level, most pixels of an export, sizes of its footer text.
TILE, ENOUGH = 512, 0.97
LEVELS, MOST_PIXELS, FONT = (4, 6, 8, 11, 16, 23, 32, 45, 64, 90, 128, 181, 256), 16_000_000, (14, 48)


def x_of(az: Column, center: Column, px: Column, width: Column) -> Column:
    return width / 2 + wrap180(az - center) * px


def y_of(angle: Column, top: Column, px: Column, exaggeration: Column) -> Column:
    return (top - angle) * px * exaggeration


def level_for(px: Column) -> Column:
    """The coarsest level with ENOUGH of this resolution, or the finest."""
    fits = F.filter(F.array(*map(F.lit, LEVELS)), lambda n: n * TILE / 360.0 >= px * ENOUGH)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(LEVELS[-1]))


def visible_tiles(n: Column, left: Column, top: Column, px: Column, width: Column, height: Column, upper: Column, lower: Column) -> Column:
    """array<struct<kx, ky>> of the tiles of level n that a view covers, within the content between two angles."""
    own = n * TILE / 360.0
    rows = F.ceil((upper - lower) * own / TILE)
    first, last = F.greatest(F.lit(0), F.floor((upper - top) * own / TILE)), F.least(rows - 1, F.floor((upper - top + height / px) * own / TILE))
    ky = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))  # a sequence would run backwards for a view beyond the content
    kx = F.sequence(F.floor(left * n / 360.0), F.floor((left + width / px) * n / 360.0))
    return F.flatten(F.transform(ky, lambda y: F.transform(kx, lambda x: F.struct(x.alias("kx"), y.alias("ky")))))


def footer_font(width: Column) -> Column:
    return F.least(F.lit(FONT[1]), F.greatest(F.lit(FONT[0]), half_up(width / 90)))


def export_plan(field: Column, span: Column, exaggeration: Column, wanted: Column, steps: int = 200) -> Column:
    """struct<px, width, height, footer>: the wanted resolution, lowered by a twentieth at a time until the image is small enough. No image is larger than that of the step before, so the step is found by halving."""
    shares = F.array(*(F.pow(F.lit(0.95), F.lit(k)) for k in range(steps + 1)))

    def plan(k: Column) -> dict[str, Column]:
        px = wanted * F.get(shares, k)
        width, height = F.greatest(F.lit(1), half_up(field * px)), F.greatest(F.lit(1), half_up(span * px * exaggeration))
        return {"px": px, "width": width, "height": height, "footer": half_up(footer_font(width) * 4.2)}

    def large(k: Column) -> Column:
        p = plan(k)
        return p["width"] * (p["height"] + p["footer"]) > MOST_PIXELS

    halves = F.array(*(F.lit(1 << b) for b in reversed(range((steps + 1).bit_length()))))
    last_large = F.aggregate(halves, F.lit(-1), lambda k, s: F.when((k + s <= steps) & large(F.least(k + s, F.lit(steps))), k + s).otherwise(k))
    chosen = F.transform(F.array(last_large), lambda k: F.when(k < steps, F.struct(*(c.alias(n) for n, c in plan(k + 1).items()))))
    return F.get(chosen, F.lit(0))


def rays_per_vertex(rays: int, px_per_ray: Column, least: float) -> Column:
    """The most rays, of those that divide the circle, whose width is at most `least` pixels."""
    divisors = F.array(*(F.lit(k) for k in range(rays, 0, -1) if rays % k == 0))
    want = F.greatest(F.lit(1), F.floor(least / px_per_ray))
    return F.get(F.filter(divisors, lambda k: k <= want), F.lit(0))


def noise(seed: Column, x: Column, around: int | None = None) -> Column:
    """Smooth value noise in [-1, 1]; with `around`, periodic in so many cells."""
    i = F.floor(x)
    f = x - i
    at = lambda k: hash_pair(seed, F.pmod(k, F.lit(around)) if around else k) / 4294967296.0 * 2 - 1
    a, b = at(i), at(i + 1)
    return a + (b - a) * f * f * (3 - 2 * f)
