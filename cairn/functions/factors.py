"""Scoring factors and depth measures as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
FLOORS = {"trail": 0.15, "water": 0.5, "drinking": 0.6}
NEARBY = {"trail": 300.0, "water": 400.0, "drinking": 800.0}
CLEARANCE_M, QUIET_M, ON_TRAIL = 8.0, 60.0, 0.2
BAND_EDGES_KM = (5.0, 15.0, 40.0, 100.0)


def smoothstep(t: Column) -> Column:
    """0 up to 0, 1 from 1 on; null stays null."""
    t = F.when(t.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))
    return t * t * (3 - 2 * t)


def fade(v: Column, ok: float, worst: float) -> Column:
    """1 up to ok, 0 from worst on, smooth between."""
    return 1 - smoothstep((v - ok) / (worst - ok))


def trail_quiet(d: Column) -> Column:
    return F.when(d < CLEARANCE_M, ON_TRAIL).otherwise(ON_TRAIL + (1 - ON_TRAIL) * smoothstep((d - CLEARANCE_M) / (QUIET_M - CLEARANCE_M)))


def nearness(d: Column, most: float, floor: float) -> Column:
    """1 up to `most`, falling to the floor at twice that; no such feature (infinity) is the floor, unknown (null) is 1."""
    return F.when(d.isNull() | F.isnan(d) | (d <= most), 1.0).otherwise(floor + (1 - floor) * F.greatest(F.lit(0.0), 2 - d / most))


def remoteness(d: Column, least: float, floor: float) -> Column:
    """The floor at the feature, rising to 1 at `least`; unknown is 1."""
    return F.when(d < least, floor + (1 - floor) * d / least).otherwise(1.0)


def preference(d: Column, signed: float, floor: float) -> Column:
    return nearness(d, signed, floor) if signed > 0 else remoteness(d, -signed, floor)


def depth(metres: Column, radius: float) -> Column:
    return F.least(F.lit(1.0), F.log(F.greatest(metres, F.lit(1000.0)) / 1000) / math.log(radius / 1000))


def band(metres: Column) -> Column:
    return sum(((metres / 1000 >= edge).cast("int") for edge in BAND_EDGES_KM), F.lit(0))


def snowline(lat: Column) -> Column:
    return 5300 - 55 * F.abs(lat)


def snow_band(elev: Column, line: Column, metres: Column) -> Column:
    above = elev - line
    return F.when(above <= 0, 0.0).otherwise(F.degrees(F.atan2(F.least(above * 0.6, F.lit(900.0)), metres)))


def slope_limit(ok: Column) -> Column:
    return F.greatest(2 * ok, ok + 3)
