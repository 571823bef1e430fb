"""Geodesy, tile and projection formulas as Column expressions (double in, double out; null in, null out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius (m), standard refraction, metres per pixel at zoom 0 on the equator.
EARTH_RADIUS_M, REFRACTION_K, EQUATOR_PIXEL_M = 6_371_000.0, 0.13, 156543.03
#: Extent of Switzerland and Liechtenstein: south, north, west, east.
SWISS_BOX = (45.8, 47.85, 5.9, 10.55)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def curvature_drop(d, k: float = REFRACTION_K) -> Column:
    return _c(d) * _c(d) / (2 * EARTH_RADIUS_M) * (1 - k)


def elevation_angle(target, observer, d) -> Column:
    return F.degrees(F.atan2(_c(target) - curvature_drop(d) - _c(observer), _c(d)))


def wrap360(x) -> Column:
    return F.pmod(_c(x), F.lit(360.0))


def wrap180(x) -> Column:
    return F.pmod(_c(x) + 180, F.lit(360.0)) - 180


def destination(lat, lon, bearing, metres) -> tuple[Column, Column]:
    """(lat, lon) of the point reached along an initial bearing on the sphere."""
    delta, theta, phi = _c(metres) / EARTH_RADIUS_M, F.radians(_c(bearing)), F.radians(_c(lat))
    up = F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta)
    turn = F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * up)
    return F.degrees(F.asin(up)), wrap180(F.degrees(F.radians(_c(lon)) + turn))


def distance(lat1, lon1, lat2, lon2) -> Column:
    half = lambda a, b: F.sin(F.radians(_c(b) - _c(a)) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * F.pow(half(lon1, lon2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS_M)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    p1, p2, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return wrap360(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def to_tile(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Fractional (x, y) of the slippy tile scheme."""
    n, phi = float(2**zoom), F.radians(_c(lat))
    return (_c(lon) + 180) / 360 * n, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n


def from_tile(x, y, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * _c(y) / n)))), _c(x) / n * 360 - 180


def metres_per_pixel(lat, zoom: int) -> Column:
    return EQUATOR_PIXEL_M * F.cos(F.radians(_c(lat))) / float(2**zoom)


def _polynomial(terms: dict[tuple[int, int], float], u: Column, v: Column) -> Column:
    out: Column = F.lit(0.0)
    for (i, j), c in terms.items():
        out = out + F.lit(c) * F.pow(u, F.lit(i)) * F.pow(v, F.lit(j))
    return out


#: Published approximation polynomials between WGS84 and LV95, by powers of the two auxiliary values.
LV95_EAST = {(0, 0): 2600072.37, (1, 0): 211455.93, (1, 1): -10938.51, (1, 2): -0.36, (3, 0): -44.54}
LV95_NORTH = {(0, 0): 1200147.07, (0, 1): 308807.95, (2, 0): 3745.25, (0, 2): 76.63, (2, 1): -194.56, (0, 3): 119.79}
LV95_LON = {(0, 0): 2.6779094, (1, 0): 4.728982, (1, 1): 0.791484, (1, 2): 0.1306, (3, 0): -0.0436}
LV95_LAT = {(0, 0): 16.9023892, (0, 1): 3.238272, (2, 0): -0.270978, (0, 2): -0.002528, (2, 1): -0.0447, (0, 3): -0.014}


def to_lv95(lat, lon) -> tuple[Column, Column]:
    """(easting, northing); the auxiliary values are longitude and latitude from Bern in units of 10000 seconds."""
    u, v = (_c(lon) * 3600 - 26782.5) / 10000, (_c(lat) * 3600 - 169028.66) / 10000
    return _polynomial(LV95_EAST, u, v), _polynomial(LV95_NORTH, u, v)


def from_lv95(e, n) -> tuple[Column, Column]:
    """(lat, lon); the auxiliary values are easting and northing from Bern in 1000 km."""
    u, v = (_c(e) - 2_600_000) / 1e6, (_c(n) - 1_200_000) / 1e6
    return _polynomial(LV95_LAT, u, v) * 100 / 36, _polynomial(LV95_LON, u, v) * 100 / 36


class Laea:
    """Lambert azimuthal equal-area on the GRS80 ellipsoid (EPSG method 9820); the defaults are EPSG:3035."""

    A, FLATTENING = 6378137.0, 1 / 298.257222101

    def __init__(self, lat0: float = 52.0, lon0: float = 10.0, false_e: float = 4321000.0, false_n: float = 3210000.0):
        self.lat0, self.lon0, self.fe, self.fn = lat0, lon0, false_e, false_n
        self.e2 = self.FLATTENING * (2 - self.FLATTENING)
        self.e = math.sqrt(self.e2)
        s = math.sin(math.radians(lat0))
        authalic = lambda x: (1 - self.e2) * (x / (1 - self.e2 * x * x) - math.log((1 - self.e * x) / (1 + self.e * x)) / (2 * self.e))
        self.pole = authalic(1.0)
        beta = math.asin(authalic(s) / self.pole)
        self.sb, self.cb = math.sin(beta), math.cos(beta)
        self.radius = self.A * math.sqrt(self.pole / 2)
        self.d = self.A * math.cos(math.radians(lat0)) / math.sqrt(1 - self.e2 * s * s) / (self.radius * self.cb)

    def forward(self, lat, lon) -> tuple[Column, Column]:
        s, dl = F.sin(F.radians(_c(lat))), F.radians(_c(lon) - self.lon0)
        q = (1 - self.e2) * (s / (1 - self.e2 * s * s) - F.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))
        sb = q / self.pole
        cb = F.sqrt(1 - sb * sb)
        b = self.radius * F.sqrt(2 / (1 + self.sb * sb + self.cb * cb * F.cos(dl)))
        return self.fe + b * self.d * cb * F.sin(dl), self.fn + b / self.d * (self.cb * sb - self.sb * cb * F.cos(dl))

    def inverse(self, e, n) -> tuple[Column, Column]:
        x, y = (_c(e) - self.fe) / self.d, (_c(n) - self.fn) * self.d
        rho = F.sqrt(x * x + y * y)
        c = 2 * F.asin(rho / (2 * self.radius))
        beta = F.asin(F.cos(c) * self.sb + y * F.sin(c) * self.cb / rho)
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        series = [(2, e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040), (4, 23 * e4 / 360 + 251 * e6 / 3780), (6, 761 * e6 / 45360)]
        phi = sum((F.sin(k * beta) * w for k, w in series), beta)
        lam = F.atan2(x * F.sin(c), rho * self.cb * F.cos(c) - y * self.sb * F.sin(c))
        at = rho == 0
        return F.when(at, self.lat0).otherwise(F.degrees(phi)), F.when(at, self.lon0).otherwise(self.lon0 + F.degrees(lam))


def in_switzerland(lat, lon) -> Column:
    south, north, west, east = SWISS_BOX
    return _c(lat).between(south, north) & _c(lon).between(west, east)


#: Sine of the latitude at which the square Mercator world ends.
MAX_SIN_LAT = math.sin(math.radians(85.05))


def ray_pixel(lat, lon, theta, delta, world_px: float) -> tuple[Column, Column]:
    """Global Mercator pixel of the point at angular distance delta along bearing theta (both radians)."""
    phi, theta, delta = F.radians(_c(lat)), _c(theta), _c(delta)
    s = F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta)
    s = F.least(F.lit(MAX_SIN_LAT), F.greatest(F.lit(-MAX_SIN_LAT), s))
    turn = F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * s)
    return (F.radians(_c(lon)) + turn + math.pi) / (2 * math.pi) * world_px, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * world_px


#: Metres in a degree of latitude; from this latitude of a disc's edge on, it takes in all longitudes.
METRES_PER_DEGREE, POLAR_LAT = 111_194.9, 89


def bboxes(lat, lon, radius) -> Column:
    """array<struct<south,west,north,east>> around a disc: two boxes where it crosses the antimeridian, all longitudes near a pole."""
    lat, lon = _c(lat), _c(lon)
    high = _c(radius) / METRES_PER_DEGREE
    edge = F.abs(lat) + high
    wide = F.when(edge >= POLAR_LAT, 180.0).otherwise(high / F.cos(F.radians(edge)))
    west, east = lon - wide, lon + wide

    def box(w: Column, e: Column) -> Column:
        return F.struct(F.greatest(F.lit(-90.0), lat - high).alias("south"), w.alias("west"), F.least(F.lit(90.0), lat + high).alias("north"), e.alias("east"))

    low, top = F.lit(-180.0), F.lit(180.0)
    return F.when(wide >= 180, F.array(box(low, top))).when(west < low, F.array(box(west + 360, top), box(low, east))).when(east > top, F.array(box(west, top), box(low, east - 360))).otherwise(F.array(box(west, east)))


def _bands(size: float) -> tuple[float, int]:
    """Height of a band of latitude that is at least `size` metres high, in degrees, and how many there are."""
    n = max(1, int(180 * 111_000 / size))
    return 180.0 / n, n


def _cells_of(band: Column, height: float, size: float) -> Column:
    """How many cells of at least `size` metres a band has around the earth."""
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    return F.greatest(F.lit(1), F.floor(360 * 111_000 * F.cos(F.radians(edge)) / size))


def ground_cell(lat: Column, lon: Column, size: float) -> Column:
    """struct<band, cell>: the cell of ground under a point; cells are about `size` metres high and wide, in bands of latitude."""
    height, n = _bands(size)
    band = F.least(F.lit(n - 1), F.floor((lat + 90) / height))
    many = _cells_of(band, height, size)
    return F.struct(band.alias("band"), F.pmod(F.floor((lon + 180) / 360 * many), many).alias("cell"))


def ground_cells(lat: Column, lon: Column, radius: Column, size: float) -> Column:
    """array<struct<band, cell>>: all cells of ground that have a point within radius metres of a place, over the date line and the poles too."""
    height, n = _bands(size)
    reach = radius / 111_000
    bands = F.sequence(F.greatest(F.lit(0), F.floor((lat - reach + 90) / height)), F.least(F.lit(n - 1), F.floor((lat + reach + 90) / height)))

    def row(band: Column) -> Column:
        edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
        far = F.sin(F.least(radius / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))) / F.sqrt(F.greatest(F.lit(1e-12), F.cos(F.radians(lat)) * F.cos(F.radians(edge))))
        turn = F.when(far >= 1, F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), far))))
        many = _cells_of(band, height, size)
        first, last = (F.floor((lon + s * turn + 180) / 360 * many) for s in (-1, 1))
        return F.transform(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + many)), lambda c: F.pmod(c, many))), lambda c: F.struct(band.alias("band"), c.alias("cell")))

    return F.flatten(F.transform(bands, row))
