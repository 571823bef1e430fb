"""Tolerant parsing and formatting of text as Column expressions; what cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eight winds; plausible heights in metres; a foot.
WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
LOWEST, HIGHEST, FOOT = -500.0, 9000.0, 0.3048


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use takes it: generated code would repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_elevation(raw: Column) -> Column:
    """Metres from "2962 m", "2962,5", "4,808", "9,000 ft", "14'505 ft"; null if unreadable or implausible."""

    def plain(digits: Column) -> Column:
        return F.when(digits.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$"), F.regexp_replace(digits, ",", "")).otherwise(F.regexp_replace(digits, "^([^,]*),", "$1."))

    def value(s: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(s, r"-?[0-9][0-9,.' ]*", 0), "[' ]", "")
        number = F.regexp_extract(bound(digits, plain), r"^-?[0-9]+([.][0-9]*)?", 0).try_cast("double")
        return number * F.when(s.rlike(r"\bft\b|feet"), FOOT).otherwise(1.0)

    return bound(bound(F.lower(F.trim(raw)), value), lambda v: F.when(v.between(LOWEST, HIGHEST), v))


PERIOD = r"([0-9]{1,2})\.([0-9]{1,2})\.?\s*[-–]\s*([0-9]{1,2})\.([0-9]{1,2})\.?"


def in_force(period: Column, month: Column, day: Column) -> Column:
    """Whether any "dd.mm. - dd.mm." of a text covers the day; ranges may pass the year's end; a text without one is always in force."""
    part = lambda k: F.regexp_extract_all(period, F.lit(PERIOD), F.lit(k))
    ranges = F.arrays_zip(*(part(k).alias(n) for k, n in ((1, "d1"), (2, "m1"), (3, "d2"), (4, "m2"))))
    today = month * 100 + day

    def covers(r: Column) -> Column:
        start, end = (r[m].cast("int") * 100 + r[d].cast("int") for d, m in (("d1", "m1"), ("d2", "m2")))
        after, before = today >= start, today <= end
        return F.when(start <= end, after & before).otherwise(after | before)

    return F.when(period.isNull() | (F.size(ranges) == 0), True).otherwise(F.exists(ranges, covers))


def known_text(x: Column) -> Column:
    """Trimmed text; blank and "None" are missing."""
    return F.nullif(F.nullif(F.trim(x), F.lit("")), F.lit("None"))


def format_distance(m: Column) -> Column:
    return F.when(m / 1000 < 10, F.format_string("%.1f km", m / 1000)).otherwise(F.concat(half_up(m / 1000), F.lit(" km")))


def format_metres(m: Column) -> Column:
    return F.when(m < 1000, F.concat(half_up(m / 10) * 10, F.lit(" m"))).otherwise(format_distance(m))


def format_signed(v: Column) -> Column:
    return F.when(v == 0, "Off").otherwise(F.concat(F.when(v > 0, "+").otherwise("-"), F.abs(v), F.lit(" m")))


def format_bearing(az: Column) -> Column:
    degrees = half_up(F.pmod(az, F.lit(360.0))) % 360
    wind = F.element_at(F.array(*map(F.lit, WINDS)), (half_up(degrees / 45) % 8 + 1).cast("int"))
    return F.concat(degrees, F.lit("° "), wind)


def format_coordinates(lat: Column, lon: Column) -> Column:
    side = lambda x, a, b: F.format_string("%.4f° %s", F.abs(x), F.when(x >= 0, a).otherwise(b))
    return F.concat(side(lat, "N", "S"), F.lit(", "), side(lon, "E", "W"))


def near_text(label: str, d: Column) -> Column:
    """Null if the distance is unknown, "no ... in this box" if there is no such feature."""
    return F.when(d.isNull(), None).when(d == float("inf"), f"no {label} in this box").otherwise(F.concat(format_metres(d), F.lit(f" from {label}")))


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def slug(x: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; "panorama" if nothing is left."""
    words = F.regexp_replace(F.translate(F.lower(x), *ACCENTS), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(words, "^-+|-+$", ""), F.lit("")), F.lit("panorama"))


def normal_query(x: Column) -> Column:
    """Trimmed, single spaces, lower case; null under two characters."""
    q = F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.when(F.length(q) >= 2, q)


def zoom_for_span(span: Column) -> Column:
    return F.when(span > 0, F.greatest(F.lit(3), F.least(F.lit(15), F.floor(F.log2(360 / span)) + 1))).otherwise(14)


MASK = 0xFFFFFFFF


def multiply32(a: Column, b: Column | int) -> Column:
    """The low 32 bits of a product of two unsigned 32-bit numbers, in 64-bit arithmetic: halves are multiplied apart."""
    b = b if isinstance(b, Column) else F.lit(b)
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + (a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))


def hash_pair(a: Column, b: Column) -> Column:
    """A 32-bit hash of two whole numbers, the same on every platform."""
    xor_shift = lambda h, n: h.bitwiseXOR(F.shiftright(h, n))
    a, b = (x.cast("long").bitwiseAND(F.lit(MASK)) for x in (a, b))
    h = multiply32(a, 0x9E3779B1).bitwiseXOR(multiply32(b, 0x85EBCA77))
    h = multiply32(xor_shift(h, 15), 0x2C1B3C6D)
    h = multiply32(xor_shift(h, 12), 0x297A2D39)
    return xor_shift(h, 15)


def palette_colour(colours: list[tuple[int, int, int]], t: Column) -> Column:
    """array<double> r, g, b at t in [0, 1], linear between evenly spaced stops."""
    stops = F.array(*(F.array(*(F.lit(float(c)) for c in rgb)) for rgb in colours))
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (len(colours) - 1)
    i = F.least(F.lit(len(colours) - 2), F.floor(x)).cast("int")
    return F.zip_with(F.get(stops, i), F.get(stops, i + 1), lambda a, b: a + (b - a) * (x - i))


def query_url(base: str, parts: dict[str, Column]) -> Column:
    """An address with its parameters in the order given, each value percent-encoded; a null value has no parameter."""
    pairs = [F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string"))) for name, value in parts.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


def box_text(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The four sides of a box as services take them."""
    return F.concat_ws(",", *(c.cast("string") for c in (west, south, east, north)))
