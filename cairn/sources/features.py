"""Typed rows from map, catalogue, protection and place data: DataFrames of parsed records in, DataFrames of features out. Unusable records are dropped or defaulted, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import in_force, known_text, parse_elevation, zoom_for_span
from ..operators.staging import written

POINT = "struct<lat: double, lon: double>"
OSM_SCHEMA = f"type string, id bigint, lat double, lon double, tags map<string,string>, geometry array<{POINT}>, members array<struct<role: string, geometry: array<{POINT}>>>"
#: Tag values of paths and of water lines; IUCN categories.
PATHS = ("path", "footway", "track", "bridleway", "steps")
WATERWAYS = ("river", "stream", "canal")
IUCN = {"Ia": "Strict nature reserve", "Ib": "Wilderness area", "II": "National park", "III": "Natural monument", "IV": "Habitat protection area", "V": "Protected landscape", "VI": "Protected area with sustainable use"}


def drinking_kind(tags: Column) -> Column:
    """The kind of a drinking water source, or null."""
    has = lambda k, v: tags[k] == v
    kind = F.when(has("amenity", "drinking_water"), "drinking_water").when(has("amenity", "water_point"), "water_point").when(has("man_made", "water_tap"), "tap").when(has("natural", "spring"), "spring")
    kind = kind.when(has("amenity", "fountain") & has("drinking_water", "yes"), "fountain")
    closed = F.coalesce(has("drinking_water", "no"), F.lit(False)) | F.coalesce(has("access", "private"), F.lit(False))
    return F.when(~closed, kind)


def feature_class(kind: Column, tags: Column) -> Column:
    """drinking, trail, water or relation_water, in this order of priority; null for anything else. kind: node, way or relation."""
    way, lake = kind == "way", tags["natural"] == "water"
    return (
        F.when(drinking_kind(tags).isNotNull(), "drinking")
        .when(way & tags["highway"].isin(*PATHS), "trail")
        .when(way & (F.coalesce(lake, F.lit(False)) | F.coalesce(tags["waterway"].isin(*WATERWAYS), F.lit(False))), "water")
        .when((kind == "relation") & lake, "relation_water")
    )


def is_closed(line: Column) -> Column:
    return (F.size(line) >= 4) & (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1))


def drinking_points(elements: DataFrame) -> DataFrame:
    """(id, kind, name, lat, lon): the mean of all points of each drinking water source."""
    members = F.flatten(F.transform(F.coalesce("members", F.array()), lambda m: F.coalesce(m["geometry"], F.array().cast(f"array<{POINT}>"))))
    own = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(F.struct("lat", "lon")))
    points = F.when(F.col("type") == "node", own).otherwise(F.coalesce("geometry", members))
    rows = elements.select("id", drinking_kind(F.col("tags")).alias("kind"), F.col("tags")["name"].alias("name"), points.alias("p")).filter("kind IS NOT NULL AND size(p) > 0")
    mean = lambda c: F.aggregate("p", F.lit(0.0), lambda s, x: s + x[c]) / F.size("p")
    return rows.select("id", "kind", "name", mean("lat").alias("lat"), mean("lon").alias("lon"))


def lines(elements: DataFrame) -> DataFrame:
    """(id, class, part, geometry): trails and water lines; each member line of a water relation is one. closed tells lakes of one line."""
    e = elements.withColumn("class", feature_class(F.col("type"), F.coalesce("tags", F.create_map().cast("map<string,string>"))))
    ways = e.filter("class IN ('trail', 'water') AND geometry IS NOT NULL").select("id", "class", F.lit(0).alias("part"), "geometry", F.coalesce((F.col("tags")["natural"] == "water") & is_closed(F.col("geometry")), F.lit(False)).alias("closed"))
    parts = e.filter("class = 'relation_water'").select("id", F.lit("water").alias("class"), F.posexplode("members").alias("part", "m")).filter("m.geometry IS NOT NULL")
    return ways.unionByName(parts.select("id", "class", "part", F.col("m.geometry").alias("geometry"), F.lit(False).alias("closed")))


def named_peaks(elements: DataFrame) -> DataFrame:
    """(id, lat, lon, name, ele) of nodes with a place and a name."""
    name = F.trim(F.col("tags")["name"])
    return elements.filter("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", name.alias("name"), parse_elevation(F.col("tags")["ele"]).alias("ele")).filter("name <> ''")


GEOJSON = "results ARRAY<STRUCT<layerBodId: STRING, id: BIGINT, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, properties: MAP<STRING, STRING>>>"
ESRI = "features ARRAY<STRUCT<attributes: MAP<STRING, STRING>, geometry: STRUCT<rings: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>, error STRUCT<message: STRING>"


def answers(spark, folders: dict[str, str], schema: str) -> DataFrame:
    """JSON answers of several services or layers (name to folder, a file each) as one table with the name in `layer`; a file that is no such answer has nulls, and its layer is there all the same."""
    out = None
    for layer, folder in folders.items():
        raw = spark.read.option("wholetext", "true").text(folder).select(F.lit(layer).alias("layer"), F.from_json("value", schema).alias("a")).select("layer", "a.*")
        out = raw if out is None else out.unionByName(raw)
    return out


def protected_areas(results: DataFrame, layers: DataFrame, month: Column, day: Column) -> DataFrame:
    """results(id, layer, has_geometry, properties map) joined with layers(layer, kind, restricts), which are few: id, layer, kind, name, rule, period, in_force, restricts. Unknown layers and lines fall out."""
    p = F.col("properties")
    text = lambda k: known_text(p[k])
    met = results.filter("has_geometry").join(layers, "layer")
    park = F.coalesce(text("kategorie") == "SNP", F.lit(False))
    name = F.coalesce(*(text(k) for k in ("label", "gebietsname", "name", "wrz_name", "objname")), F.lit("Unnamed area"))
    return met.select("id", "layer", F.when(park, "Swiss National Park").otherwise(F.col("kind")).alias("kind"), name.alias("name"), F.coalesce(text("best_de"), text("typ_de")).alias("rule"), text("schutzzeit").alias("period"), in_force(text("schutzzeit"), month, day).alias("in_force"), (F.col("restricts") | park).alias("restricts"))


def designated_areas(attributes: Column) -> dict[str, Column]:
    """kind, name, rule, restricts of a nationally designated area."""
    text = lambda k: known_text(attributes[k])
    iucn, strict = text("iucnCategory"), F.coalesce(text("strictProtection") == "yes", F.lit(False))
    named = F.create_map(*(F.lit(x) for kv in IUCN.items() for x in kv))[iucn]
    kind = F.when(named.isNotNull(), F.concat(named, F.lit(" (IUCN "), iucn, F.lit(")"))).otherwise("Protected area")
    return {"kind": kind, "name": F.coalesce(text("siteName"), F.lit("Unnamed area")), "rule": F.when(strict, "Strictly protected (EEA)"), "restricts": strict | F.coalesce(iucn.isin("Ia", "Ib"), F.lit(False))}


def rings_to_grid(coordinates: Column) -> Column:
    """GeoJSON rings (arrays of [lon, lat]) to arrays of struct<e, n> on LV95."""

    def point(p: Column) -> Column:
        e, n = geo.to_lv95(F.get(p, F.lit(1)), F.get(p, F.lit(0)))
        return F.struct(e.alias("e"), n.alias("n"))

    return F.transform(coordinates, lambda ring: F.transform(ring, point))


def places(rows: DataFrame) -> DataFrame:
    """Geocoder rows (place_id, lat, lon texts, name, display_name, category, type, boundingbox array) to id, name, lat, lon, is_peak, zoom."""
    peak = F.coalesce((F.col("category") == "natural") & F.col("type").isin("peak", "volcano"), F.lit(False))
    box = lambda i: F.get("boundingbox", F.lit(i)).try_cast("double")
    span = F.when(F.size("boundingbox") == 4, F.abs(box(3) - box(2)))
    name = F.coalesce(F.nullif("name", F.lit("")), F.trim(F.split("display_name", ",")[0]))
    return rows.select(F.col("place_id").alias("id"), name.alias("name"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), peak.alias("is_peak"), F.when(peak, 14).otherwise(zoom_for_span(F.coalesce(span, F.lit(0.0)))).alias("zoom"))


def suggestion(label: Column) -> dict[str, Column]:
    """name (bold, before a bar), kind (italic) and is_peak of a suggestion label with markup."""
    bare = lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))
    kind = F.regexp_extract(label, "(?s)<i>(.*?)</i>", 1)
    bold = F.when(label.rlike("(?s)<b>.*?</b>"), F.regexp_extract(label, "(?s)<b>(.*?)</b>", 1)).otherwise(label)
    return {"name": F.trim(F.regexp_replace(F.split(bare(bold), r"\|")[0], r"\s+", " ")), "kind": bare(kind), "is_peak": kind.rlike("(?i)peak|gipfel|cime|pizzo")}


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("_o", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_o = 1").drop("_o")


def catalogue_pages(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The pages of a catalogue under a path, a JSON answer each (features, links), as items (seq, id, assets) in the order of pages by their file names, and the paths of pages that are no answer,
    which are to be read again: nothing of them counts."""
    item = "STRUCT<id: STRING, assets: MAP<STRING, STRUCT<href: STRING, type: STRING, `eo:gsd`: DOUBLE>>>"
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"features ARRAY<{item}>, links ARRAY<STRUCT<rel: STRING, href: STRING>>").alias("page"))
    good = raw.filter("page.features IS NOT NULL").select("path", F.posexplode("page.features").alias("k", "f"))
    asset = lambda _, a: F.struct(a["href"].alias("href"), a["type"].alias("type"), a["eo:gsd"].alias("gsd"))
    items = good.select(F.struct("path", "k").alias("seq"), "f.id", F.transform_values("f.assets", asset).alias("assets"))
    return items, raw.filter("page.features IS NULL").select("path")


def catalogue_chain(spark, path: str, first: str) -> tuple[DataFrame, DataFrame]:
    """As catalogue_pages, of the answers that a first page leads to by its links of rel "next", in that order; a page's name is its file's, a link's the last part of its address. What lies under the path besides does not count.
    Also gives the names of pages of the chain that are no answer or are not there. A chain that leads back ends there.

    Pages reached are doubled from round to round: with every page's successor 2^k steps on, those at 0 to 2^k - 1 give those at 2^k to 2^(k+1) - 1.
    """
    items, _ = catalogue_pages(spark, path)
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    raw = spark.read.option("wholetext", "true").text(path).select(last(F.col("_metadata.file_path")).alias("name"), F.from_json("value", "features ARRAY<STRING>, links ARRAY<STRUCT<rel: STRING, href: STRING>>").alias("page"))
    following = F.get(F.filter("page.links", lambda x: x["rel"] == "next"), F.lit(0))["href"]
    pages = written(raw.select("name", F.col("page.features").isNotNull().alias("good"), last(following).alias("next")), "pages")
    jump = pages.filter("next IS NOT NULL").select("name", "next")
    reached, step, count = spark.createDataFrame([(first, 0)], "name string, position long"), 1, 1
    while True:
        ahead = reached.join(jump, "name").select(F.col("next").alias("name"), (F.col("position") + step).alias("position"))
        reached = written(reached.unionByName(ahead).groupBy("name").agg(F.min("position").alias("position")), "reached")
        now = reached.count()
        if now == count:
            break
        count, step = now, 2 * step
        jump = written(jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.name")).select("a.name", "b.next"), "jumps")
    chain = reached.join(pages, "name", "left")
    found = items.withColumn("name", last(F.col("seq.path"))).join(reached, "name").select(F.struct("position", F.col("seq.k").alias("k")).alias("seq"), "id", "assets")
    return found, chain.filter(~F.coalesce("good", F.lit(False))).select("name")


def latest_assets(items: DataFrame, gsd: float) -> DataFrame:
    """Catalogue items (seq, id, assets map of name to struct<href, type, gsd>) to the newest asset of each tile: tile, year, href; the first item on a tie."""
    found = F.get(F.filter(F.map_values("assets"), lambda a: a["type"].contains("geotiff") & (a["gsd"] == gsd)), F.lit(0))
    part = lambda k: F.regexp_extract("id", r"_([0-9]{4})_([0-9]{4}-[0-9]{4})$", k)
    rows = items.select("seq", part(1).try_cast("int").alias("year"), part(2).alias("tile"), found["href"].alias("href")).filter("year IS NOT NULL AND href IS NOT NULL")
    return latest_by(rows, ["tile"], [F.col("year").desc(), F.col("seq")]).select("tile", "year", "href")


def tiles_in_box(x0: Column, y0: Column, x1: Column, y1: Column, zoom: int, size: int = 256) -> Column:
    """array<struct<x, y>> of the tiles that a pixel box touches: x wraps, y is cut at the poles."""
    n = 2**zoom
    xs = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    top, bottom = F.greatest(F.lit(0), F.floor(y0 / size)), F.least(F.lit(n - 1), F.floor(y1 / size))
    ys = F.when(top <= bottom, F.sequence(top, bottom)).otherwise(F.array().cast("array<bigint>"))  # a sequence would run backwards for a box beyond a pole
    return F.array_distinct(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(F.pmod(x, F.lit(n)).alias("x"), y.alias("y"))))))


def rules_for(places_: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that apply to places (place, country, region, commune), the most specific first: adds level, entry and position. rules(entry, country, level, region, commune)."""
    r = rules.select("entry", F.col("country").alias("_c"), "level", F.col("region").alias("_r"), F.col("commune").alias("_m"))
    same = (F.col("country") == F.col("_c")) & ((F.col("level") == "country") | ((F.col("level") == "region") & (F.col("_r") == F.col("region"))) | ((F.col("level") == "commune") & (F.col("_r") == F.col("region")) & (F.col("_m") == F.col("commune"))))
    order = F.when(F.col("level") == "commune", 0).when(F.col("level") == "region", 1).otherwise(2)
    met = places_.join(r, same)
    return met.withColumn("position", F.row_number().over(Window.partitionBy("place").orderBy(order, "entry"))).select("place", "position", "level", "entry")


def fresh(cache: DataFrame, now: Column, most: float) -> DataFrame:
    """Cache rows (key, saved_at seconds, ...) younger than `most` seconds, the last saved of each key."""
    return latest_by(cache.filter(now - F.col("saved_at") < most), ["key"], [F.col("saved_at").desc()])
