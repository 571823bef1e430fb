"""Seed rows of camping rules by country, region and commune. A dimension of fixed size; stances: ban, permit, conditional, local (lower levels decide)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cantons, Austrian Laender (ISO 3166-2), and the stances that differ from "local".
CANTONS = {"AG": "Aargau", "AI": "Appenzell Innerrhoden", "AR": "Appenzell Ausserrhoden", "BE": "Bern", "BL": "Basel-Landschaft", "BS": "Basel-Stadt", "FR": "Fribourg", "GE": "Geneva", "GL": "Glarus", "GR": "Graubünden", "JU": "Jura", "LU": "Lucerne", "NE": "Neuchâtel", "NW": "Nidwalden", "OW": "Obwalden", "SG": "St. Gallen", "SH": "Schaffhausen", "SO": "Solothurn", "SZ": "Schwyz", "TG": "Thurgau", "TI": "Ticino", "UR": "Uri", "VD": "Vaud", "VS": "Valais", "ZG": "Zug", "ZH": "Zurich"}
LAENDER = {"AT-1": "Burgenland", "AT-2": "Kärnten", "AT-3": "Niederösterreich", "AT-4": "Oberösterreich", "AT-5": "Salzburg", "AT-6": "Steiermark", "AT-7": "Tirol", "AT-8": "Vorarlberg", "AT-9": "Wien"}
STANCE = {"BS": "permit", "OW": "conditional", "TI": "ban", "AT-1": "conditional", "AT-2": "ban", "AT-3": "ban", "AT-4": "conditional", "AT-7": "ban", "AT-9": "ban"}
BIVOUAC = {"TI": "conditional", "AT-7": "conditional", "Grindelwald": "ban"}
COMMUNES = {"Lauterbrunnen": ("BE", "ban"), "Grindelwald": ("BE", "ban"), "Kandersteg": ("BE", "ban"), "Silvaplana": ("GR", "ban"), "Zermatt": ("VS", "ban"), "Bad Ragaz": ("SG", "conditional")}
COUNTRIES = {"CH": ("Switzerland", CANTONS, "EPSG:2056"), "AT": ("Austria", LAENDER, "EPSG:3035")}
SCHEMA = "entry int, country string, level string, region string, commune string, name string, stance string, bivouac string"


def rule_rows(spark: SparkSession) -> DataFrame:
    rows: list[tuple] = []
    for code, (name, regions, _) in COUNTRIES.items():
        rows.append((code, "country", None, None, name, "local", None))
        rows += [(code, "region", r, None, n, STANCE.get(r, "local"), BIVOUAC.get(r)) for r, n in regions.items()]
    rows += [("CH", "commune", r, c, c, s, BIVOUAC.get(c)) for c, (r, s) in COMMUNES.items()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
