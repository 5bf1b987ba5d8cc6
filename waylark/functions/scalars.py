"""Scalar columns: fuzzy text scores, distances on the globe, times of a service day, vehicle modes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DETOUR = 1.3
CELL_M, LON_M, LAT_M = 500.0, 111_320.0, 110_540.0
WALK_M_S = 1.5


# text
def tokens(text: Column) -> Column:
    """Tokens between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def token_score(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer token; equal tokens 1."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_score(needle: Column, text: Column) -> Column:
    """Mean of the scores of tokens at the same place, over the needle's tokens; no needle, 0."""
    a, b = tokens(needle), tokens(text)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), token_score)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1)))


# globe
def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def network_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2) * DETOUR


def cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Grid cell (x, y), truncated towards zero."""
    return (lon * LON_M / CELL_M).cast("int"), (lat * LAT_M / CELL_M).cast("int")


def walk_seconds(metres: Column) -> Column:
    return F.ceil(metres / WALK_M_S).cast("long")


def parse_coordinate(text: Column) -> Column:
    """struct(lat, lon) of the first and last part between commas; null without a comma or with a part that is no number."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    parts = F.split(bare, ",")
    lat, lon = F.element_at(parts, 1).try_cast("double"), F.element_at(parts, -1).try_cast("double")
    return F.when(F.contains(text, F.lit(",")) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def show_coordinate(lat: Column, lon: Column) -> Column:
    return F.concat_ws(", ", lat.cast("string"), lon.cast("string"))


# time
def now() -> Column:
    """Seconds of the service day by the session's clock, the same in a whole query."""
    at = F.current_timestamp()
    return (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("long")


def parse_hms(text: Column) -> Column:
    """Seconds of `H:MM:SS`; more parts are ignored, hours may pass 24; null if a part is no number or missing."""
    parts = F.split(text, ":")
    number = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), r"^\+", "").try_cast("long")
    return F.when(text.rlike(r"^[+]?\d+:[+]?\d+:[+]?\d+(:.*)?$"), number(0) * 3600 + number(1) * 60 + number(2))


def format_hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.expr("0") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def leg_text(kind: Column, long_name: Column, short_name: Column) -> Column:
    """A leg in words; what stands for a missing name is spelt as it must be (a fixed value)."""
    name = lambda c: F.coalesce(c, F.lit("UNKOWN"))
    ride = F.concat(F.lit("Travel with "), name(long_name), F.lit("("), name(short_name), F.lit(")"))
    return F.when(kind == "transit", ride).when(kind == "walk", "Walk").otherwise("Transfer")


def mode(route_type: Column) -> Column:
    """Vehicle mode of basic and extended route types."""
    ranges = (("Tram", 0, 900, 999), ("Subway", 1, 400, 405), ("Rail", 2, 100, 199), ("Bus", 3, 700, 799), ("Ferry", 4, 1000, 1099))
    out = F.lit("Unknown")
    for name, basic, low, high in ranges:
        out = F.when((route_type == basic) | route_type.between(low, high), name).otherwise(out)
    return out
