"""What a user asks in strings: search by name, stops and areas around a coordinate, and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.network import Network, fuzzy_search
from waylark.plans.planner import Prepared, parse_location, plan, prepare

#: Names found, and metres around a coordinate, unless told otherwise.
COUNT, DISTANCE = 5, 500.0


def search_stops(net: Network, needle: str, count: int = COUNT) -> DataFrame:
    """The count stops with trips whose names are most like the needle: stop columns and score, best first, ties by id."""
    return fuzzy_search(net.stops_with_trips, needle, "stop_name").orderBy(F.desc("score"), "stop_id").limit(count)


def search_areas(net: Network, needle: str, count: int = COUNT) -> DataFrame:
    """The count areas whose names are most like the needle: area columns and score, best first, ties by id."""
    return fuzzy_search(net.areas, needle, "area_name").orderBy(F.desc("score"), "area_id").limit(count)


def _point(net: Network, place: str) -> DataFrame:
    spark = net.stops.sparkSession
    at = S.parse_coordinate(F.col("text"))
    points = spark.createDataFrame([(0, place)], "query_id long, text string").select("query_id", at["lat"].alias("lat"), at["lon"].alias("lon"))
    if points.first()["lat"] is None:
        raise ValueError(f"no coordinate: {place!r}")
    return points


def near_stops(net: Network, place: str, distance: float = DISTANCE) -> DataFrame:
    """Stops within distance metres of network of a coordinate ("lat, lon"), with trips or not: stop columns and metres, nearest first."""
    return net.stops_near(_point(net, place), distance).drop("query_id").orderBy("metres", "stop_id")


def near_areas(net: Network, place: str, distance: float = DISTANCE) -> DataFrame:
    """Areas of the stops within distance metres, a row per stop, by the distance of the areas' centres."""
    return net.areas_near(_point(net, place), distance).drop("query_id").orderBy("metres", "area_id")


def _times(asked: DataFrame) -> tuple[Column, Column, Column]:
    """Mode, seconds, and is the time that counts a bad one: arrive_at counts before departure_at, and that before now."""
    told = F.coalesce("arrive_at", "departure_at")
    seconds = F.when(told.isNull(), S.now()).otherwise(S.parse_hms(told))
    return F.when(F.col("arrive_at").isNotNull(), "arrival").otherwise("departure"), seconds, told.isNotNull() & S.parse_hms(told).isNull()


def route(net: Network | Prepared, requests: DataFrame) -> DataFrame:
    """query_id, status, and the itinerary (see Plan.itineraries) of requests (query_id, from, to, departure_at, arrive_at, allow_walk, shapes).

    All but query_id, allow_walk and shapes are strings; only from and to are needed. A location with a comma is a coordinate, another
    is an area's id or else a stop's. allow_walk is true unless told otherwise, shapes are told only if asked for. Status: ok,
    no_route, missing_location, unknown_location, bad_time. Nothing is raised for a bad request.
    """
    net = net if isinstance(net, Prepared) else prepare(net)
    for name, kind in (("departure_at", "string"), ("arrive_at", "string"), ("allow_walk", "boolean"), ("shapes", "boolean")):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    mode, time_s, bad_time = _times(requests)
    asked = requests.select("query_id", "from", "to", F.coalesce("allow_walk", F.lit(True)).alias("allow_walk"),
        F.coalesce("shapes", F.lit(False)).alias("shapes"), mode.alias("mode"), time_s.alias("time_s"), bad_time.alias("bad_time"))
    for end in ("from", "to"):
        kind = parse_location(net.net, asked.where(F.col(end).isNotNull()).select("query_id", F.col(end).alias("text")))
        ok = (F.col("kind") != "coordinate") | S.parse_coordinate(F.col("text")).isNotNull()
        asked = asked.join(kind.where(ok).select("query_id", F.col("kind").alias(f"{end}_kind")), "query_id", "left")
    missing = F.col("from").isNull() | F.col("to").isNull()
    flaw = F.when(missing, "missing_location").when(F.col("from_kind").isNull() | F.col("to_kind").isNull(), "unknown_location").when(F.col("bad_time"), "bad_time")
    asked = asked.withColumn("flaw", flaw)
    questions = asked.where("flaw is null").select("query_id", "from_kind", F.col("from").alias("from_id"), "to_kind", F.col("to").alias("to_id"),
        "mode", "time_s", "allow_walk", "shapes")
    found = None
    for walk in (True, False):
        own = questions.where(F.col("allow_walk") == walk)
        if own.isEmpty():
            continue
        of = plan(net, own.drop("allow_walk", "shapes"), allow_walk=walk).itineraries(shapes=True)
        found = of if found is None else found.union(of)
    if found is None:
        return asked.select("query_id", F.col("flaw").alias("status"))
    bare = F.transform("legs", lambda x: x.withField("shapes", F.lit(None).cast(found.schema["legs"].dataType.elementType["shapes"].dataType)))
    out = asked.select("query_id", "flaw", F.col("shapes").alias("with_shapes")).join(found, "query_id", "left")
    out = out.withColumn("legs", F.when(F.col("with_shapes"), F.col("legs")).otherwise(bare))
    status = F.coalesce("flaw", F.when(F.col("n_legs").isNotNull(), "ok"), F.lit("no_route"))
    return out.select("query_id", status.alias("status"), "from", "to", "departure_s", "arrival_s", "n_legs", "legs")
