"""The network: canonical tables, what is derived from them, and lookups. Everything is declared; nothing runs until asked for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions import scalars as S

WALK_M = 500.0


def near_cells(metres: float, lat: Column) -> tuple[Column, Column]:
    """Cells to reach to either side, (x, y), for a network distance; a degree of longitude shrinks with latitude."""
    straight = metres / S.DETOUR
    y = F.lit(int(-(-straight // S.CELL_M)) + 1)
    return F.ceil(straight / (S.CELL_M * F.greatest(F.cos(F.radians(F.abs(lat) + 1)), F.lit(0.05)))).cast("int") + 1, y


def spread(points: DataFrame, metres: float) -> DataFrame:
    """Each point (lat, lon) with every cell (cell_x, cell_y) that may hold something within metres of network distance."""
    x, y = S.cell(F.col("lat"), F.col("lon"))
    rx, ry = near_cells(metres, F.col("lat"))
    return points.withColumn("cell_x", F.explode(F.sequence(x - rx, x + rx))).withColumn("cell_y", F.explode(F.sequence(y - ry, y + ry)))


@dataclass(frozen=True)
class Network:
    stops: DataFrame  # stop_idx, stop_id, stop_name, lat, lon, parent_idx
    areas: DataFrame  # area_idx, area_id, area_name
    stop_areas: DataFrame  # area_idx, stop_idx
    routes: DataFrame  # route_idx, route_id, long_name, short_name, route_type
    trips: DataFrame  # trip_idx, trip_id, route_idx, shape_idx, head_sign
    stop_times: DataFrame  # trip_idx, route_idx, pos, stop_idx, arr, dep, dist_m
    transfers: DataFrame  # from_stop_idx, to_stop_idx, min_transfer_s, from_trip_idx, to_trip_idx
    shapes: DataFrame  # shape_idx, seq, lat, lon, dist_m

    # projections
    @property
    def project_stops(self) -> DataFrame:
        return self.stops.select("stop_id", "stop_name", F.lower("stop_name").alias("normalized_name"), "lat", "lon")

    @property
    def project_areas(self) -> DataFrame:
        return self.areas.select("area_id", "area_name", F.lower("area_name").alias("normalized_name"))

    @property
    def stops_with_trips(self) -> DataFrame:
        return self.stops.join(self.stop_times.select("stop_idx"), "stop_idx", "left_semi")

    # load-time joins
    @property
    def stop_parent(self) -> DataFrame:
        p = self.stops.select(F.col("stop_idx").alias("parent_idx"), F.col("stop_id").alias("parent_id"))
        return self.stops.join(p, "parent_idx", "left").select("stop_id", "parent_id")

    @property
    def area_members(self) -> DataFrame:
        return self.stop_areas.join(self.areas, "area_idx").join(self.stops, "stop_idx").select("area_id", "stop_id")

    @property
    def trip_route(self) -> DataFrame:
        return self.trips.join(self.routes, "route_idx").select("trip_id", "route_id", "long_name")

    @property
    def trip_shape(self) -> DataFrame:
        return self.trips.join(self.shapes.select("shape_idx").distinct().withColumn("found", F.col("shape_idx")), "shape_idx",
            "left").select("trip_id", F.col("found").alias("shape_idx"))

    @property
    def transfer_times(self) -> DataFrame:
        """Transfers with the ids of their stops and how long they take."""
        out = self.transfers
        for x in ("from", "to"):
            out = out.join(self.stops.select(F.col("stop_idx").alias(f"{x}_stop_idx"), F.col("stop_id").alias(f"{x}_id"),
                F.col("lat").alias(f"{x}_lat"), F.col("lon").alias(f"{x}_lon")), f"{x}_stop_idx")
        metres = S.network_distance(*(F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")))
        duration = F.coalesce("min_transfer_s", S.walk_seconds(metres)).cast("long").alias("duration_s")
        return out.select("from_stop_idx", "to_stop_idx", "from_id", "to_id", "from_trip_idx", "to_trip_idx", duration)

    @property
    def transfers_resolved(self) -> DataFrame:
        """Transfers with the ids of their stops, of the trips they are for, if any, and how long they take."""
        out = self.transfer_times
        for x in ("from", "to"):
            out = out.join(self.trips.select(F.col("trip_idx").alias(f"{x}_trip_idx"), F.col("trip_id").alias(f"{x}_trip_id")), f"{x}_trip_idx", "left")
        return out.select("from_stop_idx", "to_stop_idx", "from_id", "to_id", "from_trip_id", "to_trip_id", "duration_s")

    @property
    def stop_times_resolved(self) -> DataFrame:
        return self.stop_times.join(self.trips.select("trip_idx", "trip_id"), "trip_idx").join(self.stops.select("stop_idx", "stop_id"),
            "stop_idx").select("trip_id", "stop_id", "pos", "arr", "dep")

    # groupings
    def _list(self, df: DataFrame, key: str, value: str, distinct: bool = False) -> DataFrame:
        return df.groupBy(key).agg(F.sort_array((F.collect_set if distinct else F.collect_list)(value)).alias(f"{value}s"))

    @property
    def station_stops(self) -> DataFrame:
        return self._list(self.stops.where("parent_idx is not null"), "parent_idx", "stop_idx")

    @property
    def area_stops(self) -> DataFrame:
        return self._list(self.stop_areas, "area_idx", "stop_idx")

    @property
    def stop_area(self) -> DataFrame:
        return self.stops.join(self.stop_areas.groupBy("stop_idx").agg(F.max("area_idx").alias("area_idx")), "stop_idx", "left").select("stop_idx", "area_idx")

    @property
    def route_trips(self) -> DataFrame:
        return self._list(self.trips, "route_idx", "trip_idx")

    @property
    def stop_transfers(self) -> DataFrame:
        return self._list(self.transfers.withColumnRenamed("from_stop_idx", "stop_idx"), "stop_idx", "to_stop_idx")

    @property
    def stop_trips(self) -> DataFrame:
        return self._list(self.stop_times, "stop_idx", "trip_idx")

    @property
    def stop_time_positions(self) -> DataFrame:
        w = Window.partitionBy("trip_idx").orderBy("pos")
        return self.stop_times.select("trip_idx", "stop_idx", (F.row_number().over(w) - 1).cast("long").alias("inner_idx"))

    @property
    def shape_points(self) -> DataFrame:
        w = Window.partitionBy("shape_idx").orderBy("seq")
        return self.shapes.select("shape_idx", "lat", "lon", "dist_m", (F.row_number().over(w) - 1).cast("long").alias("inner_idx"))

    @property
    def celled(self) -> DataFrame:
        x, y = S.cell(F.col("lat"), F.col("lon"))
        return self.stops.withColumn("cell_x", x).withColumn("cell_y", y)

    @property
    def geo_grid(self) -> DataFrame:
        return self.celled.groupBy("cell_x", "cell_y").agg(F.sort_array(F.collect_list("stop_idx")).alias("stop_idxs"))

    # trip patterns
    def patterned_trips(self, parts: int | None = None) -> DataFrame:
        """trip_idx, route_idx, calls (pos, stop_idx, arr, dep) in order, rroute (a pattern is a route and its sequence of stops), dep0 (its first departure).

        parts: tasks that gather the calls, if known; they move once, as they are, so none are sorted before.
        """
        rows = self.stop_times.select("trip_idx", "route_idx", "pos", "stop_idx", "arr", "dep")
        rows = rows.repartition(parts, "trip_idx") if parts else rows
        calls = rows.groupBy("trip_idx", "route_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_idx", "arr", "dep"))).alias("calls"))
        key = F.concat_ws(",", F.col("route_idx").cast("string"), F.transform("calls.stop_idx", lambda s: s.cast("string")))
        rroute = F.concat(F.col("route_idx").cast("string"), F.lit("-"), F.substring(F.md5(key), 1, 12))
        return calls.withColumn("rroute", rroute).withColumn("dep0", F.col("calls")[0]["dep"])

    @cached_property
    def timed_trips(self) -> DataFrame:
        """trip_idx, route_idx, calls and rroute as above, trip_rank by first departure, then trip_idx."""
        rank = F.row_number().over(Window.partitionBy("rroute").orderBy("dep0", "trip_idx"))
        return self.patterned_trips().withColumn("trip_rank", rank.cast("long")).drop("dep0")

    @cached_property
    def ranked_trips(self) -> DataFrame:
        """trip_idx, route_idx, stops in order, rroute, trip_rank, shape_idx."""
        rows = self.timed_trips.select("trip_idx", "route_idx", F.col("calls.stop_idx").alias("stops"), "rroute", "trip_rank")
        return rows.join(self.trips.select("trip_idx", "shape_idx"), "trip_idx")

    @property
    def raptor_routes(self) -> DataFrame:
        return self.timed_trips.withColumn("stops", F.col("calls.stop_idx")).groupBy("route_idx", "stops").agg(F.count("*").alias("n_trips"),
            F.min_by("trip_idx", "trip_rank").alias("first_trip"))

    @property
    def pattern_stops(self) -> DataFrame:
        """rroute, route_idx, pos, stop_idx: a row for each place of each pattern."""
        one = self.timed_trips.where("trip_rank = 1").select("rroute", "route_idx", F.posexplode("calls.stop_idx").alias("pos", "stop_idx"))
        return one.withColumn("pos", F.col("pos").cast("long"))

    @property
    def stop_raptors(self) -> DataFrame:
        return self.pattern_stops.select("stop_idx", "route_idx", "rroute").distinct().groupBy("stop_idx").agg(F.count("*").alias("n_raptors"),
            F.sort_array(F.collect_set("route_idx")).alias("route_idxs"))

    @property
    def route_raptors(self) -> DataFrame:
        return self.pattern_stops.groupBy("route_idx").agg(F.countDistinct("rroute").alias("n_raptors"))

    @property
    def raptor_shape(self) -> DataFrame:
        return self.ranked_trips.groupBy("rroute", "route_idx").agg(F.min_by("shape_idx", "trip_rank").alias("shape_idx")).select("route_idx", "shape_idx")

    @property
    def route_timetable(self) -> DataFrame:
        return self.stop_times.groupBy("route_idx", "trip_idx").agg(F.sort_array(F.collect_list("dep")).alias("departures"))

    # places
    @property
    def walk_edges(self) -> DataFrame:
        """Directed edges between stops within a walk: a grid equi-join, then the exact distance."""
        a = spread(self.stops.select(F.col("stop_idx").alias("from_stop_idx"), "lat", "lon"), WALK_M).withColumnsRenamed({"lat": "a_lat", "lon": "a_lon"})
        b = self.celled.select("cell_x", "cell_y", F.col("stop_idx").alias("to_stop_idx"), "lat", "lon")
        metres = S.network_distance(*(F.col(c) for c in ("a_lat", "a_lon", "lat", "lon")))
        found = a.join(b, ["cell_x", "cell_y"]).where("from_stop_idx <> to_stop_idx").withColumn("metres", metres).where(F.col("metres") <= WALK_M)
        return found.select("from_stop_idx", "to_stop_idx", "metres", S.walk_seconds(F.col("metres")).alias("duration_s"))

    def stops_near(self, points: DataFrame, metres: float = WALK_M) -> DataFrame:
        """query_id, stop columns and metres of stops within a network distance of points (query_id, lat, lon)."""
        a = spread(points.select("query_id", "lat", "lon"), metres).withColumnsRenamed({"lat": "q_lat", "lon": "q_lon"})
        d = S.network_distance(*(F.col(c) for c in ("q_lat", "q_lon", "lat", "lon")))
        return a.join(self.celled, ["cell_x", "cell_y"]).withColumn("metres", d).where(F.col("metres") <= metres).drop("cell_x", "cell_y", "q_lat", "q_lon")

    @property
    def area_stops_expanded(self) -> DataFrame:
        """Children of an area's member stops; members without children add nothing."""
        child = self.stops.select(F.col("parent_idx").alias("member"), "stop_idx", "lat", "lon")
        return self.stop_areas.select("area_idx", F.col("stop_idx").alias("member")).join(child, "member").select("area_idx", "stop_idx", "lat", "lon")

    @property
    def area_centroid(self) -> DataFrame:
        return self.areas.join(self.area_stops_expanded.groupBy("area_idx").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "area_idx",
            "left").select("area_idx", "area_id", "area_name", "lat", "lon")

    def areas_near(self, points: DataFrame, metres: float = WALK_M) -> DataFrame:
        """Areas of near stops, a row per stop, with the distance of their centroid."""
        near = self.stops_near(points, metres).select("query_id", "stop_idx").join(self.stop_areas, "stop_idx").join(self.area_centroid, "area_idx")
        p = points.select("query_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
        d = S.network_distance(*(F.col(c) for c in ("q_lat", "q_lon", "lat", "lon")))
        return near.join(p, "query_id").withColumn("metres", d)

    def trip_shapes(self, trip_idx: int) -> DataFrame:
        one = self.trips.where(F.col("trip_idx") == trip_idx).select("shape_idx")
        return self.shapes.join(one, "shape_idx").select("shape_idx", "seq", "lat", "lon", "dist_m")

    def lookup(self, table: str, key: str, value: str) -> DataFrame:
        return getattr(self, table).where(F.col(key) == value)


    def stops_beside(self, stop_idx: int) -> DataFrame:
        """The stops within a walk of one stop, with their distance."""
        near = self.walk_edges.where(F.col("from_stop_idx") == stop_idx).select(F.col("to_stop_idx").alias("stop_idx"), "metres", "duration_s")
        return near.join(self.stops, "stop_idx")


def fuzzy_search(df: DataFrame, needle: str, name: str, least: float = 0.1) -> DataFrame:
    """df's rows whose name scores above `least` against the needle, with their score."""
    score = S.fuzzy_score(F.lower(F.lit(needle)), F.lower(F.col(name)))
    return df.withColumn("score", score).where(F.col("score") > least)
