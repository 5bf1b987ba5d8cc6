"""Journeys for batches of questions: round-based earliest arrival or latest departure, as one DataFrame computation per round.

A question has query_id, from_kind, from_id, to_kind, to_id (kinds: stop, area, coordinate), mode (departure or arrival) and time_s.
Times of arrival questions are negated, which turns latest departure into earliest arrival over the reversed timetable, so both modes
run in the same rounds. Round r holds what r + 1 trips reach. Only improved stops go on; a round's labels are written and read again.

A network is prepared once for all batches: trips with their calls, boarding times by pattern, place and half hour, footpaths. Of trips
that may be boarded at one place and second only the first is kept (and the last, for the reversed timetable), so what a round reads has
no more rows than the day has seconds for each place, however many trips there are. A round is then two joins by equal keys, to the half hour in which a trip may be boarded and to the calls of that trip, and a minimum per stop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.network import WALK_M, Network
from waylark.tables import staged

MAX_ROUNDS = 15
BUCKET_S = 1800
#: Rows of what a round boards at that are broadcast at most; more meet the timetable by a shuffle.
BROADCAST_MOST = 500_000
#: Trips whose calls a task gathers, about: few, or as many as leave DIRECT tasks, but at most the second number.
TRIPS_A_TASK = (50_000, 400_000)
#: To so many tasks Spark writes rows as they come; for more it sorts them first, which spills.
DIRECT = 200


# ---------------------------------------------------------------- locations
def resolve(net: Network, locations: DataFrame, with_trips: DataFrame | None = None) -> DataFrame:
    """query_id, stop_idx of locations (query_id, kind, id). with_trips: the stops (stop_idx) that have trips, if known.

    A stop stands for all stops of its station; a station for its children; an area for its expanded stops that have trips, or else
    the stops with trips near its centre; a coordinate for the stops with trips near it.
    """
    if with_trips is None:
        with_trips = net.stop_times.select("stop_idx").distinct()
    stop = locations.where("kind = 'stop'").join(net.stops.select(F.col("stop_id").alias("id"), "stop_idx", "parent_idx"), "id")
    child = net.stops.select(F.col("parent_idx").alias("station"), F.col("stop_idx").alias("child"))
    stop = stop.withColumn("station", F.coalesce("parent_idx", "stop_idx")).join(child, "station", "left").select("query_id",
        F.coalesce("child", "stop_idx").alias("stop_idx"))
    area = locations.where("kind = 'area'").join(net.areas.select(F.col("area_id").alias("id"), "area_idx"), "id").select("query_id", "area_idx")
    inside = area.join(net.area_stops_expanded.select("area_idx", "stop_idx"), "area_idx").join(with_trips, "stop_idx").select("query_id", "stop_idx")
    bare = area.join(inside.select("query_id"), "query_id", "left_anti").join(net.area_centroid,
        "area_idx").where("lat is not null").select("query_id", "lat", "lon")
    at = S.parse_coordinate(F.col("id"))
    points = locations.where("kind = 'coordinate'").select("query_id", at["lat"].alias("lat"), at["lon"].alias("lon")).where("lat is not null")
    near = net.stops_near(points.union(bare), WALK_M).join(with_trips, "stop_idx").select("query_id", "stop_idx")
    return stop.union(inside).union(near).distinct()


def parse_location(net: Network, texts: DataFrame) -> DataFrame:
    """kind and id of texts (query_id, text): a coordinate if it has a comma, else an area id, else a stop id, else null."""
    area, stop = net.areas.select(F.col("area_id").alias("text"), F.lit("area").alias("a")), net.stops.select(F.col("stop_id").alias("text"),
        F.lit("stop").alias("s"))
    kind = F.when(F.contains("text", F.lit(",")), "coordinate").otherwise(F.coalesce("a", "s"))
    return texts.join(area.distinct(), "text", "left").join(stop.distinct(), "text", "left").select("query_id", "text", kind.alias("kind"))


def flaws(net: Network, locations: DataFrame) -> DataFrame:
    """query_id and flaw (invalid_stop, invalid_area, invalid_coordinate) of locations (query_id, kind, id) that are none."""
    stop, area = net.stops.select(F.col("stop_id").alias("id"), F.lit("stop").alias("kind")), net.areas.select(F.col("area_id").alias("id"),
        F.lit("area").alias("kind"))
    known = stop.union(area).distinct().withColumn("known", F.lit(True))
    found = locations.join(known, ["kind", "id"], "left")
    bad = F.when(F.col("kind") == "coordinate", S.parse_coordinate(F.col("id")).isNull()).otherwise(F.col("known").isNull())
    return found.where(F.coalesce(bad, F.lit(True))).select("query_id", F.concat(F.lit("invalid_"), F.coalesce("kind", F.lit("location"))).alias("flaw"))


# ---------------------------------------------------------------- the prepared network
@dataclass(frozen=True)
class Prepared:
    """What questions are answered from, written once. `n_places`: how many places of patterns a stop has at most."""

    net: Network
    places: DataFrame  # mode, stop_idx, rroute, pos, first (bucket)
    boards: DataFrame  # mode, rroute, pos, bucket, trips (board, trip_rank), later (trip_rank)
    trips: DataFrame  # those that may be boarded: rroute, trip_rank, trip_idx, calls (pos, stop_idx, arr, dep)
    transfers: DataFrame  # kind, from_stop_idx, to_stop_idx, duration_s
    walks: DataFrame  # likewise
    served: DataFrame  # stop_idx
    n_places: int

    def footpaths(self, allow_walk: bool = True) -> DataFrame:
        return self.transfers.union(self.walks) if allow_walk else self.transfers


def _bucket(time: Column) -> Column:
    return F.floor(time / BUCKET_S)


def ranks(trips: DataFrame, taken: DataFrame) -> DataFrame:
    """rroute, trip_idx, trip_rank of the taken trips (rroute, trip_idx): their place among all trips (rroute, dep0, trip_idx) of the pattern.

    Trips are numbered within their second of departure, to which the trips of the seconds before are added, so no pattern fills a task.
    """
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("rroute", "dep0").orderBy("trip_idx"))
    own = trips.select("rroute", "dep0", "trip_idx").withColumn("number", number).join(taken, ["rroute", "trip_idx"], "left_semi")
    before = F.sum("count").over(Window.partitionBy("rroute").orderBy("dep0").rowsBetween(Window.unboundedPreceding, -1))
    at = trips.groupBy("rroute", "dep0").count().select(F.col("rroute").alias("of"), F.col("dep0").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))
    on = own.join(at, (F.col("rroute") == F.col("of")) & F.col("dep0").eqNullSafe(F.col("at")))
    return on.select("rroute", "trip_idx", (F.col("before") + F.col("number")).cast("long").alias("trip_rank"))


def prepare(net: Network) -> Prepared:
    from pyspark.sql import Window

    count = net.trips.count()
    few, many = (count // n + 1 for n in TRIPS_A_TASK)
    rows = staged(net.patterned_trips(max(min(few, DIRECT), many)).select("rroute", "dep0", "trip_idx", "calls"), "trips-all")
    # of all trips at a place at the same second only the first in rank is ever boarded, or the last on the way back
    t = rows.select("rroute", "dep0", "trip_idx", F.explode("calls").alias("c")).groupBy("rroute", "c.pos", "c.arr", "dep0")
    t = t.agg(F.min("trip_idx").alias("low"), F.max("trip_idx").alias("high"), F.min("c.stop_idx").alias("stop_idx"))
    least, most = F.min(F.struct("dep0", "low"))["low"], F.max(F.struct("dep0", "high"))["high"]
    ends = staged(t.groupBy("rroute", "pos", "arr").agg(least.alias("low"), most.alias("high"), F.min("stop_idx").alias("stop_idx")), "ends")
    taken = staged(ends.select("rroute", F.explode(F.array("low", "high")).alias("trip_idx")).distinct(), "taken")
    near = F.broadcast if taken.count() <= BROADCAST_MOST else lambda df: df
    ranked = staged(ranks(rows, near(taken)), "ranks")
    trips = staged(rows.select("rroute", "trip_idx", "calls").join(near(ranked), ["rroute", "trip_idx"]).select("rroute", "trip_rank", "trip_idx", "calls"), "trips")
    for end in ("low", "high"):
        ends = ends.join(near(ranked.select("rroute", F.col("trip_idx").alias(end), F.col("trip_rank").alias(f"{end}_rank"))), ["rroute", end])
    one = ends.select(F.lit("departure").alias("mode"), "rroute", F.col("low_rank").alias("trip_rank"), "pos", "stop_idx", F.col("arr").alias("board"))
    both = one.union(ends.select(F.lit("arrival"), "rroute", -F.col("high_rank"), -F.col("pos"), "stop_idx", -F.col("arr")))
    of = both.groupBy("mode", "rroute", "pos", _bucket(F.col("board")).alias("bucket"))
    of = of.agg(F.min("stop_idx").alias("stop_idx"), F.collect_list(F.struct("board", "trip_rank")).alias("trips"), F.min("trip_rank").alias("least"))
    place = Window.partitionBy("mode", "rroute", "pos").orderBy("bucket")
    of = of.withColumn("later", F.min("least").over(place.rowsBetween(1, Window.unboundedFollowing))).withColumn("next",
        F.lead("bucket").over(place)).withColumn("first", F.min("bucket").over(place))
    of = staged(of.withColumn("own", F.row_number().over(place)), "boards")
    # half hours without a trip have the trips after them only
    idle = of.where("next > bucket + 1").select("mode", "rroute", "pos", F.explode(F.expr("sequence(bucket + 1, next - 1)")).alias("bucket"),
        F.expr("cast(array() as array<struct<board: bigint, trip_rank: bigint>>)").alias("trips"), "later")
    boards = of.select("mode", "rroute", "pos", "bucket", "trips", "later").union(idle)
    places = staged(of.where("own = 1").select("mode", "stop_idx", "rroute", "pos", "first"), "places")
    most = places.groupBy("stop_idx").count().agg(F.max("count")).first()[0] or 1
    served = staged(places.select("stop_idx").distinct(), "served")
    kind = lambda name, df: staged(df.select(F.lit(name).alias("kind"), "from_stop_idx", "to_stop_idx", "duration_s"), name)
    return Prepared(net, places, staged(boards, "boards-all"), trips, kind("transfer", net.transfer_times), kind("walk", net.walk_edges), served, most)


# ---------------------------------------------------------------- one round
def next_trip(at: DataFrame, boards: DataFrame) -> DataFrame:
    """at (mode, rroute, pos, first, t and more) with the trip_rank of the first trip that may be boarded at t or later.

    An as-of join by equal keys: the half hour of t, or the place's first one, has its own trips and the first of those after it.
    """
    own = at.withColumn("bucket", F.greatest(_bucket(F.col("t")), "first")).drop("first")
    on = own.join(boards, ["mode", "rroute", "pos", "bucket"])
    left = F.transform(F.filter("trips", lambda x: x["board"] >= F.col("t")), lambda x: x["trip_rank"])
    return on.withColumn("trip_rank", F.least(F.array_min(left), "later")).where("trip_rank is not null").drop("bucket", "trips", "later")


LABEL = ["query_id", "mode", "stop_idx", "t", "kind", "from_stop", "trip_idx", "from_place", "to_place", "dep_s", "arr_s"]


def better(candidates: DataFrame, best: DataFrame, target: DataFrame) -> DataFrame:
    """Candidates that improve on the best label of their stop and on the target's."""
    b, g = best.select("query_id", "stop_idx", F.col("t").alias("best")), target.select("query_id", F.col("t").alias("goal"))
    out = candidates.join(b, ["query_id", "stop_idx"], "left").join(g, "query_id", "left")
    return out.where("(best is null or t < best) and (goal is null or t < goal)").drop("best", "goal")


def relax_transit(frontier: DataFrame, net: Prepared, few: bool = False) -> DataFrame:
    """LABEL and order of what trips boarded at the frontier (query_id, mode, stop_idx, t) reach. few: the frontier is small."""
    near = F.broadcast if few else lambda df: df
    at = near(frontier).join(net.places, ["mode", "stop_idx"]).select("query_id", "mode", "rroute", "pos", "first", "t", F.col("stop_idx").alias("from_stop"))
    on = near(next_trip(near(at), net.boards).drop("t").withColumn("rank", F.abs("trip_rank")))
    trips = net.trips.select("rroute", F.col("trip_rank").alias("rank"), "trip_idx", "calls")
    on = on.join(trips, ["rroute", "rank"])
    forward = F.col("mode") == "departure"
    start = F.element_at(F.filter("calls", lambda c: c["pos"] == F.abs("pos")), 1)
    down = F.filter("calls", lambda c: F.when(forward, c["pos"] > F.col("pos")).otherwise(-c["pos"] > F.col("pos")))
    ride = on.select("*", F.when(forward, start["dep"]).otherwise(start["arr"]).alias("start_s"), F.explode(down).alias("c"))
    ride = ride.withColumn("reach", F.when(forward, F.col("c.arr")).otherwise(-F.col("c.dep")))
    return ride.select(
        "query_id", "mode", F.col("c.stop_idx").alias("stop_idx"), F.col("reach").alias("t"), F.lit("transit").alias("kind"), "from_stop", "trip_idx",
        F.abs("pos").alias("from_place"), F.col("c.pos").alias("to_place"),
        F.when(forward, F.col("start_s")).otherwise(-F.col("reach")).alias("dep_s"), F.when(forward, F.col("reach")).otherwise(F.col("start_s")).alias("arr_s"),
        F.struct("reach", "trip_rank", -F.col("pos"), "rroute").alias("order"),
    )


def relax_footpaths(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """LABEL and order of what transfers and walks (kind, from_stop_idx, to_stop_idx, duration_s) reach from stops."""
    on = reached.select("query_id", "mode", F.col("stop_idx").alias("from_stop"),
        F.col("t").alias("t0")).join(edges.withColumnRenamed("from_stop_idx", "from_stop"), "from_stop")
    on = on.withColumn("t", F.col("t0") + F.col("duration_s"))
    forward, null = F.col("mode") == "departure", F.lit(None).cast("long")
    return on.select(
        "query_id", "mode", F.col("to_stop_idx").alias("stop_idx"), "t", "kind", "from_stop", null.alias("trip_idx"), null.alias("from_place"), null.alias("to_place"),
        F.when(forward, F.col("t0")).otherwise(-F.col("t")).alias("dep_s"), F.when(forward, F.col("t")).otherwise(-F.col("t0")).alias("arr_s"),
        F.struct("t", "kind", "from_stop").alias("order"),
    )


def first_of(candidates: DataFrame) -> DataFrame:
    """Of each query and stop the first candidate in order."""
    return candidates.groupBy("query_id", "stop_idx").agg(F.min_by(F.struct(*LABEL), "order").alias("x")).select("x.*")


def merge(best: DataFrame, labels: DataFrame) -> DataFrame:
    return best.union(labels.select("query_id", "stop_idx", "t")).groupBy("query_id", "stop_idx").agg(F.min("t").alias("t"))


LEG = ["kind", "from_stop", "stop_idx", "trip_idx", "from_place", "to_place", "dep_s", "arr_s"]
#: Legs that a written step of the way back adds.
HOPS = 4


@dataclass(frozen=True)
class Plan:
    queries: DataFrame
    labels: DataFrame  # LABEL and round: of each round what it improved
    targets: DataFrame  # query_id, stop_idx
    net: Network

    @cached_property
    def best(self) -> DataFrame:
        """query_id, stop_idx, t, round of the best target: of ties the fewest trips, then the smallest stop."""
        at = self.labels.join(self.targets, ["query_id", "stop_idx"])
        return at.groupBy("query_id").agg(F.min(F.struct("t", "round", "stop_idx")).alias("x")).select("query_id", "x.*")

    @cached_property
    def legs(self) -> DataFrame:
        """query_id, leg_no, kind, from_stop, to_stop, trip_idx, from_place, to_place, dep_s, arr_s, in order of travel."""
        of = F.struct(*LEG)
        labels = self.labels.select("query_id", F.col("stop_idx").alias("at"), "round", "from_stop", of.alias("leg"))
        none = F.array().cast(f"array<{labels.schema['leg'].dataType.simpleString()}>")
        way = self.best.select("query_id", F.col("stop_idx").alias("at"), "round", none.alias("path"))
        while True:
            for _ in range(HOPS):  # a leg back each: a trip is of a round, a footpath of its trip's
                way = way.join(labels, ["query_id", "at", "round"], "left")
                on = F.col("leg").isNotNull()
                back = F.when(on, F.col("round") - (F.col("leg.kind") == "transit").cast("int")).otherwise(-1)
                way = way.select("query_id", F.coalesce("from_stop", "at").alias("at"), back.alias("round"),
                    F.when(on, F.concat("path", F.array("leg"))).otherwise(F.col("path")).alias("path"))
            way = staged(way, "way-back")
            if way.where("round >= 0").isEmpty():
                break
        mode = self.queries.select("query_id", (F.col("mode") == "departure").alias("forward"))
        rows = way.join(mode, "query_id").select("query_id", "forward", F.posexplode(F.when(F.col("forward"),
            F.reverse("path")).otherwise(F.col("path"))).alias("leg_no", "x"))
        rows = rows.select("query_id", "leg_no", "forward", "x.*")
        swap = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
        return rows.select(
            "query_id", "leg_no", "kind", swap("from_stop", "stop_idx").alias("from_stop"), swap("stop_idx", "from_stop").alias("to_stop"), "trip_idx",
            swap("from_place", "to_place").alias("from_place"), swap("to_place", "from_place").alias("to_place"), "dep_s", "arr_s",
        )

    def named_legs(self) -> DataFrame:
        """The legs with the ids and names of their ends, their mode, and their trip's head sign and route names; footpaths have none of these."""
        net = self.net
        used = self.legs.where("kind = 'transit'").select("trip_idx")  # a left join can't spare its right side the shuffle
        of = net.trips.select("trip_idx", "route_idx", "head_sign").join(used, "trip_idx", "left_semi").join(net.routes, "route_idx")
        of = of.select("trip_idx", "head_sign", "long_name", "short_name", S.mode(F.col("route_type")).alias("of"))
        mode = F.when(F.col("kind") == "transit", F.col("of")).when(F.col("kind") == "walk", "Walk").otherwise("Transfer")
        ends = [net.stops.select(F.col("stop_idx").alias(f"{x}_stop"), F.col("stop_id").alias(f"{x}_id"), F.col("stop_name").alias(f"{x}_name"),
            F.col("lat").alias(f"{x}_lat"), F.col("lon").alias(f"{x}_lon")) for x in ("from", "to")]
        return self.legs.join(of, "trip_idx", "left").join(ends[0], "from_stop").join(ends[1], "to_stop").withColumn("mode", mode).drop("of")

    def leg_stops(self, net: Network | None = None) -> DataFrame:
        """query_id, leg_no, pos, stop_idx, its id, name and coordinate, arr, dep, dist_m of the calls of each transit leg; footpaths have none."""
        net = net or self.net
        calls = net.stop_times.select("trip_idx", "pos", "stop_idx", "arr", "dep", "dist_m")
        found = self.legs.where("kind = 'transit'").join(calls, "trip_idx").where("pos between from_place and to_place")
        return found.join(net.stops.select("stop_idx", "stop_id", "stop_name", "lat", "lon"), "stop_idx").select("query_id", "leg_no", "pos",
            "stop_idx", "stop_id", "stop_name", "lat", "lon", "arr", "dep", "dist_m")

    def leg_shapes(self) -> DataFrame:
        """query_id, leg_no, seq, lat, lon, dist_m: the shape of each transit leg's trip."""
        trip = self.legs.where("kind = 'transit'").select("query_id", "leg_no", "trip_idx")
        return trip.join(self.net.trips.select("trip_idx", "shape_idx"), "trip_idx").join(self.net.shapes, "shape_idx").select("query_id", "leg_no",
            "seq", "lat", "lon", "dist_m")

    def itineraries(self, shapes: bool = False) -> DataFrame:
        """query_id, from, to (kind, id, name, lat, lon), departure_s, arrival_s, n_legs, and legs in order: each with its ends, times,
        stops, mode, head sign and names, and with `shapes` the points of its trip's shape, else null."""
        place = lambda x, kind="stop": F.struct(F.lit(kind).alias("kind"), F.col(f"{x}id").alias("id"), F.col(f"{x}name").alias("name"),
            F.col(f"{x}lat").alias("lat"), F.col(f"{x}lon").alias("lon"))
        call = F.struct("pos", place("stop_").alias("location"), F.col("arr").alias("arrival_s"), F.col("dep").alias("departure_s"),
            F.col("dist_m").alias("distance_m"))
        stops = self.leg_stops().withColumnsRenamed({"lat": "stop_lat", "lon": "stop_lon"}).groupBy("query_id",
            "leg_no").agg(F.sort_array(F.collect_list(call)).alias("stops"))
        rows = self.named_legs().join(stops, ["query_id", "leg_no"], "left")
        if shapes:
            point = F.struct("seq", "lat", "lon", "dist_m")
            rows = rows.join(self.leg_shapes().groupBy("query_id", "leg_no").agg(F.sort_array(F.collect_list(point)).alias("shapes")),
                ["query_id", "leg_no"], "left")
        else:
            rows = rows.withColumn("shapes", F.lit(None).cast("array<struct<seq: bigint, lat: double, lon: double, dist_m: double>>"))
        leg = F.struct("leg_no", place("from_").alias("from"), place("to_").alias("to"), F.col("dep_s").alias("departure_s"),
            F.col("arr_s").alias("arrival_s"), F.coalesce("stops", F.array()).alias("stops"), "mode", "head_sign", "long_name", "short_name",
            "shapes", "kind", "trip_idx")
        of = rows.groupBy("query_id").agg(F.min_by("dep_s", "leg_no").alias("departure_s"), F.max_by("arr_s", "leg_no").alias("arrival_s"),
            F.count("*").alias("n_legs"), F.sort_array(F.collect_list(leg)).alias("legs"))
        ends = self.ends()
        for x in ("from", "to"):
            of = of.join(ends.where(F.col("end") == x).select("query_id", F.struct("kind", "id", "name", "lat", "lon").alias(x)), "query_id")
        return of.select("query_id", "from", "to", "departure_s", "arrival_s", "n_legs", "legs")

    def ends(self) -> DataFrame:
        """query_id, end (from or to), kind, id, name, lat, lon of the questions' locations; a coordinate's id and name are how it is shown."""
        asked = self.queries
        rows = asked.select("query_id", F.lit("from").alias("end"), F.col("from_kind").alias("kind"), F.col("from_id").alias("id"))
        rows = rows.union(asked.select("query_id", F.lit("to"), "to_kind", "to_id"))
        net, at = self.net, S.parse_coordinate(F.col("id"))
        stop = net.stops.select(F.col("stop_id").alias("id"), F.lit("stop").alias("kind"), F.col("stop_name").alias("name"), "lat", "lon")
        known = stop.union(net.area_centroid.select("area_id", F.lit("area"), "area_name", "lat", "lon"))
        named = rows.where("kind <> 'coordinate'").join(known, ["kind", "id"]).select("query_id", "end", "kind", "id", "name", "lat", "lon")
        shown = S.show_coordinate(at["lat"], at["lon"])
        return named.union(rows.where("kind = 'coordinate'").select("query_id", "end", "kind", shown.alias("id"), shown.alias("name"),
            at["lat"].alias("lat"), at["lon"].alias("lon")))

    def status(self) -> DataFrame:
        """query_id and ok, no_route, or what is wrong with a location, that of `from` first (invalid_stop, invalid_area,
        invalid_coordinate); nothing is raised for a question without a route."""
        q = self.queries
        own = lambda x: flaws(self.net, q.select("query_id", F.col(f"{x}_kind").alias("kind"),
            F.col(f"{x}_id").alias("id"))).withColumnRenamed("flaw", x)
        out = q.select("query_id").join(self.best.select("query_id", F.lit("ok").alias("found")), "query_id", "left").join(own("from"), "query_id",
            "left").join(own("to"), "query_id", "left")
        return out.select("query_id", F.coalesce("found", "from", "to", F.lit("no_route")).alias("status"))


def footpaths(net: Network, allow_walk: bool = True) -> DataFrame:
    out = net.transfer_times.select(F.lit("transfer").alias("kind"), "from_stop_idx", "to_stop_idx", "duration_s")
    return out.union(net.walk_edges.select(F.lit("walk"), "from_stop_idx", "to_stop_idx", "duration_s")) if allow_walk else out


def seeds(net: Network, queries: DataFrame, with_trips: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Frontier (query_id, mode, stop_idx, t) and targets (query_id, stop_idx): arrival questions start at their destination."""
    forward = F.col("mode") == "departure"
    ends = lambda own, other: queries.select("query_id", F.when(forward, F.col(f"{own}_kind")).otherwise(F.col(f"{other}_kind")).alias("kind"),
        F.when(forward, F.col(f"{own}_id")).otherwise(F.col(f"{other}_id")).alias("id"))
    start = resolve(net, ends("from", "to"), with_trips).join(queries.select("query_id", "mode", F.when(forward,
        F.col("time_s")).otherwise(-F.col("time_s")).cast("long").alias("t")), "query_id")
    return start.select("query_id", "mode", "stop_idx", "t"), resolve(net, ends("to", "from"), with_trips)


def plan(net: Network | Prepared, queries: DataFrame, allow_walk: bool = True, max_rounds: int = MAX_ROUNDS, prune: bool = True) -> Plan:
    """Answers all questions at once. prune: labels no better than the target's are dropped, which leaves the answers as they are.

    A network is prepared first; who asks several batches prepares it once.
    """
    net = net if isinstance(net, Prepared) else prepare(net)
    spark = queries.sparkSession
    edges = net.footpaths(allow_walk)
    frontier, targets = (staged(df, name) for df, name in zip(seeds(net.net, queries, net.served), ("frontier", "targets"), strict=True))
    best = spark.createDataFrame([], "query_id long, stop_idx long, t long")
    target = spark.createDataFrame([], "query_id long, t long")
    rounds: list[DataFrame] = []
    for number in range(max_rounds):
        few = frontier.count() * net.n_places <= BROADCAST_MOST
        by_trip = staged(better(first_of(relax_transit(frontier, net, few)), best, target), "by-trip")
        if by_trip.isEmpty():
            break
        # on foot from there; a stop that is reached sooner so than by a trip of this round keeps that label only
        on_foot = better(relax_footpaths(by_trip, edges).drop("order"), best, target)
        order = F.struct("t", (F.col("kind") != "transit").alias("foot"), "kind", "from_stop")
        labels = by_trip.select(*LABEL).union(on_foot.select(*LABEL)).withColumn("order", order)
        labels = staged(first_of(labels).withColumn("round", F.lit(number)), "labels")
        rounds.append(labels)
        best = reduce(DataFrame.union, (r.select("query_id", "stop_idx", "t") for r in rounds)).groupBy("query_id", "stop_idx").agg(F.min("t").alias("t"))
        if prune:
            target = best.join(F.broadcast(targets) if few else targets, ["query_id", "stop_idx"]).groupBy("query_id").agg(F.min("t").alias("t"))
        frontier = labels.select("query_id", "mode", "stop_idx", "t")
    none = spark.createDataFrame([], "query_id long, mode string, stop_idx long, t long, kind string, from_stop long, trip_idx long, from_place long, to_place long, dep_s long, arr_s long, round int")
    return Plan(queries, reduce(DataFrame.union, rounds) if rounds else none, targets, net.net)
