"""Queries over the synthetic network, by operator, and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.network import Network
from waylark.plans import planner as P
from waylark.plans import service
from waylark.sources.synthetic import FOR_TRIPS, HEAD_SIGN, network, version, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
M = lambda c: F.round(c, 6)

HAV = "2*6371000.0*atan2(sqrt({a}), sqrt(1-{a}))"
_A = "(pow(sin(radians({y2}-{y1})/2),2)+cos(radians({y1}))*cos(radians({y2}))*pow(sin(radians({x2}-{x1})/2),2))"


def sql_metres(y1: str, x1: str, y2: str, x2: str, factor: str = "1.3") -> str:
    return f"({factor}*{HAV.format(a=_A.format(y1=y1, x1=x1, y2=y2, x2=x2))})"


def query(name: str, sql: str | None = None):
    """Registers f(net) under name, with its SQL over the views."""

    def wrap(f: Callable[[Network], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(network(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return wrap


_prepared: dict[tuple, P.Prepared] = {}


def prepared(spark: SparkSession, sf_dir: str) -> P.Prepared:
    """The network of sf_dir as the planner needs it; written once per application and version of the tables."""
    key = version(spark, sf_dir)
    if key not in _prepared:
        for old in [k for k in _prepared if k[:2] == key[:2] or k[0] != key[0]]:
            del _prepared[old]
        _prepared[key] = P.prepare(network(spark, sf_dir))
    return _prepared[key]


def planned(name: str, sql: str | None = None):
    """Registers f(prepared network) under name, with its SQL over the views."""

    def wrap(f: Callable[[P.Prepared], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(prepared(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return wrap


def plain(name: str, view: str, columns: str) -> None:
    query(name, f"SELECT {columns} FROM {view}")(lambda n: getattr(n, view.removeprefix("g_")).select(*columns.split(", ")))


# ---------------------------------------------------------------- scans and projections
plain("scan_stops", "g_stops", "stop_idx, stop_id, stop_name, lat, lon, parent_idx")
plain("scan_areas", "g_areas", "area_idx, area_id, area_name")
plain("scan_stop_areas", "g_stop_areas", "area_idx, stop_idx")
plain("scan_routes", "g_routes", "route_idx, route_id, long_name, short_name, route_type")
plain("scan_trips", "g_trips", "trip_idx, trip_id, route_idx")
plain("scan_stop_times", "g_stop_times", "trip_idx, route_idx, pos, stop_idx, arr, dep, dist_m")
plain("scan_transfers", "g_transfers", "from_stop_idx, to_stop_idx, min_transfer_s")
plain("scan_shapes", "g_shapes", "shape_idx, seq, lat, lon, dist_m")
plain("project_routes", "g_routes", "route_id, long_name, short_name, route_type")
query("project_stops", "SELECT stop_id, stop_name, lower(stop_name) AS normalized_name, lat, lon FROM g_stops")(lambda n: n.project_stops)
query("project_areas", "SELECT area_id, area_name, lower(area_name) AS normalized_name FROM g_areas")(lambda n: n.project_areas)
HMS = "lpad(CAST({c}//3600 AS VARCHAR),2,'0')||':'||lpad(CAST(({c}%3600)//60 AS VARCHAR),2,'0')||':'||lpad(CAST({c}%60 AS VARCHAR),2,'0')"
query("project_stop_times", "SELECT trip_idx, pos, arr AS arr_s, dep AS dep_s, dist_m FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx",
    "pos", S.parse_hms(S.format_hms(F.col("arr"))).alias("arr_s"), S.parse_hms(S.format_hms(F.col("dep"))).alias("dep_s"), "dist_m"))
query("stops_with_trips", "SELECT stop_idx, stop_id FROM g_stops WHERE stop_idx IN (SELECT stop_idx FROM g_stop_times)")(lambda n: n.stops_with_trips.select("stop_idx",
    "stop_id"))
query("index_in_route", "SELECT route_idx, stop_idx, min(pos) AS first_pos FROM g_stop_times GROUP BY ALL")(lambda n: n.pattern_stops.groupBy("route_idx",
    "stop_idx").agg(F.min("pos").alias("first_pos")))

# ---------------------------------------------------------------- joins
query("stop_parent", "SELECT s.stop_id, p.stop_id AS parent_id FROM g_stops s LEFT JOIN g_stops p ON p.stop_idx = s.parent_idx")(lambda n: n.stop_parent)
query("area_members", "SELECT area_id, stop_id FROM g_stop_areas JOIN g_areas USING (area_idx) JOIN g_stops USING (stop_idx)")(lambda n: n.area_members)
query("trip_route", "SELECT trip_id, route_id, long_name FROM g_trips JOIN g_routes USING (route_idx)")(lambda n: n.trip_route)
query("trip_shape", "SELECT trip_id, s.shape_idx FROM g_trips LEFT JOIN (SELECT DISTINCT shape_idx "
    "FROM g_shapes) s ON s.shape_idx = route_idx")(lambda n: n.trip_shape)
DURATION = f"coalesce(t.min_transfer_s, CAST(ceil({sql_metres('a.lat', 'a.lon', 'b.lat', 'b.lon')}/1.5) AS BIGINT))"
TRANSFERS = (
    f"SELECT t.from_stop_idx, t.to_stop_idx, a.stop_id AS from_id, b.stop_id AS to_id, x.trip_id AS from_trip_id, y.trip_id AS to_trip_id, {DURATION} AS duration_s "
    "FROM g_transfers t JOIN g_stops a ON a.stop_idx=t.from_stop_idx JOIN g_stops b ON b.stop_idx=t.to_stop_idx "
    f"LEFT JOIN g_trips x ON x.trip_idx = {FOR_TRIPS['from_trip_idx']} LEFT JOIN g_trips y ON y.trip_idx = {FOR_TRIPS['to_trip_idx']}"
)
query("transfers_resolved", TRANSFERS)(lambda n: n.transfers_resolved)
query("transfer_duration", f"SELECT from_stop_idx, to_stop_idx, duration_s FROM ({TRANSFERS})")(lambda n: n.transfers_resolved.select("from_stop_idx",
    "to_stop_idx", "duration_s"))
query("stop_times_resolved", "SELECT trip_id, stop_id, pos, arr, dep FROM g_stop_times JOIN g_trips USING (trip_idx) "
    "JOIN g_stops USING (stop_idx)")(lambda n: n.stop_times_resolved)
WALK_D = sql_metres("a.lat", "a.lon", "b.lat", "b.lon")
WALKS = f"SELECT a.stop_idx AS from_stop_idx, b.stop_idx AS to_stop_idx, {WALK_D} AS metres FROM g_stops a JOIN g_stops b ON a.stop_idx <> b.stop_idx AND abs(a.lat-b.lat) < 0.01 WHERE {WALK_D} <= 500"
query("walk_edges", f"SELECT from_stop_idx, to_stop_idx, round(metres,6) AS metres, CAST(ceil(metres/1.5) AS BIGINT) AS duration_s "
    f"FROM ({WALKS})")(lambda n: n.walk_edges.withColumn("metres", M(F.col("metres"))))

# ---------------------------------------------------------------- groupings
LIST = "SELECT {k}, list_sort(list({v})) AS {v}s FROM {t} GROUP BY {k}"


def listed(name: str, key: str, value: str, table: str, where: str = "true") -> None:
    ORACLE_SQL[name] = with_views(f"SELECT {key}, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {value}) AS {value}s FROM {table} WHERE {where} GROUP BY {key}")
    QUERIES[name] = lambda spark, sf_dir: getattr(network(spark, sf_dir), name).withColumn(f"{value}s", F.array_join(F.col(f"{value}s").cast("array<string>"), ","))


listed("station_stops", "parent_idx", "stop_idx", "g_stops", "parent_idx IS NOT NULL")
listed("area_stops", "area_idx", "stop_idx", "g_stop_areas")
listed("route_trips", "route_idx", "trip_idx", "g_trips")
listed("stop_transfers", "stop_idx", "to_stop_idx", "(SELECT from_stop_idx AS stop_idx, to_stop_idx FROM g_transfers)")
listed("stop_trips", "stop_idx", "trip_idx", "g_stop_times")
query("stop_area", "SELECT s.stop_idx, a.area_idx FROM g_stops s LEFT JOIN (SELECT stop_idx, max(area_idx) AS area_idx "
    "FROM g_stop_areas GROUP BY 1) a USING (stop_idx)")(lambda n: n.stop_area)
query("stop_time_positions", "SELECT trip_idx, stop_idx, row_number() OVER (PARTITION BY trip_idx ORDER BY pos) - 1 AS inner_idx "
    "FROM g_stop_times")(lambda n: n.stop_time_positions)
query("shape_points", "SELECT shape_idx, lat, lon, dist_m, row_number() OVER (PARTITION BY shape_idx "
    "ORDER BY seq) - 1 AS inner_idx FROM g_shapes")(lambda n: n.shape_points)
CELL = "CAST(trunc(lon*111320.0/500.0) AS INTEGER) AS cell_x, CAST(trunc(lat*110540.0/500.0) AS INTEGER) AS cell_y"
query("geo_cell", f"SELECT stop_idx, {CELL} FROM g_stops")(lambda n: n.celled.select("stop_idx", "cell_x", "cell_y"))
query("geo_grid", f"SELECT cell_x, cell_y, string_agg(CAST(stop_idx AS VARCHAR), ',' ORDER BY stop_idx) AS stop_idxs "
    f"FROM (SELECT stop_idx, {CELL} FROM g_stops) GROUP BY 1, 2")(lambda n: n.geo_grid.withColumn("stop_idxs",
    F.array_join(F.col("stop_idxs").cast("array<string>"), ",")))
PATTERN = "SELECT trip_idx, route_idx, string_agg(CAST(stop_idx AS VARCHAR), ',' ORDER BY pos) AS stops, min(dep) AS dep0 FROM g_stop_times GROUP BY 1, 2"
text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
query("raptor_routes", f"SELECT route_idx, stops, count(*) AS n_trips, arg_min(trip_idx, dep0*10000000+trip_idx) AS first_trip "
    f"FROM ({PATTERN}) GROUP BY 1, 2")(lambda n: n.raptor_routes.withColumn("stops", text("stops")))
query("stop_raptors", "SELECT stop_idx, count(DISTINCT route_idx) AS n_raptors, string_agg(DISTINCT CAST(route_idx AS VARCHAR), ',' "
    "ORDER BY CAST(route_idx AS VARCHAR)) AS route_idxs FROM g_stop_times GROUP BY 1")(lambda n: n.stop_raptors.withColumn("route_idxs",
    F.array_join(F.sort_array(F.col("route_idxs").cast("array<string>")), ",")))
query("route_raptors", f"SELECT route_idx, count(DISTINCT stops) AS n_raptors FROM ({PATTERN}) GROUP BY 1")(lambda n: n.route_raptors)
query("raptor_shape", f"SELECT DISTINCT route_idx, route_idx AS shape_idx FROM ({PATTERN})")(lambda n: n.raptor_shape)
query("route_timetable", "SELECT route_idx, trip_idx, string_agg(CAST(dep AS VARCHAR), ',' ORDER BY dep) AS departures "
    "FROM g_stop_times GROUP BY 1, 2")(lambda n: n.route_timetable.withColumn("departures", text("departures")))
query("trip_timetable", "SELECT pos, stop_idx, arr, dep FROM g_stop_times WHERE trip_idx = 7")(lambda n: n.stop_times.where("trip_idx = 7").select("pos",
    "stop_idx", "arr", "dep"))
EXPANDED = "SELECT m.area_idx, s.stop_idx, s.lat, s.lon FROM g_stop_areas m JOIN g_stops s ON s.parent_idx = m.stop_idx"
CENTROID = f"SELECT a.area_idx, a.area_id, a.area_name, c.lat, c.lon FROM g_areas a LEFT JOIN (SELECT area_idx, avg(lat) AS lat, avg(lon) AS lon FROM ({EXPANDED}) GROUP BY 1) c USING (area_idx)"
query("area_stops_expanded", f"SELECT area_idx, stop_idx FROM ({EXPANDED})")(lambda n: n.area_stops_expanded.select("area_idx", "stop_idx"))
query("area_centroid", f"SELECT area_id, round(lat,6) AS lat, round(lon,6) AS lon FROM ({CENTROID})")(lambda n: n.area_centroid.select("area_id",
    M(F.col("lat")).alias("lat"), M(F.col("lon")).alias("lon")))
query("trip_shapes", "SELECT shape_idx, seq, lat, lon, dist_m FROM g_shapes WHERE shape_idx = (SELECT route_idx FROM g_trips "
    "WHERE trip_idx = 7)")(lambda n: n.trip_shapes(7))
for _t, _k, _v in (("stop", "stop_id", "S3"), ("area", "area_id", "A2"), ("trip", "trip_id", "T5"), ("route", "route_id", "R4")):
    query(f"lookup_{_t}", f"SELECT {_t}_idx, {_k} FROM g_{_t}s WHERE {_k} = '{_v}'")(lambda n, t=_t, k=_k, v=_v: n.lookup(f"{t}s", k, v).select(f"{t}_idx", k))

# ---------------------------------------------------------------- scalars
PAIRS = "(SELECT a.stop_name AS x, b.stop_name AS y FROM g_stops a JOIN g_stops b ON b.stop_idx = a.stop_idx + 1)"
pairs = lambda n: n.stops.select("stop_idx", F.col("stop_name").alias("x")).join(n.stops.select((F.col("stop_idx") - 1).alias("stop_idx"),
    F.col("stop_name").alias("y")), "stop_idx").select("x", "y")
SCORE = "CASE WHEN greatest(length({a}),length({b}))=0 THEN 1.0 ELSE 1 - levenshtein({a},{b})/CAST(greatest(length({a}),length({b})) AS DOUBLE) END"
FUZZY = "(CASE WHEN len(str_split({n},' '))=0 THEN 0 ELSE coalesce(list_sum([" + SCORE.format(a="str_split({n},' ')[i]",
    b="str_split({t},' ')[i]") + " for i in range(1, 1+least(len(str_split({n},' ')), len(str_split({t},' '))))]),0)/len(str_split({n},' ')) END)"
query("fuzzy_distance", f"SELECT x, y, CAST(levenshtein(x, y) AS INTEGER) AS d FROM {PAIRS}")(lambda n: pairs(n).select("x", "y",
    F.levenshtein("x", "y").alias("d")))
query("fuzzy_token_score", f"SELECT x, y, round({SCORE.format(a='x', b='y')},6) AS score FROM {PAIRS}")(lambda n: pairs(n).select("x", "y",
    M(S.token_score(F.col("x"), F.col("y"))).alias("score")))
query("fuzzy_score", f"SELECT x, y, round({FUZZY.format(n='x', t='y')},6) AS score FROM {PAIRS}")(lambda n: pairs(n).select("x", "y",
    M(S.fuzzy_score(F.col("x"), F.col("y"))).alias("score")))
YX = ("a.lat", "a.lon", "b.lat", "b.lon")
NEXT = "g_stops a JOIN g_stops b ON b.stop_idx = a.stop_idx + 1"


def next_stops(n: Network) -> DataFrame:
    b = n.stops.select((F.col("stop_idx") - 1).alias("stop_idx"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return n.stops.join(b, "stop_idx")


YX_COLS = lambda: [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
query("haversine", f"SELECT a.stop_idx, round({sql_metres(*YX, factor='1.0')},6) AS metres FROM {NEXT}")(lambda n: next_stops(n).select("stop_idx",
    M(S.haversine(*YX_COLS())).alias("metres")))
query("network_distance", f"SELECT a.stop_idx, round({sql_metres(*YX)},6) AS metres FROM {NEXT}")(lambda n: next_stops(n).select("stop_idx",
    M(S.network_distance(*YX_COLS())).alias("metres")))
query("walk_time", "SELECT trip_idx, pos, CAST(ceil((dist_m + pos)/1.5) AS BIGINT) AS walk_s FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx",
    "pos", S.walk_seconds(F.col("dist_m") + F.col("pos")).alias("walk_s")))
query("distance_convert", "SELECT trip_idx, pos, dist_m/1000.0 AS km, dist_m*2-100 AS m FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx",
    "pos", (F.col("dist_m") / 1000.0).alias("km"), (F.col("dist_m") * 2 - 100).alias("m")))
COORD = "CAST(lat AS VARCHAR)||' , '||CAST(lon AS VARCHAR)"
query("parse_coordinate", "SELECT stop_idx, round(lat,6) AS lat, round(lon,6) AS lon FROM g_stops")(lambda n: n.stops.select("stop_idx",
    S.parse_coordinate(F.concat(F.col("lat").cast("string"), F.lit(" , x, "), F.col("lon").cast("string"))).alias("c")).select("stop_idx",
    M(F.col("c.lat")).alias("lat"), M(F.col("c.lon")).alias("lon")))
query("parse_hms", "SELECT trip_idx, pos, arr + 86400 AS s FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx", "pos",
    S.parse_hms(S.format_hms(F.col("arr") + 86400)).alias("s")))
query("format_hms", f"SELECT trip_idx, pos, {HMS.format(c='arr')} AS hms FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx", "pos",
    S.format_hms(F.col("arr")).alias("hms")))
query("time_arith", "SELECT trip_idx, pos, dep - arr AS dwell_s, arr + 60 AS later_s FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx",
    "pos", (F.col("dep") - F.col("arr")).alias("dwell_s"), (F.col("arr") + 60).alias("later_s")))
query("duration_units", "SELECT trip_idx, pos, pos*60 AS minutes_s, pos*3600 AS hours_s, pos*86400 AS days_s, CAST(pos AS VARCHAR)||'s' AS shown "
    "FROM g_stop_times")(lambda n: n.stop_times.select("trip_idx", "pos", (F.col("pos") * 60).alias("minutes_s"),
    (F.col("pos") * 3600).alias("hours_s"), (F.col("pos") * 86400).alias("days_s"), F.concat(F.col("pos").cast("string"), F.lit("s")).alias("shown")))
MODES = "CASE WHEN route_type=0 OR route_type BETWEEN 900 AND 999 THEN 'Tram' WHEN route_type=1 OR route_type BETWEEN 400 AND 405 THEN 'Subway' WHEN route_type=2 OR route_type BETWEEN 100 AND 199 THEN 'Rail' WHEN route_type=3 OR route_type BETWEEN 700 AND 799 THEN 'Bus' WHEN route_type=4 OR route_type BETWEEN 1000 AND 1099 THEN 'Ferry' ELSE 'Unknown' END"
query("route_mode", f"SELECT route_id, {MODES} AS mode FROM g_routes")(lambda n: n.routes.select("route_id", S.mode(F.col("route_type")).alias("mode")))

# ---------------------------------------------------------------- search and proximity
NEEDLE = "red widget"
FOUND = f"SELECT {{c}}, round({FUZZY.format(n=f'{chr(39)}{NEEDLE}{chr(39)}', t='lower({name})')},6) AS score FROM {{t}} WHERE {FUZZY.format(n=f'{chr(39)}{NEEDLE}{chr(39)}', t='lower({name})')} > 0.1 {{more}} ORDER BY score DESC, {{c}} LIMIT 5"
query("search_stops", FOUND.format(c="stop_id", name="stop_name", t="g_stops",
    more="AND stop_idx IN (SELECT stop_idx FROM g_stop_times)"))(lambda n: service.search_stops(n, NEEDLE).select("stop_id",
    M(F.col("score")).alias("score")))
query("search_areas", FOUND.format(c="area_id", name="area_name", t="g_areas", more="").replace(NEEDLE, "asian"))(lambda n: service.search_areas(n,
    "asian").select("area_id", M(F.col("score")).alias("score")))
HERE = (59.0103, 18.0151)
HERE_TEXT = ", ".join(map(str, HERE))
NEAR = f"SELECT stop_idx, stop_id, {sql_metres(str(HERE[0]), str(HERE[1]), 'lat', 'lon')} AS metres FROM g_stops"
query("near_stops", f"SELECT stop_id, round(metres,6) AS metres FROM ({NEAR}) WHERE metres <= 500")(lambda n: service.near_stops(n,
    HERE_TEXT).select("stop_id", M(F.col("metres")).alias("metres")))
query("stops_beside", f"SELECT to_stop_idx AS stop_idx, round(metres,6) AS metres FROM ({WALKS}) WHERE from_stop_idx = 3")(lambda n: n.stops_beside(3).select("stop_idx",
    M(F.col("metres")).alias("metres")))
query("near_areas", f"SELECT c.area_id, round({sql_metres(str(HERE[0]), str(HERE[1]), 'c.lat', 'c.lon')},6) AS metres "
    f"FROM ({NEAR}) s JOIN g_stop_areas m USING (stop_idx) JOIN ({CENTROID}) c ON c.area_idx = m.area_idx "
    f"WHERE s.metres <= 1000")(lambda n: service.near_areas(n, HERE_TEXT, 1000.0).select("area_id", M(F.col("metres")).alias("metres")))

# ---------------------------------------------------------------- single steps of the planner
LABELS = "(SELECT stop_idx AS query_id, stop_idx, 28800 + stop_idx * 97 AS t FROM g_stops WHERE parent_idx IS NOT NULL)"
marks = lambda n, mode="departure", sign=1: n.stops.where("parent_idx is not null").select(F.col("stop_idx").alias("query_id"),
    F.lit(mode).alias("mode"), "stop_idx", (sign * (28800 + F.col("stop_idx") * 97)).alias("t"))


def boarded(p: P.Prepared, mode: str, sign: int) -> DataFrame:
    at = marks(p.net, mode, sign).join(p.places, ["mode", "stop_idx"]).select("query_id", "mode", "rroute", "pos", "first", "t")
    on = P.next_trip(at, p.boards).select("query_id", "rroute", F.abs("pos").alias("pos"), F.abs("trip_rank").alias("trip_rank"))
    return on.join(p.trips, ["rroute", "trip_rank"]).select("query_id", "pos", "trip_idx")


planned("earliest_trip", f"SELECT l.query_id, st.pos, arg_min(st.trip_idx, st.arr*10000000+st.trip_idx) AS trip_idx FROM {LABELS} l "
    f"JOIN g_stop_times st ON st.stop_idx = l.stop_idx AND st.arr >= l.t " f"GROUP BY l.query_id, st.route_idx, st.pos")(lambda p: boarded(p,
    "departure", 1))
planned("latest_trip", f"SELECT l.query_id, st.pos, arg_max(st.trip_idx, st.arr*10000000+st.trip_idx) AS trip_idx FROM {LABELS} l "
    f"JOIN g_stop_times st ON st.stop_idx = l.stop_idx AND st.arr <= l.t " f"GROUP BY l.query_id, st.route_idx, st.pos")(lambda p: boarded(p,
    "arrival", -1))
query("routes_serving_stop", "SELECT DISTINCT stop_idx, route_idx, pos FROM g_stop_times")(lambda n: n.pattern_stops.select("stop_idx", "route_idx", "pos"))
query("active_routes", f"SELECT route_idx, min(pos) AS first_pos, max(pos) AS last_pos FROM g_stop_times "
    f"WHERE stop_idx IN (SELECT stop_idx FROM {LABELS}) GROUP BY 1")(lambda n: n.pattern_stops.join(marks(n).select("stop_idx"), "stop_idx",
    "left_semi").groupBy("route_idx").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")))
FOOT = f"(SELECT from_stop_idx, to_stop_idx, duration_s FROM ({TRANSFERS}) UNION ALL SELECT from_stop_idx, to_stop_idx, CAST(ceil(metres/1.5) AS BIGINT) FROM ({WALKS}))"
query("transfer_candidates", f"SELECT from_stop_idx, to_stop_idx, duration_s FROM {FOOT}")(lambda n: P.footpaths(n).select("from_stop_idx",
    "to_stop_idx", "duration_s"))
query("relax_footpaths", f"SELECT l.query_id, f.to_stop_idx AS stop_idx, min(l.t + f.duration_s) AS t FROM {LABELS} l "
    f"JOIN {FOOT} f ON f.from_stop_idx = l.stop_idx GROUP BY 1, 2")(lambda n: P.first_of(P.relax_footpaths(marks(n),
    P.footpaths(n))).select("query_id", "stop_idx", "t"))
query("relax_footpaths_reverse", f"SELECT l.query_id, f.to_stop_idx AS stop_idx, max(l.t - f.duration_s) AS t FROM {LABELS} l "
    f"JOIN {FOOT} f ON f.from_stop_idx = l.stop_idx GROUP BY 1, 2")(lambda n: P.first_of(P.relax_footpaths(marks(n, "arrival", -1),
    P.footpaths(n))).select("query_id", "stop_idx", (-F.col("t")).alias("t")))
RIDE = "(SELECT l.query_id, l.t, st.route_idx, st.pos, arg_min(st.trip_idx, st.arr*10000000+st.trip_idx) AS trip_idx FROM {labels} l JOIN g_stop_times st ON st.stop_idx = l.stop_idx AND st.arr >= l.t GROUP BY l.query_id, l.t, st.route_idx, st.pos)"
TRANSIT = "SELECT b.query_id, d.stop_idx, min(d.arr) AS t FROM " + RIDE + " b JOIN g_stop_times d ON d.trip_idx = b.trip_idx AND d.pos > b.pos GROUP BY 1, 2"
planned("relax_transit", TRANSIT.format(labels=LABELS))(lambda p: P.first_of(P.relax_transit(marks(p.net), p)).select("query_id", "stop_idx", "t"))
BACK = f"(SELECT l.query_id, l.t, st.route_idx, st.pos, arg_max(st.trip_idx, st.arr*10000000+st.trip_idx) AS trip_idx FROM {LABELS} l JOIN g_stop_times st ON st.stop_idx = l.stop_idx AND st.arr <= l.t GROUP BY l.query_id, l.t, st.route_idx, st.pos)"
planned("relax_transit_reverse", f"SELECT b.query_id, d.stop_idx, max(d.dep) AS t FROM {BACK} b "
    f"JOIN g_stop_times d ON d.trip_idx = b.trip_idx AND d.pos < b.pos GROUP BY 1, 2")(lambda p: P.first_of(P.relax_transit(marks(p.net, "arrival",
    -1), p)).select("query_id", "stop_idx", (-F.col("t")).alias("t")))
planned("merge_labels", f"SELECT query_id, stop_idx, min(t) AS t FROM (SELECT * FROM {LABELS} "
    f"UNION ALL ({TRANSIT.format(labels=LABELS)})) GROUP BY 1, 2")(lambda p: P.merge(marks(p.net).select("query_id", "stop_idx", "t"),
    P.relax_transit(marks(p.net), p)))
ASKED = [("stop", "S3"), ("stop", "N4"), ("stop", "S9"), ("area", "A1"), ("area", "A3"), ("coordinate", "59.0103, 18.0151"), ("stop", "none")]
asked = lambda n, kind: n.stops.sparkSession.createDataFrame([(i, *a) for i, a in enumerate(ASKED) if a[0] == kind],
    "query_id long, kind string, id string")
ASKED_SQL = lambda kind: "(VALUES " + ", ".join(f"({i}, '{x}')" for i, (k, x) in enumerate(ASKED) if k == kind) + ") q(query_id, id)"
query("resolve_stop", f"SELECT DISTINCT CAST(q.query_id AS BIGINT) AS query_id, coalesce(c.stop_idx, s.stop_idx) AS stop_idx "
    f"FROM {ASKED_SQL('stop')} JOIN g_stops s ON s.stop_id = q.id LEFT "
    f"JOIN g_stops c ON c.parent_idx = coalesce(s.parent_idx, s.stop_idx)")(lambda n: P.resolve(n, asked(n, "stop")))
query("resolve_area", f"SELECT DISTINCT CAST(q.query_id AS BIGINT) AS query_id, e.stop_idx FROM {ASKED_SQL('area')} "
    f"JOIN g_areas a ON a.area_id = q.id JOIN ({EXPANDED}) e ON e.area_idx = a.area_idx "
    f"WHERE e.stop_idx IN (SELECT stop_idx FROM g_stop_times)")(lambda n: P.resolve(n, asked(n, "area")))
query("resolve_coordinate", f"SELECT CAST(5 AS BIGINT) AS query_id, stop_idx FROM ({NEAR}) "
    f"WHERE metres <= 500 AND stop_idx IN (SELECT stop_idx FROM g_stop_times)")(lambda n: P.resolve(n, asked(n, "coordinate")))
query("parse_location", "SELECT CAST(query_id AS BIGINT) AS query_id, id AS text, CASE WHEN contains(id, ',') THEN 'coordinate' WHEN id IN (SELECT area_id "
    "FROM g_areas) THEN 'area' WHEN id IN (SELECT stop_id FROM g_stops) THEN 'stop' END AS kind FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i,
    (_, x) in enumerate(ASKED)) + ") q(query_id, id)")(lambda n: P.parse_location(n,
    n.stops.sparkSession.createDataFrame([(i, x) for i, (_, x) in enumerate(ASKED)], "query_id long, text string")))
query("describe_location", f"SELECT 'stop' AS kind, stop_id AS id, stop_name AS name, round(lat,6) AS lat, round(lon,6) AS lon "
    f"FROM g_stops UNION ALL SELECT 'area', area_id, area_name, round(lat,6), round(lon,6) FROM ({CENTROID})")(lambda n: n.stops.select(F.lit("stop").alias("kind"),
    F.col("stop_id").alias("id"), F.col("stop_name").alias("name"), M(F.col("lat")).alias("lat"),
    M(F.col("lon")).alias("lon")).union(n.area_centroid.select(F.lit("area"), "area_id", "area_name", M(F.col("lat")), M(F.col("lon")))))

# ---------------------------------------------------------------- journeys
N_QUERIES = 20


def questions(n: Network, mode: str = "departure", count: int = N_QUERIES, time_s: int = 28800) -> DataFrame:
    """From stop S<i mod 10> to the station of another region."""
    i = F.col("query_id")
    name = lambda c: F.concat(F.lit("S"), (c % 10).cast("string"))
    return n.stops.sparkSession.range(count).select(F.col("id").alias("query_id")).select("query_id", F.lit("stop").alias("from_kind"),
        name(i).alias("from_id"), F.lit("stop").alias("to_kind"), name(i * 7 + 3).alias("to_id"), F.lit(mode).alias("mode"),
        (F.lit(time_s) + i * 300).alias("time_s"))


query("seed_labels", "SELECT DISTINCT i.query_id, coalesce(c.stop_idx, s.stop_idx) AS stop_idx, 28800 + i.query_id * 300 AS t "
    "FROM (SELECT CAST(range AS BIGINT) AS query_id FROM range(20)) i "
    "JOIN g_stops s ON s.stop_id = concat('S', CAST(i.query_id % 10 AS VARCHAR)) LEFT "
    "JOIN g_stops c ON c.parent_idx = coalesce(s.parent_idx, s.stop_idx)")(lambda n: P.seeds(n, questions(n))[0].select("query_id", "stop_idx", "t"))


def journeys_sql(mode: str, time_s: int, last: str, rounds: int = P.MAX_ROUNDS) -> str:
    """`last` over labels (of all rounds, not pruned by the target), targets, best and way (the journeys' legs, from the target back).

    A round's labels improve on all before; arrival questions are those of departure over negated times.
    """
    sign, own, other = (1, "from_id", "to_id") if mode == "departure" else (-1, "to_id", "from_id")
    table = "rroute, trip_rank, trip_idx, pos, arr AS board, arr AS reach, dep AS other" if sign == 1 else "rroute, -trip_rank AS trip_rank, trip_idx, -pos AS pos, -arr AS board, -dep AS reach, arr AS other"
    resolved = "(SELECT DISTINCT q.query_id, coalesce(c.stop_idx, s.stop_idx) AS stop_idx, q.time_s FROM q JOIN g_stops s ON s.stop_id = q.{id} LEFT JOIN g_stops c ON c.parent_idx = coalesce(s.parent_idx, s.stop_idx))"
    time = lambda ride, t: f"{ride}, {t}" if sign == 1 else f"-({t}), -({ride})"
    ctes = [
        f"q AS MATERIALIZED ({questions_sql(time_s)})",
        "pattern AS (SELECT trip_idx, concat(CAST(route_idx AS VARCHAR), '-', substr(md5(concat(CAST(route_idx AS VARCHAR), ',', string_agg(CAST(stop_idx AS VARCHAR), ',' ORDER BY pos))), 1, 12)) AS rroute, arg_min(dep, pos) AS dep0 FROM g_stop_times GROUP BY trip_idx, route_idx)",
        "ranked AS (SELECT trip_idx, rroute, row_number() OVER (PARTITION BY rroute ORDER BY dep0, trip_idx) AS trip_rank FROM pattern)",
        f"tt AS MATERIALIZED (SELECT {table}, stop_idx, pos AS place FROM g_stop_times JOIN ranked USING (trip_idx))",
        f"foot AS MATERIALIZED (SELECT 'transfer' AS kind, from_stop_idx, to_stop_idx, duration_s FROM ({TRANSFERS}) UNION ALL SELECT 'walk', from_stop_idx, to_stop_idx, CAST(ceil(metres/1.5) AS BIGINT) FROM ({WALKS}))",
        f"f0 AS MATERIALIZED (SELECT query_id, stop_idx, {sign} * time_s AS t FROM {resolved.format(id=own)})",
        f"targets AS MATERIALIZED (SELECT query_id, stop_idx FROM {resolved.format(id=other)})",
        "b0 AS (SELECT query_id, stop_idx, t FROM f0 WHERE false)",
    ]
    dep_arr = time("start_s", "reach") if sign == 1 else "-reach, start_s"
    for r in range(1, rounds + 1):
        ctes += [
            f"on{r} AS (SELECT l.query_id, l.stop_idx AS from_stop, tt.rroute, tt.pos, min(tt.trip_rank) AS trip_rank FROM f{r - 1} l JOIN tt ON tt.stop_idx = l.stop_idx AND tt.board >= l.t GROUP BY ALL)",
            f"ride{r} AS (SELECT o.query_id, d.stop_idx, d.reach, o.from_stop, o.rroute, o.trip_rank, o.pos, d.trip_idx, s.place AS from_place, d.place AS to_place, s.other AS start_s FROM on{r} o JOIN tt s USING (rroute, trip_rank, pos) JOIN tt d ON d.rroute = o.rroute AND d.trip_rank = o.trip_rank AND d.pos > o.pos)",
            f"first{r} AS (SELECT * FROM ride{r} QUALIFY row_number() OVER (PARTITION BY query_id, stop_idx ORDER BY reach, trip_rank, -pos, rroute) = 1)",
            f"c{r} AS MATERIALIZED (SELECT query_id, stop_idx, reach AS t, 'transit' AS kind, from_stop, trip_idx, from_place, to_place, start_s, reach FROM first{r} LEFT JOIN b{r - 1} b USING (query_id, stop_idx) WHERE b.t IS NULL OR reach < b.t)",
            f"m{r} AS MATERIALIZED (SELECT query_id, stop_idx, min(t) AS t FROM (SELECT * FROM b{r - 1} UNION ALL SELECT query_id, stop_idx, t FROM c{r}) GROUP BY 1, 2)",
            f"near{r} AS (SELECT c.query_id, f.to_stop_idx AS stop_idx, c.t + f.duration_s AS t, f.kind, c.stop_idx AS from_stop, c.t AS t0 FROM c{r} c JOIN foot f ON f.from_stop_idx = c.stop_idx QUALIFY row_number() OVER (PARTITION BY c.query_id, f.to_stop_idx ORDER BY c.t + f.duration_s, f.kind, c.stop_idx) = 1)",
            f"w{r} AS MATERIALIZED (SELECT x.* FROM near{r} x LEFT JOIN m{r} b USING (query_id, stop_idx) WHERE b.t IS NULL OR x.t < b.t)",
            f"b{r} AS MATERIALIZED (SELECT query_id, stop_idx, min(t) AS t FROM (SELECT * FROM m{r} UNION ALL SELECT query_id, stop_idx, t FROM w{r}) GROUP BY 1, 2)",
            f"l{r} AS MATERIALIZED (SELECT query_id, stop_idx, t, kind, from_stop, trip_idx, from_place, to_place, {dep_arr.split(', ')[0]} AS dep_s, {dep_arr.split(', ')[1]} AS arr_s FROM c{r} ANTI JOIN w{r} USING (query_id, stop_idx) "
            f"UNION ALL SELECT query_id, stop_idx, t, kind, from_stop, NULL, NULL, NULL, {'t0' if sign == 1 else '-t'}, {'t' if sign == 1 else '-t0'} FROM w{r})",
            f"f{r} AS (SELECT query_id, stop_idx, t FROM l{r})",
        ]
    ctes.append("labels AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, CAST({r - 1} AS INTEGER) AS round FROM l{r}" for r in range(1, rounds + 1)) + ")")
    ctes.append("best AS MATERIALIZED (SELECT query_id, stop_idx, t, round FROM labels "
        "JOIN targets USING (query_id, stop_idx) QUALIFY row_number() OVER (PARTITION BY query_id " "ORDER BY t, round, stop_idx) = 1)")
    ctes.append("way AS (SELECT l.*, 0 AS depth FROM best JOIN labels l USING (query_id, stop_idx, round) "
        "UNION ALL SELECT l.*, depth + 1 FROM way w "
        "JOIN labels l ON l.query_id = w.query_id AND l.stop_idx = w.from_stop AND l.round = w.round - CASE WHEN w.kind = 'transit' THEN 1 ELSE 0 END)")
    order, ends = ("-depth", "from_stop, stop_idx AS to_stop, from_place, to_place") if sign == 1 else ("depth",
        "stop_idx AS from_stop, from_stop AS to_stop, to_place AS from_place, from_place AS to_place")
    ctes.append(f"legs AS MATERIALIZED (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id "
        f"ORDER BY {order}) - 1 AS INTEGER) AS leg_no, kind, {ends}, trip_idx, dep_s, arr_s FROM way)")
    head = ("SELECT trip_idx AS ti, " + HEAD_SIGN + " AS head_sign, long_name, short_name, " + MODES + " AS of FROM g_trips JOIN g_routes USING (route_idx)").replace("STRING",
        "VARCHAR")
    ends = ", ".join(f"{x}.stop_id AS {y}_id, {x}.stop_name AS {y}_name, {x}.lat AS {y}_lat, {x}.lon AS {y}_lon" for x, y in (("a", "from"), ("b", "to")))
    ctes.append(f"named AS MATERIALIZED (SELECT legs.*, {ends}, head_sign, long_name, short_name, CASE kind WHEN 'transit' THEN of WHEN 'walk' THEN 'Walk' ELSE 'Transfer' END AS mode "
        f"FROM legs JOIN g_stops a ON a.stop_idx = from_stop JOIN g_stops b ON b.stop_idx = to_stop LEFT " f"JOIN ({head}) ON ti = trip_idx)")
    views = with_views("SELECT 1").rpartition("\n")[0].replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{views}, {', '.join(ctes)} {last}"


def questions_sql(time_s: int) -> str:
    return f"SELECT CAST(range AS BIGINT) AS query_id, concat('S', CAST(range % 10 AS VARCHAR)) AS from_id, concat('S', CAST((range * 7 + 3) % 10 AS VARCHAR)) AS to_id, {time_s} + range * 300 AS time_s FROM range({N_QUERIES})"


def journey(name: str, sql: str, mode: str = "departure", **more):
    """Registers f(plan) of the questions of a mode, with its SQL over what journeys_sql tells."""
    time_s = 28800 if mode == "departure" else 61200

    def wrap(f: Callable[[P.Plan], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            net = prepared(spark, sf_dir)
            return f(P.plan(net, questions(net.net, mode, time_s=time_s), **more))

        QUERIES[name] = run
        ORACLE_SQL[name] = journeys_sql(mode, time_s, sql)
        return f

    return wrap


LABELLED = "SELECT query_id, stop_idx, round, t, kind, from_stop, trip_idx, dep_s, arr_s FROM labels"
LEGS = "SELECT query_id, leg_no, kind, trip_idx, from_place, to_place, from_id, to_id, from_name, to_name, dep_s, arr_s, mode, head_sign, long_name, short_name FROM named"
CALLS = "SELECT query_id, leg_no, pos, stop_idx, stop_id, stop_name, round(lat,6) AS lat, round(lon,6) AS lon, arr, dep, dist_m FROM legs JOIN g_stop_times USING (trip_idx) JOIN g_stops USING (stop_idx) WHERE pos BETWEEN from_place AND to_place"
SHAPES = "SELECT query_id, leg_no, seq, round(lat,6) AS lat, round(lon,6) AS lon, dist_m FROM legs JOIN g_trips USING (trip_idx) JOIN g_shapes ON shape_idx = g_trips.route_idx"
SPOKEN = "string_agg(concat_ws(' ', mode, from_id, to_id, CAST(dep_s AS VARCHAR), CAST(arr_s AS VARCHAR), CAST(coalesce(n, 0) AS VARCHAR), coalesce(long_name, '-')), ';' ORDER BY leg_no)"
WHOLE = (
    f"SELECT query_id, 'stop' AS from_kind, any_value(q.from_id) AS from_id, any_value(x.stop_name) AS from_name, any_value(q.to_id) AS to_id, any_value(y.stop_name) AS to_name, arg_min(dep_s, leg_no) AS departure_s, arg_max(arr_s, leg_no) AS arrival_s, count(*) AS n_legs, {SPOKEN.replace('from_id', 'named.from_id').replace('to_id', 'named.to_id')} AS legs "
    "FROM named JOIN q USING (query_id) JOIN g_stops x ON x.stop_id = q.from_id JOIN g_stops y ON y.stop_id = q.to_id "
    "LEFT JOIN (SELECT query_id, leg_no, count(*) AS n FROM legs JOIN g_stop_times USING (trip_idx) WHERE pos BETWEEN from_place AND to_place GROUP BY 1, 2) USING (query_id, leg_no) GROUP BY query_id"
)
_coords = lambda df: df.withColumn("lat", M(F.col("lat"))).withColumn("lon", M(F.col("lon")))


def spoken(p: P.Plan) -> DataFrame:
    """Itineraries with their legs as a line of text each."""
    line = lambda g: F.concat_ws(" ", g["mode"], g["from"]["id"], g["to"]["id"], g["departure_s"].cast("string"), g["arrival_s"].cast("string"),
        F.size(g["stops"]).cast("string"), F.coalesce(g["long_name"], F.lit("-")))
    legs = F.array_join(F.transform("legs", line), ";").alias("legs")
    return p.itineraries().select("query_id", F.col("from.kind").alias("from_kind"), F.col("from.id").alias("from_id"),
        F.col("from.name").alias("from_name"), F.col("to.id").alias("to_id"), F.col("to.name").alias("to_name"), "departure_s", "arrival_s", "n_legs",
        legs)


journey("plan_labels", LABELLED, prune=False)(lambda p: p.labels.select("query_id", "stop_idx", "round", "t", "kind", "from_stop", "trip_idx", "dep_s", "arr_s"))
journey("plan_labels_reverse", LABELLED, "arrival", prune=False)(lambda p: p.labels.select("query_id", "stop_idx", "round", "t", "kind", "from_stop",
    "trip_idx", "dep_s", "arr_s"))
journey("plan_forward", "SELECT query_id, stop_idx, t, round FROM best")(lambda p: p.best)
journey("plan_reverse", "SELECT query_id, stop_idx, -t AS t, round FROM best", "arrival")(lambda p: p.best.withColumn("t", -F.col("t")))
journey("itinerary_legs", LEGS)(lambda p: p.named_legs().select("query_id", "leg_no", "kind", "trip_idx", "from_place", "to_place", "from_id",
    "to_id", "from_name", "to_name", "dep_s", "arr_s", "mode", "head_sign", "long_name", "short_name"))
journey("itinerary_legs_reverse", LEGS, "arrival")(lambda p: p.named_legs().select("query_id", "leg_no", "kind", "trip_idx", "from_place", "to_place",
    "from_id", "to_id", "from_name", "to_name", "dep_s", "arr_s", "mode", "head_sign", "long_name", "short_name"))
journey("itinerary_stops", CALLS)(lambda p: _coords(p.leg_stops()))
journey("itinerary_shapes", SHAPES)(lambda p: _coords(p.leg_shapes()))
journey("itinerary", WHOLE)(spoken)
RIDE_TEXT = "CASE kind WHEN 'transit' THEN concat('Travel with ', coalesce(long_name, 'UNKOWN'), '(', coalesce(short_name, 'UNKOWN'), ')') WHEN 'walk' THEN 'Walk' ELSE 'Transfer' END"
journey("leg_text", f"SELECT query_id, leg_no, {RIDE_TEXT} AS told FROM named")(lambda p: p.named_legs().select("query_id", "leg_no",
    S.leg_text(F.col("kind"), F.col("long_name"), F.col("short_name")).alias("told")))

journey("marked_stops", "SELECT round, count(*) AS n FROM labels GROUP BY round", prune=False)(lambda p: p.labels.groupBy("round").agg(F.count("*").alias("n")))


def asked_in_words(p: P.Prepared) -> DataFrame:
    """The questions as requests in strings; every other one has a departure too, which an arrival is to beat."""
    q = questions(p.net, "arrival", time_s=61200)
    return q.select("query_id", F.col("from_id").alias("from"), F.col("to_id").alias("to"), S.format_hms(F.col("time_s")).alias("arrive_at"),
        F.when(F.col("query_id") % 2 == 0, "07:00:00").alias("departure_at"))


QUERIES["routing"] = lambda spark, sf_dir: service.route(p := prepared(spark, sf_dir), asked_in_words(p)).select("query_id", "status", "departure_s",
    "arrival_s", "n_legs")
ORACLE_SQL["routing"] = journeys_sql("arrival", 61200,
    "SELECT query_id, 'ok' AS status, arg_min(dep_s, leg_no) AS departure_s, arg_max(arr_s, leg_no) AS arrival_s, count(*) AS n_legs "
    "FROM legs GROUP BY query_id")
query("show_coordinate", "SELECT stop_idx, concat(CAST(lat AS VARCHAR), ', ', CAST(lon AS VARCHAR)) AS shown FROM g_stops")(lambda n: n.stops.select("stop_idx",
    S.show_coordinate(F.col("lat"), F.col("lon")).alias("shown")))

#: Questions with a flaw: kind and id of both ends, and what must be said of them.
FLAWED = (("stop", "none", "stop", "S3", "invalid_stop"), ("area", "ZZ", "stop", "none", "invalid_area"),
    ("stop", "S3", "coordinate", "1;2", "invalid_coordinate"), ("coordinate", "0.5,0.5", "stop", "S3", "no_route"))


@planned("plan_status", f"SELECT CAST(range AS BIGINT) AS query_id, 'ok' AS status FROM range({N_QUERIES}) "
    f"UNION ALL SELECT CAST(id AS BIGINT), s FROM (VALUES " + ", ".join(f"({1000 + i}, '{f[4]}')" for i, f in enumerate(FLAWED)) + ") v(id, s)")
def plan_status(p: P.Prepared) -> DataFrame:
    """Of questions that have an answer, as plan_forward shows, and of those with a flaw."""
    asked = questions(p.net)
    more = asked.sparkSession.createDataFrame([(1000 + i, *f[:4], "departure", 28800) for i, f in enumerate(FLAWED)], asked.schema)
    return P.plan(p, asked.union(more)).status()
