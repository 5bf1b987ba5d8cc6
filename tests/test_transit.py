import importlib
import random
import sys
import zipfile

import pytest
from oracle import connect, differs
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.plans import catalog, planner, service
from waylark.sources.feed import BadArchive, BadRow, DanglingKey, Feed, FeedError, MissingFile
from waylark.streaming.questions import answer_stream

STOPS = "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,platform_code"
TIMES = "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign,pickup_type,drop_off_type,shape_dist_traveled,timepoint,pickup_booking_rule_id,drop_off_booking_rule_id"
CALLS = {
    "t1": [("A", "08:00:00", "08:00:00"), ("B", "08:10:00", "08:11:00"), ("C", "08:20:00", "08:20:00")],
    "t2": [("A", "08:30:00", "08:30:00"), ("B", "08:40:00", "08:41:00"), ("C", "08:50:00", "08:50:00")],
    "u1": [("D", "08:21:00", "08:21:00"), ("E", "08:30:00", "08:30:00")],
    "u2": [("D", "08:40:00", "08:40:00"), ("E", "08:50:00", "08:50:00")],
}
FILES = {
    "stops": [STOPS] + [f"{s},Stop {s},{lat},18.0,,," for s, lat in (("A", 59.0), ("B", 59.1), ("C", 59.2), ("D", 59.202), ("E", 59.4))],
    "areas": ["area_id,area_name,samtrafiken_area_type", "X,Area X,t"],
    "stop_areas": ["area_id,stop_id", "X,A"],
    "routes": ["route_id,agency_id,route_short_name,route_long_name,route_type,route_desc", "1,a,1,One,3,", "2,a,2,Two,401,"],
    "trips": ["route_id,service_id,trip_id,trip_headsign,trip_short_name,direction_id,shape_id"] + [f"{1 if t[0] == 't' else 2},s,{t},,,," for t in CALLS],
    "stop_times": [TIMES] + [f"{t},{a},{d},{s},{i},,0,0,,,," for t, c in CALLS.items() for i, (s, a, d) in enumerate(c)],
    "transfers": ["from_stop_id,to_stop_id,transfer_type,min_transfer_time,from_trip_id,to_trip_id"],
    "shapes": ["shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled"],
}


def folder(tmp_path, **changed):
    for name, lines in (FILES | changed).items():
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    return f"file://{tmp_path}"


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    return planner.prepare(Feed.from_directory(spark, folder(tmp_path_factory.mktemp("feed"))).network())


@pytest.fixture(scope="module")
def net(ready):
    return ready.net


def ask(spark, ready, start, end, time, mode="departure", **more):
    net = ready.net
    kind = lambda x: "coordinate" if "," in x else "area" if x == "X" else "stop"
    q = spark.createDataFrame([(1, kind(start), start, kind(end), end, mode, time)], "query_id long, from_kind string, from_id string, to_kind string, to_id string, mode string, time_s long")
    plan = planner.plan(ready, q, **more)
    name = {r["stop_idx"]: r["stop_id"] for r in net.stops.collect()}
    trip = {r["trip_idx"]: r["trip_id"] for r in net.trips.collect()}
    legs = [(r["kind"], name[r["from_stop"]], name[r["to_stop"]], trip.get(r["trip_idx"]), r["dep_s"], r["arr_s"]) for r in plan.legs.orderBy("leg_no").collect()]
    return legs, plan


H = lambda t: sum(int(x) * y for x, y in zip(t.split(":"), (3600, 60, 1)))


def test_expected_journeys(spark, ready):
    net = ready.net
    legs, plan = ask(spark, ready, "A", "E", H("07:55:00"))
    assert legs == [("transit", "A", "C", "t1", H("08:00:00"), H("08:20:00")), ("walk", "C", "D", None, H("08:20:00"), H("08:23:13")), ("transit", "D", "E", "u2", H("08:40:00"), H("08:50:00"))]
    assert plan.leg_stops(net).count() == 5 and plan.itineraries().first()["arrival_s"] == H("08:50:00")
    legs, plan = ask(spark, ready, "A", "E", H("07:55:00"), allow_walk=False)
    assert legs == [] and plan.status().first()["status"] == "no_route"
    legs, _ = ask(spark, ready, "A", "E", H("08:50:00"), mode="arrival")
    assert legs == [("transit", "A", "C", "t1", H("08:00:00"), H("08:20:00")), ("walk", "C", "D", None, H("08:36:47"), H("08:40:00")), ("transit", "D", "E", "u2", H("08:40:00"), H("08:50:00"))]
    assert ask(spark, ready, "C", "D", 0)[0] == []
    assert ask(spark, ready, "A", "C", H("08:00:01"))[0] == [("transit", "A", "C", "t2", H("08:30:00"), H("08:50:00"))]
    legs, plan = ask(spark, ready, "59.0,18.0", "B", H("08:00:00"))
    assert legs == [("transit", "A", "B", "t1", H("08:00:00"), H("08:10:00"))] and plan.leg_stops(net).count() == 2


def test_feed_from_archives_and_errors(spark, net, tmp_path):
    (tmp_path / "f").mkdir()
    at = folder(tmp_path / "f")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n in FILES:
            z.write(tmp_path / "f" / f"{n}.txt", f"{n}.txt")
    for feed in (Feed.from_zip(spark, str(tmp_path / "z.zip")), Feed.from_zip_cache(spark, str(tmp_path / "z.zip")), Feed.from_zip_cache(spark, str(tmp_path / "z.zip"))):
        assert feed.network().stop_times.count() == 10
    assert (tmp_path / "z").is_dir() and Feed(spark, at).age().count() == 8
    (tmp_path / "f" / "areas.txt").unlink()
    with pytest.raises(MissingFile):
        Feed(spark, at).scan("areas")
    with pytest.raises(FeedError):
        Feed(spark, folder(tmp_path / "f", areas=["area_id,area_name,samtrafiken_area_type,new"])).scan("areas")
    assert Feed(spark, at, strict=False).scan("areas").count() == 0
    bad = Feed(spark, folder(tmp_path / "f", stop_areas=["area_id,stop_id", "X,none"]))
    with pytest.raises(DanglingKey):
        bad.network()
    assert bad.network(strict=False).stop_areas.count() == 0
    with pytest.raises(BadArchive):
        Feed.from_zip(spark, str(tmp_path / "f" / "stops.txt"))
    with pytest.raises(BadArchive):
        Feed.from_url(spark, f"file://{tmp_path}/none.zip")
    assert Feed.from_url(spark, f"file://{tmp_path}/z.zip").network().stop_times.count() == 10
    row = "A,B,0,sixty,,"
    with pytest.raises(BadRow):
        Feed(spark, folder(tmp_path / "f", transfers=[FILES["transfers"][0], row])).checked("transfers")
    with pytest.raises(DanglingKey):
        Feed(spark, folder(tmp_path / "f", transfers=[FILES["transfers"][0], "A,B,0,60,t1,none"])).network()
    trips = [FILES["trips"][0], "1,s,t1,Centre,,,", *FILES["trips"][2:]]
    net = Feed(spark, folder(tmp_path / "f", trips=trips, transfers=[FILES["transfers"][0], "A,B,0,60,t1,", "A,C,0,,,"])).network()
    assert {(r["from_id"], r["to_id"], r["from_trip_id"], r["to_trip_id"]) for r in net.transfers_resolved.collect()} == {("A", "B", "t1", None), ("A", "C", None, None)}
    assert {r["trip_id"]: r["head_sign"] for r in net.trips.collect()}["t1"] == "Centre"
    (tmp_path / "f" / "agency.txt").write_text("agency_id,agency_name,agency_url,agency_timezone,agency_lang\na,A,u,UTC,en\n")
    assert Feed(spark, at).scan("agency").first()["agency_name"] == "A"


def test_requests_in_strings(spark, ready):
    kinds = "query_id long, from string, to string, departure_at string, arrive_at string, allow_walk boolean, shapes boolean"
    asked = [
        (1, "A", "E", "07:55:00", None, None, None), (2, "A", "E", "07:55:00", None, False, True), (3, "A", "E", "00:00:00", "08:50:00", True, True), (4, "59.0, 18.0", "X", "08:00:00", None, None, None),
        (5, "none", "E", "08:00:00", None, None, None), (6, "A", "1,x", "08:00:00", None, None, None), (7, "A", None, "08:00:00", None, None, None), (8, "A", "E", "eight", None, None, None), (9, "X", "B", "bad", "08:10:00", None, None),
    ]
    found = {r["query_id"]: r for r in service.route(ready, spark.createDataFrame(asked, kinds)).collect()}
    assert {i: r["status"] for i, r in found.items()} == {1: "ok", 2: "no_route", 3: "ok", 4: "no_route", 5: "unknown_location", 6: "unknown_location", 7: "missing_location", 8: "bad_time", 9: "no_route"}
    one = found[1]
    assert (one["from"]["name"], one["to"]["id"], one["departure_s"], one["arrival_s"]) == ("Stop A", "E", H("08:00:00"), H("08:50:00"))
    assert [(g["mode"], g["from"]["id"], g["to"]["id"], [c["location"]["id"] for c in g["stops"]], g["long_name"], g["shapes"]) for g in one["legs"]] == [("Bus", "A", "C", ["A", "B", "C"], "One", None), ("Walk", "C", "D", [], None, None), ("Subway", "D", "E", ["D", "E"], "Two", None)]
    assert found[3]["arrival_s"] == H("08:50:00") and service.route(ready, spark.createDataFrame(asked[4:5], kinds)).first()["status"] == "unknown_location"
    now = service.route(ready, spark.createDataFrame([(1, "C", "A")], "query_id long, from string, to string")).first()
    assert now["status"] == "no_route"


def test_search_and_proximity(spark, net):
    assert [r["stop_id"] for r in service.search_stops(net, "stop c", 1).collect()] == ["C"]
    assert service.search_areas(net, "area").first()["area_id"] == "X"
    assert [r["stop_id"] for r in service.near_stops(net, "59.2,18.0").collect()] == ["C", "D"]
    assert [r["stop_id"] for r in service.near_stops(net, "59.2,18.0", 10).collect()] == ["C"]
    assert service.near_areas(net, "59.0,18.0").count() == 1
    with pytest.raises(ValueError):
        service.near_stops(net, "nowhere")
    c = net.stops.where("stop_id = 'C'").first()["stop_idx"]
    assert [r["stop_id"] for r in net.stops_beside(c).collect()] == ["D"]
    at = spark.range(1).select(S.now().alias("s")).first()["s"]
    assert 0 <= at < 86400


def column(spark, f, values, kinds):
    return [r[0] for r in spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {kinds}").orderBy("i").select(f).collect()]


def test_golden_scalars(spark):
    words = [("", "", 0), ("", "abc", 3), ("abc", "", 3), ("kitten", "orange", 6), ("cat", "cut", 1), ("cat", "cart", 1), ("café", "cafe", 1), ("😀😁😂", "😀😂😁", 2), ("abcdef", "zbcdef", 1), ("intention", "execution", 5)]
    assert column(spark, F.levenshtein("a", "b"), [w[:2] for w in words], "a string, b string") == [w[2] for w in words]
    scores = [("", "x", 0), ("a b", "a", 0.5), ("a", "a b", 1), ("a b", "a b", 1), ("ab", "ac", 0.5)]
    assert column(spark, S.fuzzy_score(F.col("a"), F.col("b")), [s[:2] for s in scores], "a string, b string") == [s[2] for s in scores]
    times = [("00:00:00", 0), ("00:01:30", 90), ("01:01:30", 3690), ("00:00:0a", None), ("00:00", None), ("25:10:00", 90600), (" 8:00:00", None), ("1:2:3:4", 3723), (None, None)]
    assert column(spark, S.parse_hms(F.col("a")), [t[:1] for t in times], "a string") == [t[1] for t in times]
    assert column(spark, S.format_hms(F.col("a")), [(0,), (3690,), (90600,), (360000,)], "a long") == ["00:00:00", "01:01:30", "25:10:00", "100:00:00"]
    modes = {"Tram": (0, 900, 999), "Subway": (1, 400, 405), "Rail": (2, 100, 199), "Bus": (3, 700), "Ferry": (4, 1000, 1099), "Unknown": (5, 406)}
    assert column(spark, S.mode(F.col("a")), [(x,) for v in modes.values() for x in v], "a int") == [k for k, v in modes.items() for _ in v]
    (metres,) = column(spark, S.haversine(*(F.lit(x) for x in (48.85801, 2.351435, 51.505238, -0.124954075))), [(1,)], "a int")
    assert abs(metres - 343_080) < 100
    at = column(spark, S.parse_coordinate(F.col("a")), [("59.1, 18.2",), ("1,x, 2",), ("59",), ("a,b",), (None,)], "a string")
    assert [a and (a["lat"], a["lon"]) for a in at] == [(59.1, 18.2), (1, 2), None, None, None]


def test_loops_and_overtaking_trips_make_patterns(spark, tmp_path):
    calls = ["l1,08:00:00,08:00:00,A,0", "l1,08:10:00,08:10:00,B,1", "l1,08:20:00,08:20:00,A,2", "l2,08:05:00,08:05:00,A,5", "l2,08:15:00,08:15:00,B,9"]
    at = folder(tmp_path, stop_times=[TIMES] + [f"{c},,0,0,,,," for c in calls], trips=[FILES["trips"][0], "1,s,l1,,,,", "1,s,l2,,,,"])
    net = Feed(spark, at).network()
    assert net.raptor_routes.count() == 2 and net.route_raptors.first()["n_raptors"] == 2
    assert ask(spark, planner.prepare(net), "B", "A", H("08:00:00"))[0] == [("transit", "B", "A", "l1", H("08:10:00"), H("08:20:00"))]


def test_prepared_trips_are_those_that_are_ever_boarded(spark, tmp_path):
    rng, clock = random.Random(7), lambda s: f"{s // 3600:02d}:{s // 60 % 60:02d}:00"
    trips = []
    for _ in range(60):  # some overtake others, some call at the same second
        at = [28800 + 60 * rng.randrange(200)]
        at += [at[0] + 60 * rng.randrange(1, 40)]
        trips.append([*at, at[1] + 60 * rng.randrange(1, 40)])
    trips += [trips[0]] * 9
    times = [f"q{i:02d},{clock(a)},{clock(a)},{s},{n},,0,0,,,," for i, t in enumerate(trips) for n, (s, a) in enumerate(zip("ABC", t))]
    at = folder(tmp_path, stop_times=[TIMES, *times], trips=[FILES["trips"][0], *(f"1,s,q{i:02d},,,," for i in range(len(trips)))])
    net = Feed(spark, at).network()
    ready = planner.prepare(net)
    calls = net.timed_trips.select("trip_rank", "trip_idx", F.explode("calls").alias("c")).select("trip_rank", "trip_idx", "c.pos", "c.arr").collect()
    ranks = {}
    for c in calls:
        ranks.setdefault((c["pos"], c["arr"]), []).append(c["trip_rank"])
    ends = {f(r) for r in ranks.values() for f in (min, max)}
    kept = {r["trip_rank"]: r["trip_idx"] for r in ready.trips.collect()}
    assert set(kept) == ends and len(kept) < len(trips) and kept == {c["trip_rank"]: c["trip_idx"] for c in calls if c["trip_rank"] in ends}
    assert ready.boards.where(F.size(F.array_distinct("trips.board")) < F.size("trips")).count() == 0
    asked = ready.places.crossJoin(spark.range(28000, 50000, 150).withColumnRenamed("id", "s")).withColumn("t", F.when(F.col("mode") == "departure", F.col("s")).otherwise(-F.col("s")))
    got = {(r["mode"], abs(r["pos"]), abs(r["t"])): abs(r["trip_rank"]) for r in planner.next_trip(asked, ready.boards).collect()}
    want = {}
    for mode, pick, fits in (("departure", min, lambda a, t: a >= t), ("arrival", max, lambda a, t: a <= t)):
        for pos in range(3):
            for t in range(28000, 50000, 150):
                if left := [c["trip_rank"] for c in calls if c["pos"] == pos and fits(c["arr"], t)]:
                    want[mode, pos, t] = pick(left)
    assert got == want


def test_names_of_legs_are_sought_for_their_trips_only(spark, ready):
    _, plan = ask(spark, ready, "A", "E", H("07:55:00"))
    named = plan.named_legs()
    assert [(r["kind"], r["long_name"], r["mode"]) for r in named.orderBy("leg_no").collect()] == [("transit", "One", "Bus"), ("walk", None, "Walk"), ("transit", "Two", "Subway")]
    assert "LeftSemi" in named._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert differs(spark, connect(sf), sf, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) is None


def test_journeys_hold_together(spark, sf):
    net = catalog.prepared(spark, sf)
    n = net.net
    calls = n.stop_times.select("trip_idx", "pos", "stop_idx", "arr", "dep").collect()
    at = {(r["trip_idx"], r["pos"]): (r["stop_idx"], r["arr"], r["dep"]) for r in calls}
    for mode, time in (("departure", 28800), ("arrival", 61200)):
        legs = planner.plan(net, catalog.questions(n, mode, 8, time)).legs.orderBy("query_id", "leg_no").collect()
        assert legs
        for a, b in zip(legs, legs[1:]):
            if a["query_id"] == b["query_id"]:
                assert a["to_stop"] == b["from_stop"] and a["arr_s"] <= b["dep_s"]
        for r in legs:
            if r["kind"] == "transit":
                on, off = at[r["trip_idx"], r["from_place"]], at[r["trip_idx"], r["to_place"]]
                assert on[0] == r["from_stop"] and off[0] == r["to_stop"] and r["dep_s"] in on[1:] and r["arr_s"] in off[1:]


@pytest.mark.parametrize("mode, time", [("departure", 28800), ("arrival", 61200)])
def test_pruning_leaves_the_answers(spark, sf, mode, time):
    n = catalog.prepared(spark, sf)
    a, b = (planner.plan(n, catalog.questions(n.net, mode, 10, time), prune=p).best.orderBy("query_id").collect() for p in (True, False))
    assert a == b and len(a) == 10


def test_stream_of_questions(spark, ready, tmp_path):
    row = [(1, "stop", "A", "stop", "E", "departure", H("07:55:00"))]
    q = spark.createDataFrame(row, "query_id long, from_kind string, from_id string, to_kind string, to_id string, mode string, time_s long")
    q.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in")
    run = answer_stream(ready, stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True)
    run.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_the_rest_stands_without_the_llm_folders(monkeypatch):
    for m in [m for m in sys.modules if m.startswith(("waylark.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "waylark.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(catalog.QUERIES)
    sys.modules.pop("__spark_entry__")
