"""The synthetic transit network over the driver's tables; each statement is valid in Spark SQL and in DuckDB."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "g_stops": """
SELECT CAST(s.s_suppkey AS BIGINT) AS stop_idx, concat('S', CAST(s.s_suppkey AS STRING)) AS stop_id, p.p_name AS stop_name,
  59.0 + CAST(s.s_suppkey % 10 AS DOUBLE) * 0.0025 AS lat, 18.0 + CAST(floor(s.s_suppkey / 10.0) AS DOUBLE) * 0.005 AS lon,
  CAST(1000000 + s.s_nationkey AS BIGINT) AS parent_idx
FROM supplier s JOIN part p ON p.p_partkey = s.s_suppkey
UNION ALL
SELECT CAST(1000000 + n_nationkey AS BIGINT), concat('N', CAST(n_nationkey AS STRING)), n_name,
  59.0 + CAST(n_nationkey % 5 AS DOUBLE) * 0.005, 18.0 + CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 0.01, CAST(NULL AS BIGINT)
FROM nation
""",
    "g_areas": """
SELECT CAST(r_regionkey AS BIGINT) AS area_idx, concat('A', CAST(r_regionkey AS STRING)) AS area_id, r_name AS area_name FROM region
""",
    "g_stop_areas": """
SELECT CAST(n_regionkey AS BIGINT) AS area_idx, CAST(1000000 + n_nationkey AS BIGINT) AS stop_idx FROM nation
""",
    "g_routes": """
SELECT r AS route_idx, concat('R', CAST(r AS STRING)) AS route_id, concat('Line ', CAST(r AS STRING)) AS long_name,
  CAST(r AS STRING) AS short_name,
  CASE r % 7 WHEN 0 THEN 0 WHEN 1 THEN 401 WHEN 2 THEN 2 WHEN 3 THEN 700 WHEN 4 THEN 1000 WHEN 5 THEN 5 ELSE 3 END AS route_type
FROM (SELECT CAST(n_nationkey AS BIGINT) AS r FROM nation) t
""",
    "g_trips": """
SELECT CAST(o_orderkey AS BIGINT) AS trip_idx, concat('T', CAST(o_orderkey AS STRING)) AS trip_id,
  CAST(o_orderkey % 25 AS BIGINT) AS route_idx, 18000 + CAST((o_orderkey * 7919) % 57600 AS BIGINT) AS start_s
FROM orders
""",
    "g_stop_times": """
SELECT t.trip_idx, t.route_idx, j.p AS pos,
  (t.route_idx * 13 + j.p * (CASE t.route_idx % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 9 END)) % n.n AS stop_idx,
  t.start_s + j.p * 150 AS arr, t.start_s + j.p * 150 + 30 AS dep, CAST(j.p AS DOUBLE) * 400.0 AS dist_m
FROM g_trips t
CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM supplier) n
CROSS JOIN (SELECT CAST(l_linenumber AS BIGINT) - 1 AS p FROM lineitem GROUP BY l_linenumber) j
""",
    "g_transfers": """
SELECT CAST(s_suppkey AS BIGINT) AS from_stop_idx, (s_suppkey * 3 + 5) % n.n AS to_stop_idx,
  CASE WHEN s_suppkey % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE 60 + CAST(s_suppkey % 5 AS BIGINT) * 30 END AS min_transfer_s
FROM supplier CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM supplier) n
WHERE s_suppkey % 2 = 0
""",
    "g_shapes": """
SELECT DISTINCT st.route_idx AS shape_idx, st.pos + 1 AS seq, s.lat, s.lon, st.dist_m
FROM g_stop_times st JOIN g_stops s ON s.stop_idx = st.stop_idx
""",
}


TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem")
#: What the views lack: head signs of two trips in three, and trips that some transfers are for.
HEAD_SIGN = "CASE WHEN trip_idx % 3 <> 0 THEN concat('Towards R', CAST(route_idx AS STRING)) END"
FOR_TRIPS = {"from_trip_idx": "CASE WHEN from_stop_idx % 3 = 0 THEN from_stop_idx END", "to_trip_idx": "CASE WHEN to_stop_idx % 5 = 0 THEN to_stop_idx END"}


def network(spark, sf_dir: str):
    """The network of the driver's tables in sf_dir."""
    from waylark.operators.network import Network

    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    frames = {}
    for name, sql in VIEWS.items():
        frames[name.removeprefix("g_")] = df = spark.sql(sql)
        df.createOrReplaceTempView(name)
    frames["trips"] = frames["trips"].selectExpr("*", "route_idx AS shape_idx", f"{HEAD_SIGN} AS head_sign")
    frames["transfers"] = frames["transfers"].selectExpr("*", *(f"{sql} AS {name}" for name, sql in FOR_TRIPS.items()))
    return Network(**frames)


def version(spark, sf_dir: str) -> tuple:
    """The application, the folder, and when the tables of the network there were written."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    at = [path(f"{sf_dir}/{t}.parquet") for t in TABLES]
    return (spark.sparkContext.applicationId, sf_dir, *(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in at))


def with_views(sql: str) -> str:
    """The statement with the views it needs, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({s.strip()})" for n, s in VIEWS.items()) + f"\n{sql}"
