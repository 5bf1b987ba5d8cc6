"""Schedule feeds of CSV files in a folder or a zip archive, as a Network."""

from __future__ import annotations

import os
import shutil
import tempfile
import urllib.request
import uuid
import zipfile
from contextlib import contextmanager
from dataclasses import dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.network import Network
from waylark.tables import shared_root

#: Columns of the files; a question mark for one that may be blank.
SCHEMAS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type? tinyint, parent_station? string, platform_code? string",
    "areas": "area_id string, area_name string, samtrafiken_area_type string",
    "stop_areas": "area_id string, stop_id string",
    "routes": "route_id string, agency_id string, route_short_name? string, route_long_name? string, route_type int, route_desc? string",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign? string, trip_short_name? string, direction_id? tinyint, shape_id? string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, stop_headsign? string, pickup_type tinyint, drop_off_type tinyint, shape_dist_traveled? double, timepoint? tinyint, pickup_booking_rule_id? string, drop_off_booking_rule_id? string",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type string, min_transfer_time? int, from_trip_id? string, to_trip_id? string",
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_fare_url? string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, shape_dist_traveled? double",
}


class FeedError(ValueError):
    """A feed that can't be read as it should."""


class MissingFile(FeedError):
    pass


class BadArchive(FeedError):
    """An archive that can't be opened or is none."""


class BadRow(FeedError):
    """A row that isn't of its file's columns."""


class DanglingKey(FeedError):
    """A key that refers to no row, in strict loading."""


@dataclass(frozen=True)
class Config:
    """Names of the files."""

    stops: str = "stops.txt"
    areas: str = "areas.txt"
    stop_areas: str = "stop_areas.txt"
    routes: str = "routes.txt"
    trips: str = "trips.txt"
    stop_times: str = "stop_times.txt"
    transfers: str = "transfers.txt"
    shapes: str = "shapes.txt"
    agency: str = "agency.txt"  # not part of a network


def unzip(spark: SparkSession, path: str, to: str | None = None) -> str:
    """Unpacks an archive into a folder that executors share, a file at a time. With `to`, that folder is used, and kept if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = to or f"{shared_root(spark)}/feed-{os.path.basename(path)}-{uuid.uuid4().hex[:12]}"
    at = jvm.org.apache.hadoop.fs.Path(to)
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        return to
    part = jvm.org.apache.hadoop.fs.Path(f"{to}-{uuid.uuid4().hex[:12]}")  # no half unpacked folder is ever found
    try:
        with zipfile.ZipFile(path) as z:
            fs.mkdirs(part)
            for name in (n for n in z.namelist() if not n.endswith("/")):
                with tempfile.TemporaryDirectory() as local:
                    held = f"{local}/{os.path.basename(name)}"
                    with z.open(name) as source, open(held, "wb") as target:
                        shutil.copyfileobj(source, target, 1 << 20)
                    fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{held}"), part)
    except (OSError, zipfile.BadZipFile) as e:
        raise BadArchive(f"{path}: {e}") from e
    fs.rename(part, at)
    return to


@contextmanager
def told_rows():
    """Says of Spark's error about a malformed row that it is one of the feed."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        told = next((line for line in str(e).splitlines() if "MALFORMED" in line), None)
        if told is None:
            raise
        raise BadRow(told.strip()) from e


class Feed:
    """A feed's files as DataFrames. Columns go by name; with strict, a column that isn't known is an error, as is one missing."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config(), strict: bool = True):
        self.spark, self.folder, self.config, self.strict = spark, folder.rstrip("/"), config, strict

    @classmethod
    def from_directory(cls, spark: SparkSession, path: str, **more) -> Feed:
        return cls(spark, path, **more)

    @classmethod
    def from_zip(cls, spark: SparkSession, path: str, **more) -> Feed:
        return cls(spark, unzip(spark, path), **more)

    @classmethod
    def from_zip_cache(cls, spark: SparkSession, path: str, **more) -> Feed:
        """Unpacked once: beside the archive in local mode, on a cluster in the shared folder, by the archive's name and time."""
        if spark.sparkContext.master.startswith("local"):
            to = "file://" + os.path.splitext(os.path.abspath(path))[0]
        else:
            to = f"{shared_root(spark)}/feeds/{os.path.basename(path)}-{int(os.path.getmtime(path))}"
        return cls(spark, unzip(spark, path, to), **more)

    @classmethod
    def from_url(cls, spark: SparkSession, url: str, **more) -> Feed:
        """A feed whose archive is fetched first."""
        with tempfile.TemporaryDirectory() as local:
            held = f"{local}/feed.zip"
            try:
                with urllib.request.urlopen(url) as source, open(held, "wb") as target:
                    shutil.copyfileobj(source, target, 1 << 20)
            except OSError as e:
                raise BadArchive(f"{url}: {e}") from e
            return cls(spark, unzip(spark, held), **more)

    def checked(self, table: str) -> DataFrame:
        """A file's rows, all of which have been read once: a malformed one is an error here, not later."""
        df = self.scan(table)
        with told_rows():
            df.write.format("noop").mode("overwrite").save()
        return df

    def scan(self, table: str) -> DataFrame:
        path = f"{self.folder}/{getattr(self.config, table)}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise MissingFile(path)
        head = self.spark.read.option("header", True).csv(path).columns
        known = {c.split()[0].rstrip("?"): (c.split()[1], c.split()[0].endswith("?")) for c in SCHEMAS[table].split(", ")}
        lost = [c for c, (_, blank) in known.items() if c not in head and not blank]
        more = [c for c in head if c not in known]
        if lost or (more and self.strict):
            raise FeedError(f"{path}: missing columns {lost}, unknown columns {more}")
        schema = ", ".join(f"`{c}` {known[c][0] if c in known else 'string'}" for c in head)
        df = self.spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
        return df.select(*(F.col(c) if c in head else F.lit(None).cast(kind).alias(c) for c, (kind, _) in known.items()))

    def age(self) -> DataFrame:
        """file, age_s: seconds since each file was modified."""
        files = self.spark.read.format("binaryFile").load(f"{self.folder}/*.txt").select("path", "modificationTime")
        return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.unix_timestamp() - F.unix_timestamp("modificationTime")).alias("age_s"))

    def network(self, strict: bool = True) -> Network:
        """The feed as a network. Surrogate keys are 64-bit hashes of the ids, which needs no global order. strict: a dangling key is an error, else its rows go."""
        numbered = lambda df, key, idx: df.select(key, F.xxhash64(key).alias(idx)).where(F.col(key).isNotNull()).distinct()
        raw = {f.name: self.scan(f.name) for f in fields(Config) if f.name != "agency"}
        s, a, r, t, h = (numbered(raw[n], k, i) for n, k, i in (("stops", "stop_id", "stop_idx"), ("areas", "area_id", "area_idx"), ("routes",
            "route_id", "route_idx"), ("trips", "trip_id", "trip_idx"), ("shapes", "shape_id", "shape_idx")))
        how = "left" if strict else "inner"
        parent = s.select(F.col("stop_id").alias("parent_station"), F.col("stop_idx").alias("parent_idx"))
        trips = raw["trips"].join(t, "trip_id").join(r, "route_id", how).join(h, "shape_id", "left")
        times = raw["stop_times"].join(trips.select("trip_id", "trip_idx", "route_idx"), "trip_id", how).join(s, "stop_id", how)
        pos = F.row_number().over(Window.partitionBy("trip_idx").orderBy("stop_sequence")) - 1
        transfers = raw["transfers"]
        for x in ("from", "to"):
            transfers = transfers.join(s.select(F.col("stop_id").alias(f"{x}_stop_id"), F.col("stop_idx").alias(f"{x}_stop_idx")), f"{x}_stop_id", how)
            transfers = transfers.join(t.select(F.col("trip_id").alias(f"{x}_trip_id"), F.col("trip_idx").alias(f"{x}_trip_idx")), f"{x}_trip_id", "left")
        # a trip that a transfer is for may be left out, but not be unknown
        lost = " or ".join(f"({x}_trip_id is not null and {x}_trip_idx is null)" for x in ("from", "to"))
        net = Network(
            stops=raw["stops"].join(s, "stop_id").join(parent, "parent_station", "left").select("stop_idx", "stop_id", "stop_name", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"), "parent_idx"),
            areas=raw["areas"].join(a, "area_id").select("area_idx", "area_id", "area_name"),
            stop_areas=raw["stop_areas"].join(a, "area_id", how).join(s, "stop_id", how).select("area_idx", "stop_idx"),
            routes=raw["routes"].join(r, "route_id").select("route_idx", "route_id", F.col("route_long_name").alias("long_name"), F.col("route_short_name").alias("short_name"), "route_type"),
            trips=trips.select("trip_idx", "trip_id", "route_idx", "shape_idx", F.col("trip_headsign").alias("head_sign")),
            stop_times=times.select("trip_idx", "route_idx", pos.cast("long").alias("pos"), "stop_idx", S.parse_hms(F.col("arrival_time")).alias("arr"), S.parse_hms(F.col("departure_time")).alias("dep"), F.col("shape_dist_traveled").alias("dist_m")),
            transfers=(transfers if strict else transfers.where(f"not ({lost})")).select("from_stop_idx", "to_stop_idx", F.col("min_transfer_time").cast("long").alias("min_transfer_s"), "from_trip_idx", "to_trip_idx"),
            shapes=raw["shapes"].join(h, "shape_id").select("shape_idx", F.col("shape_pt_sequence").cast("long").alias("seq"), F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon"), F.col("shape_dist_traveled").alias("dist_m")),
        )
        if not strict:
            return net
        with told_rows():
            for name, key in (("trips", "route_idx"), ("stop_areas", "area_idx"), ("stop_areas", "stop_idx"), ("stop_times", "trip_idx"),
                ("stop_times", "stop_idx"), ("transfers", "from_stop_idx"), ("transfers", "to_stop_idx")):
                if not getattr(net, name).where(F.col(key).isNull()).isEmpty():
                    raise DanglingKey(f"{name}: a dangling {key}")
            if not transfers.where(lost).isEmpty():
                raise DanglingKey("transfers: a dangling trip")
        return net
