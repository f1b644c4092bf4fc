"""The test road network, derived by Spark from the driver's tables.

The reference reads its map from text files that are not public; FIXTURES.md §2
defines an equivalent network over ``part`` (junctions, roads) and ``events``
(trajectory records).  Everything here is a lazy DataFrame plan over the two
parquet tables, so the work grows with them.  ``sources.text`` reads the same
tables from the reference's text layouts.

Tables (all lazy):
  junctions  node BIGINT, lon DOUBLE, lat DOUBLE
  roads      road_id STRING, a BIGINT, b BIGINT, km DOUBLE, secs DOUBLE, oneway BOOLEAN,
             xa, ya, xb, yb DOUBLE                       (a = first point, b = last point)
  edges      src BIGINT, dst BIGINT, road_id STRING, secs DOUBLE   (point topology, directed)
  adj        road_id STRING, nbr STRING, secs DOUBLE               (road topology, secs of nbr)
  records    event_id BIGINT, user_id BIGINT, ts TIMESTAMP, road_id STRING ('0' = unmatched)
  gps        event_id, user_id, ts, road_id, lon DOUBLE, lat DOUBLE (records on a known road)
  grid       cell STRING, road_id STRING, lonlats ARRAY<STRING>     (geohash-7 grid index)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.geohash import geohash7
from wayfold.session import spread

# Fixed values of the fixture network (FIXTURES.md §2): grid width, origin and
# spacing of the junction lattice, length formula terms, one-way rule, GPS rule.
GRID_WIDTH = 40
LON0 = 108.90
LAT0 = 34.20
STEP = 0.005
KM_BASE = 0.2
KM_SIZE_DIV = 50.0
KM_HASH_MUL = 7919
KM_HASH_MOD = 1009
KM_HASH_DIV = 100000.0
VERTICAL_OFFSET = 500
ONEWAY_MOD = 7
GRID_POINTS = 20  # 21 points at fractions i/20 along each road


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fmt_point(lon: Column, lat: Column) -> Column:
    """Text form of a point, as in the reference's map files: ``lon,lat``."""
    return F.format_string("%.6f,%.6f", lon, lat)


def road_seconds(km: Column) -> Column:
    """Road travel time at 60 km/h rounded to 3 decimals (HALF_UP)."""
    return F.round(km * 3600.0 / 60.0, 3)


def edge_seconds(km: Column) -> Column:
    """Edge travel time at 60 km/h, not rounded (as in the point topology)."""
    return km * 60.0


@dataclass(frozen=True)
class Network:
    junctions: DataFrame
    roads: DataFrame
    edges: DataFrame
    adj: DataFrame
    records: DataFrame
    gps: DataFrame
    grid: DataFrame


def part_count(part: DataFrame) -> int:
    """Number of junctions, evaluated once as a plain value (answered from the
    parquet footers).  As a literal it folds into every derived expression; as a
    scalar subquery it would be re-planned in each of the many plans using it."""
    return int(part.count())


def _lon(k: Column) -> Column:
    return F.lit(LON0) + F.lit(STEP) * (k % GRID_WIDTH)


def _lat(k: Column) -> Column:
    return F.lit(LAT0) + F.lit(STEP) * F.floor(k / GRID_WIDTH)


def _km(k: Column, size: Column, offset: int) -> Column:
    return (
        F.lit(KM_BASE)
        + size / F.lit(KM_SIZE_DIV)
        + ((k * KM_HASH_MUL + offset) % KM_HASH_MOD) / F.lit(KM_HASH_DIV)
    )


def build_roads(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    size = F.col("p_size")
    n = part_count(part)
    base = part.select(k, size)
    horizontal = base.where(((k % GRID_WIDTH) < GRID_WIDTH - 1) & (k + 1 < n)).select(
        (k * 2 + 1).cast("string").alias("road_id"),
        k.alias("a"),
        (k + 1).alias("b"),
        _km(k, size, 0).alias("km"),
        ((size % ONEWAY_MOD) == 0).alias("oneway"),
    )
    vertical = base.where(k + GRID_WIDTH < n).select(
        (k * 2 + 2).cast("string").alias("road_id"),
        k.alias("a"),
        (k + GRID_WIDTH).alias("b"),
        _km(k, size, VERTICAL_OFFSET).alias("km"),
        F.lit(False).alias("oneway"),
    )
    a, b = F.col("a"), F.col("b")
    return horizontal.unionByName(vertical).select(
        "road_id",
        "a",
        "b",
        "km",
        road_seconds(F.col("km")).alias("secs"),
        "oneway",
        _lon(a).alias("xa"),
        _lat(a).alias("ya"),
        _lon(b).alias("xb"),
        _lat(b).alias("yb"),
    )


def build_edges(roads: DataFrame) -> DataFrame:
    """Directed point-topology edges: a->b always, b->a unless one-way."""
    fwd = roads.select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "road_id", edge_seconds(F.col("km")).alias("secs")
    )
    back = roads.where(~F.col("oneway")).select(
        F.col("b").alias("src"), F.col("a").alias("dst"), "road_id", edge_seconds(F.col("km")).alias("secs")
    )
    return fwd.unionByName(back)


def road_ends(roads: DataFrame) -> DataFrame:
    """(road_id, end_no, node): end 1 = first point a, end 2 = last point b."""
    return roads.select(
        "road_id",
        F.explode(F.array(F.struct(F.lit(1).alias("end_no"), F.col("a").alias("node")),
                          F.struct(F.lit(2).alias("end_no"), F.col("b").alias("node")))).alias("e"),
    ).select("road_id", "e.end_no", "e.node")


def build_adj(roads: DataFrame) -> DataFrame:
    """Road topology: roads sharing a junction (one-way ignored), with the
    neighbour's rounded seconds.  Each junction joins only its own few roads."""
    ends = road_ends(roads)
    nbr = ends.select(F.col("road_id").alias("nbr"), F.col("node"))
    secs = roads.select(F.col("road_id").alias("nbr"), "secs")
    return (
        ends.join(nbr, "node")
        .where(F.col("road_id") != F.col("nbr"))
        .select("road_id", "nbr")
        .distinct()
        .join(secs, "nbr")
        .select("road_id", "nbr", "secs")
    )


def build_records(events: DataFrame, part: DataFrame) -> DataFrame:
    n = part_count(part)
    rid = (F.lit(1) + (F.col("user_id") * 31 + F.col("event_id") * 17) % (n * 2)).cast("string")
    return events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_type") == "error", F.lit("0")).otherwise(rid).alias("road_id"),
    )


def build_gps(records: DataFrame, roads: DataFrame) -> DataFrame:
    """A GPS point per record on a known road: at fraction f along the road,
    shifted across it by a small offset."""
    eid = F.col("event_id")
    f = (eid * 13 % 97) / F.lit(96.0)
    off = ((eid % 21) - 10) * F.lit(0.00005)
    vertical = F.col("xa") == F.col("xb")
    lon = F.col("xa") + (F.col("xb") - F.col("xa")) * f + F.when(vertical, off).otherwise(F.lit(0.0))
    lat = F.col("ya") + (F.col("yb") - F.col("ya")) * f + F.when(vertical, F.lit(0.0)).otherwise(off)
    return (
        records.where(F.col("road_id") != "0")
        .join(roads.select("road_id", "xa", "ya", "xb", "yb"), "road_id")
        .select("event_id", "user_id", "ts", "road_id", lon.alias("lon"), lat.alias("lat"))
    )


def build_grid(roads: DataFrame) -> DataFrame:
    """Geohash-7 grid index: 21 points along each road -> (cell, road, points in the cell).

    Roads are dealt by their id before they become points, so the points are grouped where they are."""
    i = F.col("i")
    frac = i / F.lit(float(GRID_POINTS))
    pts = spread(roads.select("road_id", "xa", "ya", "xb", "yb"), "road_id").select(
        "road_id", "xa", "ya", "xb", "yb", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS))).alias("i")
    ).select(
        "road_id",
        "i",
        (F.col("xa") + (F.col("xb") - F.col("xa")) * frac).alias("lon"),
        (F.col("ya") + (F.col("yb") - F.col("ya")) * frac).alias("lat"),
    )
    return (
        pts.select("road_id", "i", geohash7(F.col("lon"), F.col("lat")).alias("cell"),
                   fmt_point(F.col("lon"), F.col("lat")).alias("pt"))
        .groupBy("cell", "road_id")
        .agg(F.array_sort(F.collect_list(F.struct("i", "pt"))).alias("pts"))
        .select("cell", "road_id", F.transform("pts", lambda s: s["pt"]).alias("lonlats"))
    )


def load_network(spark: SparkSession, sf_dir: str) -> Network:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    n = part_count(part)
    k = F.col("p_partkey")
    junctions = part.select(k.alias("node"), _lon(k).alias("lon"), _lat(k).alias("lat")).where(k < n)
    roads = build_roads(part)
    records = build_records(events, part)
    return Network(
        junctions=junctions,
        roads=roads,
        edges=build_edges(roads),
        adj=build_adj(roads),
        records=records,
        gps=build_gps(records, roads),
        grid=build_grid(roads),
    )
