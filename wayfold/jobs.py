"""The three jobs of the reference, run from its text files to its text results.

``load_map`` reads the map files; points are their text (``lon,lat``), so nodes are strings.  Each job scans
trajectory lines, answers all of them and writes one line for each route in its own layout:

  ucs    ``cost:r1,r2,...``           cost with three decimals
  tcsp   ``head road<TAB>r1,r2,...``  keyed by the record's road
  pairs  ``r1,r2,...``                one path a line

Results are dealt and sorted by the head road, so that one file holds all routes of a head road, and are swapped in
whole: they are written beside the target, which is replaced only when all of them are there.  The count of routes is
taken in the pass that writes them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import pairs, reach, ucs
from wayfold.operators.routes import format_cost
from wayfold.operators.spatial_jobs import DEFAULT_RADIUS_M, roads_within_distance
from wayfold.sources import text
from wayfold.tables import file_system


@dataclass(frozen=True)
class RoadMap:
    """roads (road_id, km, secs, a, b, xa, ya, xb, yb), edges (src, dst, road_id, secs), adj (road_id, nbr, secs), bad lines."""

    roads: DataFrame
    edges: DataFrame
    adj: DataFrame
    bad: DataFrame


def _ordinates(point: str, x: str, y: str) -> list[Column]:
    part = F.split(F.col(point), ",")
    return [F.get(part, 0).try_cast("double").alias(x), F.get(part, 1).try_cast("double").alias(y)]


def load_map(spark: SparkSession, roads: str, points: str, topology: str) -> RoadMap:
    """The map from its road attribute, point topology and road topology files; the last line of a key counts."""
    attrs, graph, topo = text.scan_road_attrs(spark, roads), text.scan_point_topology(spark, points), text.scan_road_topology(spark, topology)
    own = attrs.rows.select("road_id", "km", "secs", F.col("p_first").alias("a"), F.col("p_last").alias("b"), *_ordinates("p_first", "xa", "ya"), *_ordinates("p_last", "xb", "yb"))
    neighbours = text.road_topology_adj(topo.rows).select("road_id", "nbr").distinct()
    adj = neighbours.join(own.select(F.col("road_id").alias("nbr"), "secs"), "nbr").select("road_id", "nbr", "secs")
    return RoadMap(own, graph.rows, adj, reduce(DataFrame.unionByName, [attrs.bad, graph.bad, topo.bad]))


def records(spark: SparkSession, path: str) -> text.Scan:
    """(event_id, user_id, road_id) of the trajectory lines."""
    scan = text.scan_trajectory(spark, path)
    return text.Scan(scan.rows.select(F.col("rec_id").alias("event_id"), F.col("traj_id").alias("user_id"), "road_id"), scan.bad)


#: Line of a route in each layout, from columns start_road, cost, route.
LAYOUTS = {
    "ucs": lambda: F.concat(format_cost(F.col("cost")), F.lit(":"), F.array_join("route", ",")),
    "tcsp": lambda: F.concat(F.col("start_road"), F.lit("\t"), F.array_join("route", ",")),
    "pairs": lambda: F.array_join("route", ","),
}


def write_routes(results: DataFrame, path: str, layout: str) -> int:
    """Write the lines of ``results`` (start_road, cost, route) to ``path`` and return their number.

    The count is observed where the rows are written, in the tasks whose output is committed, so a task that is run again
    counts once.  A failed write leaves what stands at ``path`` as it is, and nothing of its own."""
    spark = results.sparkSession
    files, target = file_system(spark, path)
    staged = file_system(spark, f"{path}.staged-{uuid.uuid4().hex}")[1]
    former = file_system(spark, f"{path}.former-{uuid.uuid4().hex}")[1]
    lines = results.select("start_road", LAYOUTS[layout]().alias("line")).repartition("start_road").sortWithinPartitions("start_road", "line")
    count = Observation()
    try:
        lines.select("line").observe(count, F.count(F.lit(1)).alias("n")).write.text(staged.toString())
    except Exception:
        files.delete(staged, True)
        raise
    if files.exists(target):
        files.rename(target, former)
    files.rename(staged, target)
    files.delete(former, True)
    return int(count.get["n"])


def read_routes(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The columns that a layout holds: route, and cost (ucs) or start_road (tcsp)."""
    lines = spark.read.text(path)
    if layout == "ucs":
        part = F.split(F.col("value"), ":", 2)
        return lines.select(F.get(part, 0).cast("double").alias("cost"), F.split(F.get(part, 1), ",").alias("route"))
    if layout == "tcsp":
        part = F.split(F.col("value"), "\t", 2)
        return lines.select(F.get(part, 0).alias("start_road"), F.split(F.get(part, 1), ",").alias("route"))
    return lines.select(F.split("value", ",").alias("route"))


def ucs_job(road_map: RoadMap, recs: DataFrame, out: str, minutes: float = ucs.DEFAULT_MINUTES) -> int:
    """Every record's points within the minutes, with costs and routes; returns the number of routes."""
    return write_routes(ucs.budget_routes(recs, road_map.roads, road_map.edges, minutes), out, "ucs")


def tcsp_job(road_map: RoadMap, recs: DataFrame, out: str, budget_secs: float = reach.DEFAULT_BUDGET_S) -> int:
    """Every record's region and the routes in it; returns the number of routes."""
    return write_routes(reach.region_routes(recs, road_map.roads, road_map.adj, road_map.edges, budget_secs), out, "tcsp")


def pairs_job(edge_table: DataFrame, recs: DataFrame, out: str, radius_m: float = DEFAULT_RADIUS_M) -> int:
    """For the roads of the records, a route to every road within the radius, over an edge table; returns the number of routes."""
    roads = edge_table.select(F.col("roadid").alias("road_id"), F.col("x1").alias("xa"), F.col("y1").alias("ya"), F.col("x2").alias("xb"), F.col("y2").alias("yb"))
    starts = recs.where(F.col("road_id") != "0").select("road_id").distinct()
    return write_routes(pairs.edge_table_routes(edge_table, roads_within_distance(starts, roads, radius_m)), out, "pairs")
