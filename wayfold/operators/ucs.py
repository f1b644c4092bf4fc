"""Uniform-cost search with a time limit (the reference's cluster job).

From the first point of each record's road, every point reachable is labelled
with its cheapest time: edge seconds + a 5 s junction penalty per step.  Points
first reached past the limit are returned (``within`` false) but not expanded.
Unlike the reference, a point whose first label is past the limit can still be
improved by a later, cheaper label (its "frozen frontier" is a defect): the
result is the exact minimum.

One search per distinct start point serves all records starting there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import regions
from wayfold.operators.records import record_counts, start_points
from wayfold.operators.routes import rebuild_routes

# Fixed values of the reference's UCS job: junction penalty (s), default minutes.
JUNCTION_PENALTY_S = 5.0
DEFAULT_MINUTES = 3


def budget_labels(records: DataFrame, roads: DataFrame, edges: DataFrame, minutes: float = DEFAULT_MINUTES) -> DataFrame:
    """Search labels (start, node, cost, pred, road_id, hops) from every distinct start point."""
    limit = minutes * 60.0
    starts = (
        start_points(records, roads)
        .groupBy(F.col("start_node").alias("start"))
        .agg(F.min("lon").alias("x"), F.min("lat").alias("y"))
        .select("start", F.col("start").alias("node"), "x", "y")
    )
    return regions.search(
        starts,
        edges,
        penalty=JUNCTION_PENALTY_S,
        limit=limit,
    )


def budget_search(records, roads, edges, minutes: float = DEFAULT_MINUTES) -> DataFrame:
    """(start, dst, cost, within) for every point reached, start excluded."""
    limit = minutes * 60.0
    lab = budget_labels(records, roads, edges, minutes)
    return lab.where(F.col("pred").isNotNull()).select(
        "start",
        F.col("node").alias("dst"),
        F.col("cost"),
        (F.col("cost") <= F.lit(limit)).alias("within"),
    )


def budget_results(records, roads, edges, minutes: float = DEFAULT_MINUTES) -> DataFrame:
    """Per distinct start: (start, dst, cost, within, route ARRAY<STRING>)."""
    limit = minutes * 60.0
    routes = rebuild_routes(budget_labels(records, roads, edges, minutes))
    return routes.where("hops > 0").select(
        "start",
        F.col("node").alias("dst"),
        "cost",
        (F.col("cost") <= F.lit(limit)).alias("within"),
        "route",
    )


def budget_routes(records, roads, edges, minutes: float = DEFAULT_MINUTES) -> DataFrame:
    """End-to-end UCS per record: (event_id, start_road, dst, cost, within, route).

    Searches run once per distinct start point; the per-record rows are a join
    back to the records (AQE splits a hot start's partition if skewed)."""
    res = budget_results(records, roads, edges, minutes)
    recs = start_points(records, roads).select("event_id", F.col("road_id").alias("start_road"),
                                                F.col("start_node").alias("start"))
    return recs.join(res, "start").select("event_id", "start_road", "dst", "cost", "within", "route")


def budget_route_count(records, roads, edges, minutes: float = DEFAULT_MINUTES) -> DataFrame:
    """Number of result routes over all records, without materialising them:
    records per start point (pre-aggregated) x results per start point."""
    per_start = budget_search(records, roads, edges, minutes).groupBy("start").agg(
        F.count(F.lit(1)).alias("n_results")
    )
    counts = record_counts(records, roads, "start_node").withColumnRenamed("start_node", "start")
    return counts.join(per_start, "start").agg(
        F.coalesce(F.sum(F.col("n_records") * F.col("n_results")), F.lit(0)).cast("long").alias("n_routes")
    )
