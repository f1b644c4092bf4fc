"""Point-to-point routes between nearby roads (the reference's A* job).

For each start road: every other road within a radius, the pair's endpoints
(the start road's last point -> the end road's first point), and one cheapest
route per pair over the directed edge table (``cost`` forward, ``reverse_cost``
backward, a negative reverse cost meaning one-way), no junction penalty.

The reference opens a database connection per record and runs one search per
pair.  Here all pairs are answered by one multi-source search per distinct
source point.  Pairs without a directed path are dropped first, so that every
search ends when its targets are settled.  Neighbouring sources are searched together
in one task (``regions.search_to``); a label dearer than the dearest of its source's targets is not followed.  What
that can't hold goes through the goal-directed search by rounds: a label
whose cost plus the least time to the box of its source's open targets (plane
distance over the fastest edge's speed) can't beat the dearest of them is not
followed.  Routes are walked back from the targets only.  Pairs whose two points
coincide have no route and are dropped, as are unreachable pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import regions
from wayfold.operators.components import reachable
from wayfold.operators.records import start_roads
from wayfold.operators.routes import routes_to
from wayfold.tables import cut
from wayfold.operators.spatial_jobs import DEFAULT_RADIUS_M, roads_within_distance


def edge_table(roads: DataFrame) -> DataFrame:
    """Relational edge table: id, roadid, source, target, cost, reverse_cost, x1, y1, x2, y2."""
    cost = F.col("km") * 60.0
    return roads.select(
        F.col("road_id").cast("bigint").alias("id"),
        F.col("road_id").alias("roadid"),
        F.col("a").alias("source"),
        F.col("b").alias("target"),
        cost.alias("cost"),
        F.when(F.col("oneway"), F.lit(-1.0)).otherwise(cost).alias("reverse_cost"),
        F.col("xa").alias("x1"),
        F.col("ya").alias("y1"),
        F.col("xb").alias("x2"),
        F.col("yb").alias("y2"),
    )


def directed_edges(table: DataFrame) -> DataFrame:
    """(src, dst, road_id, secs, src_x, src_y, dst_x, dst_y) from an edge table; a negative cost or reverse_cost = no edge that way."""
    ways = (("source", "target", "cost", "1", "2"), ("target", "source", "reverse_cost", "2", "1"))
    one, two = (
        table.where(F.col(secs) >= 0).select(
            F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("roadid").alias("road_id"), F.col(secs).alias("secs"),
            F.col("x" + a).alias("src_x"), F.col("y" + a).alias("src_y"), F.col("x" + b).alias("dst_x"), F.col("y" + b).alias("dst_y"),
        )
        for src, dst, secs, a, b in ways
    )
    return one.unionByName(two)


def pair_endpoints(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(start_road, road_id, from_node, to_node): the start road's target and
    the end road's source, two equi-joins on the edge table."""
    t = table.select(F.col("roadid").alias("start_road"), F.col("target").alias("from_node"))
    s = table.select(F.col("roadid").alias("road_id"), F.col("source").alias("to_node"))
    return pairs.select("start_road", "road_id").join(t, "start_road").join(s, "road_id").select(
        "start_road", "road_id", "from_node", "to_node"
    )


def pair_routes(records: DataFrame, roads: DataFrame, radius_m: float = DEFAULT_RADIUS_M) -> DataFrame:
    """(start_road, road_id, cost, route) for every start road of the records and
    every road within ``radius_m`` of it that has a route."""
    return edge_table_routes(edge_table(roads), roads_within_distance(start_roads(records, roads).select("road_id"), roads, radius_m))


def edge_table_routes(table: DataFrame, near: DataFrame, trace: list | None = None) -> DataFrame:
    """(start_road, road_id, cost, route) for the pairs ``near`` (start_road, road_id) over an edge table."""
    # the pair list feeds the search and the final join, the edges two searches: each is written once
    ends = cut(pair_endpoints(near, table).where(F.col("from_node") != F.col("to_node")), "pairs")
    edges = cut(directed_edges(table), "edges")
    asked = ends.select(F.col("from_node").alias("start"), F.col("to_node").alias("node")).distinct()
    place = edges.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("dst_x", "dst_y")).alias("at")).select("node", F.col("at.dst_x").alias("x"), F.col("at.dst_y").alias("y"))
    targets = cut(reachable(asked, edges).join(place, "node", "left"), "targets")
    sources = targets.select("start").distinct().select("start", F.col("start").alias("node"))
    lab = regions.search_to(sources, targets, edges, trace=trace)
    res = routes_to(lab, targets).select(F.col("start").alias("from_node"), F.col("node").alias("to_node"), "cost", "route")
    return ends.join(res, ["from_node", "to_node"]).select("start_road", "road_id", "cost", "route")
