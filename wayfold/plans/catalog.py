"""Registered queries: one callable per operator key, ``(spark, sf_dir) -> DataFrame``.

Each reads the driver's parquet tables through ``sources.network`` (or the
text layouts built from them) and runs the operator over the whole tables.
Costs are rounded to 3 decimals and routes joined with ',' so results compare
exactly with the DuckDB oracles in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import pairs, reach, records, routes, spatial_jobs, ucs
from wayfold.sources import text
from wayfold.sources.network import load_network
from wayfold.tables import cut

Query = Callable[[SparkSession, str], DataFrame]


def _route_str(c="route"):
    return F.array_join(F.col(c), ",").alias("route")


def q_matched_records(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return records.matched_records(net.records).select("event_id", "user_id", "road_id")


def q_start_points(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return records.start_points(net.records, net.roads).select("event_id", "road_id", "start_node", "lon", "lat")


def q_budget_search(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = ucs.budget_search(net.records, net.roads, net.edges)
    return res.select("start", "dst", F.round("cost", 3).alias("cost"), "within")


def q_route_rebuild(spark, sf_dir):
    net = load_network(spark, sf_dir)
    lab = ucs.budget_labels(net.records, net.roads, net.edges)
    r = routes.rebuild_routes(lab).where(F.size("route") > 0)
    return r.select("start", F.col("node").alias("dst"), _route_str())


def q_exploded_routes(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = ucs.budget_results(net.records, net.roads, net.edges)
    return routes.exploded_routes(res).select("start", "dst", F.col("pos").cast("int").alias("pos"), "road_id")


def q_budget_routes(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = ucs.budget_routes(net.records, net.roads, net.edges)
    return res.select("event_id", "start_road", "dst", F.round("cost", 3).alias("cost"), "within", _route_str())


def q_route_lines(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = ucs.budget_routes(net.records, net.roads, net.edges).drop("within")
    return routes.route_lines(res).select("event_id", "start_road", "dst", "line")


def q_route_count(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return ucs.budget_route_count(net.records, net.roads, net.edges)


def q_reachable_roads(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = reach.reachable_roads(net.records, net.roads, net.adj)
    return res.select("start_road", "road_id", F.round("cost", 3).alias("cost"), "within")


def q_region_points(spark, sf_dir):
    net = load_network(spark, sf_dir)
    reached = reach.reachable_roads(net.records, net.roads, net.adj)
    return reach.region_points(reached, net.roads)


def q_region_edges(spark, sf_dir):
    net = load_network(spark, sf_dir)
    reached = reach.reachable_roads(net.records, net.roads, net.adj)
    return reach.region_edges(reach.region_points(reached, net.roads), net.edges)


def q_region_shortest_paths(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = reach.region_shortest_paths(net.records, net.roads, net.adj, net.edges)
    return res.select("start_road", "dst", F.round("cost", 3).alias("cost"))


def q_route_roads(spark, sf_dir):
    """Point paths of the region search -> road ids via the point topology."""
    net = load_network(spark, sf_dir)
    lab = cut(reach.region_labels(net.records, net.roads, net.adj, net.edges), "labels")
    pts = routes.rebuild_routes(lab, element="node").where(F.size("route") > 0)
    roots = lab.where(F.col("pred").isNull()).select("start", F.col("node").alias("root"))
    paths = pts.join(roots, "start").select(
        "start", F.col("node").alias("dst"), F.concat(F.array("root"), F.col("route")).alias("points")
    )
    res = routes.point_path_roads(paths, net.edges)
    return res.select(F.col("start").alias("start_road"), "dst", _route_str())


def q_region_routes(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = reach.region_routes(net.records, net.roads, net.adj, net.edges)
    return res.select("event_id", "start_road", "dst", F.round("cost", 3).alias("cost"), _route_str())


_CORE = {
        "matched_records": q_matched_records,
        "start_points": q_start_points,
        "budget_search": q_budget_search,
        "route_rebuild": q_route_rebuild,
        "exploded_routes": q_exploded_routes,
        "budget_routes": q_budget_routes,
        "route_lines": q_route_lines,
        "route_count": q_route_count,
        "reachable_roads": q_reachable_roads,
        "region_points": q_region_points,
        "region_edges": q_region_edges,
        "region_shortest_paths": q_region_shortest_paths,
        "route_roads": q_route_roads,
        "region_routes": q_region_routes,
}


# ------------------------------------------------------------------ text scans

def q_trajectory_scan(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return text.parse_trajectory(text.format_trajectory(net.records))


def q_road_attr_scan(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return text.parse_road_attrs(text.format_road_attrs(net.roads))


def q_point_topology_scan(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return text.parse_point_topology(text.format_point_topology(net.edges, net.roads, net.junctions))


def q_road_topology_scan(spark, sf_dir):
    net = load_network(spark, sf_dir)
    t = text.parse_road_topology(text.format_road_topology(net.roads))
    return t.select(
        "road_id", "lon1", "lat1", "lon2", "lat2",
        F.array_join("start_roads", ",").alias("start_roads"),
        F.array_join("end_roads", ",").alias("end_roads"),
    )


def q_grid_index_scan(spark, sf_dir):
    net = load_network(spark, sf_dir)
    g = text.parse_grid_index(text.format_grid_index(net.grid))
    return g.select("cell", "road_id", F.array_join("lonlats", ";").alias("lonlats"))


def q_edge_table_scan(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return pairs.edge_table(net.roads)


# --------------------------------------------------------------- spatial jobs

def q_geohash_cells(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return spatial_jobs.geohash_cells(net.gps)


def q_candidate_roads(spark, sf_dir):
    net = load_network(spark, sf_dir)
    c = spatial_jobs.candidate_roads(net.gps, net.grid)
    return c.select("event_id", "road_id", F.array_join("lonlats", ";").alias("lonlats"))


def q_project_to_road(spark, sf_dir):
    net = load_network(spark, sf_dir)
    p = spatial_jobs.project_to_road(net.gps, net.roads)
    return p.select("event_id", "road_id", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))


def q_great_circle_distance(spark, sf_dir):
    net = load_network(spark, sf_dir)
    d = spatial_jobs.endpoint_distances(net.gps, net.roads)
    return d.select("event_id", "road_id", F.round("d_first", 3).alias("d_first"),
                    F.round("d_last", 3).alias("d_last"))


def q_nearest_endpoint(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return spatial_jobs.nearest_endpoint(net.gps, net.roads)


def q_heading_endpoints(spark, sf_dir):
    net = load_network(spark, sf_dir)
    return spatial_jobs.heading_endpoints(net.gps, net.roads)


def q_roads_within_distance(spark, sf_dir):
    net = load_network(spark, sf_dir)
    starts = records.start_roads(net.records, net.roads).select("road_id")
    return spatial_jobs.roads_within_distance(starts, net.roads).select("start_road", "road_id")


def q_pair_endpoints(spark, sf_dir):
    net = load_network(spark, sf_dir)
    starts = records.start_roads(net.records, net.roads).select("road_id")
    near = spatial_jobs.roads_within_distance(starts, net.roads)
    return pairs.pair_endpoints(near, pairs.edge_table(net.roads))


def q_pair_routes(spark, sf_dir):
    net = load_network(spark, sf_dir)
    res = pairs.pair_routes(net.records, net.roads)
    return res.select("start_road", "road_id", F.round("cost", 3).alias("cost"), _route_str())


_MORE = {
    "trajectory_scan": q_trajectory_scan,
    "road_attr_scan": q_road_attr_scan,
    "point_topology_scan": q_point_topology_scan,
    "road_topology_scan": q_road_topology_scan,
    "grid_index_scan": q_grid_index_scan,
    "edge_table_scan": q_edge_table_scan,
    "geohash_cells": q_geohash_cells,
    "candidate_roads": q_candidate_roads,
    "project_to_road": q_project_to_road,
    "great_circle_distance": q_great_circle_distance,
    "nearest_endpoint": q_nearest_endpoint,
    "heading_endpoints": q_heading_endpoints,
    "roads_within_distance": q_roads_within_distance,
    "pair_endpoints": q_pair_endpoints,
    "pair_routes": q_pair_routes,
}


def catalog() -> dict[str, Query]:
    return {**_CORE, **_MORE}
