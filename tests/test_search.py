
from pyspark.sql import functions as F

from wayfold.operators import frontier
from wayfold.operators.routes import rebuild_routes


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, road_id string, secs double")


def _starts(spark, rows):
    return spark.createDataFrame(rows, "start long, node long")


def _labels(df):
    return {(r.start, r.node): (round(r.cost, 6), r.pred, r.road_id) for r in df.collect()}


def test_line_costs_and_penalty(spark):
    e = _edges(spark, [(1, 2, "a", 10.0), (2, 3, "b", 10.0), (3, 4, "c", 10.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e, penalty=5.0))
    assert lab[(1, 1)] == (0.0, None, None)
    assert lab[(1, 2)][0] == 15.0
    assert lab[(1, 4)][0] == 45.0


def test_cycle_cheaper_long_way(spark):
    # direct 1->3 costs 100, the long way 1->2->3 costs 20: the exact minimum wins
    e = _edges(spark, [(1, 3, "x", 100.0), (1, 2, "a", 10.0), (2, 3, "b", 10.0), (3, 1, "c", 1.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e))
    assert lab[(1, 3)] == (20.0, 2, "b")
    assert lab[(1, 1)][0] == 0.0  # the start is never improved


def test_one_way_and_unreachable(spark):
    e = _edges(spark, [(1, 2, "a", 1.0), (3, 2, "b", 1.0)])  # 3 is unreachable from 1
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e))
    assert (1, 3) not in lab and (1, 2) in lab


def test_dead_end_does_not_fail(spark):
    e = _edges(spark, [(1, 2, "a", 1.0)])  # 2 has no out-edges (the reference throws)
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e))
    assert set(lab) == {(1, 1), (1, 2)}


def test_parallel_edges_cheapest_then_smallest_id(spark):
    e = _edges(spark, [(1, 2, "b", 5.0), (1, 2, "c", 4.0), (1, 3, "z", 4.0), (1, 3, "y", 4.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e))
    assert lab[(1, 2)][2] == "c"
    assert lab[(1, 3)][2] == "y"  # tie on cost -> smallest road id


def test_limit_returns_first_label_past_limit_but_does_not_expand(spark):
    e = _edges(spark, [(1, 2, "a", 10.0), (2, 3, "b", 10.0), (3, 4, "c", 10.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e, limit=15.0))
    assert lab[(1, 3)][0] == 20.0  # past the limit: kept
    assert (1, 4) not in lab  # ... but not expanded


def test_frozen_frontier_is_not_reproduced(spark):
    # 4 is first reached past the limit (via 1->4, 30 s) and later within it (1->2->3->4, 9 s)
    e = _edges(spark, [(1, 4, "far", 30.0), (1, 2, "a", 3.0), (2, 3, "b", 3.0), (3, 4, "c", 3.0), (4, 5, "d", 1.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e, limit=10.0))
    assert lab[(1, 4)] == (9.0, 3, "c")
    assert lab[(1, 5)][0] == 10.0  # expanded from the improved label


def test_cut_drops_costs_at_or_above_inf(spark):
    e = _edges(spark, [(1, 2, "a", 999.0), (2, 3, "b", 1.0), (1, 4, "c", 1000.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e, cut=1000.0))
    assert (1, 2) in lab and (1, 3) not in lab and (1, 4) not in lab


def test_edge_without_a_time_does_not_hide_a_route(spark):
    e = _edges(spark, [(1, 2, "a", 3.0), (2, 3, "b", 3.0), (1, 3, "c", None), (1, 4, "d", float("nan")), (1, 5, "e", -1.0)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e, penalty=5.0))
    assert lab[(1, 3)] == (16.0, 2, "b")
    assert (1, 4) not in lab and (1, 5) not in lab


def test_many_starts_at_once_and_keyed_edges(spark):
    e = spark.createDataFrame(
        [(10, 1, 2, "a", 1.0), (10, 2, 3, "b", 1.0), (20, 1, 3, "x", 1.0)],
        "start long, src long, dst long, road_id string, secs double",
    )
    lab = _labels(frontier.search(_starts(spark, [(10, 1), (20, 1)]), e, edges_keyed_by_start=True))
    assert lab[(10, 3)] == (2.0, 2, "b")
    assert lab[(20, 3)] == (1.0, 1, "x")
    assert (20, 2) not in lab


def test_targets_bound_keeps_exact_target_costs(spark):
    e = _edges(spark, [(1, 2, "a", 1.0), (2, 3, "b", 1.0), (3, 4, "c", 1.0), (4, 5, "d", 1.0), (1, 5, "e", 2.5)])
    t = _starts(spark, [(1, 3)])
    full = _labels(frontier.search(_starts(spark, [(1, 1)]), e))
    bounded = _labels(frontier.search(_starts(spark, [(1, 1)]), e, targets=t))
    assert bounded[(1, 3)] == full[(1, 3)]


def test_route_rebuild_by_pointer_doubling(spark):
    n = 37
    e = _edges(spark, [(i, i + 1, f"r{i}", 1.0) for i in range(n)])
    lab = frontier.search(_starts(spark, [(0, 0)]), e)
    routes = {r.node: r.route for r in rebuild_routes(lab).collect()}
    assert routes[0] == []
    assert routes[n] == [f"r{i}" for i in range(n)]
    pts = {r.node: r.route for r in rebuild_routes(lab, element="node").collect()}
    assert pts[5] == [1, 2, 3, 4, 5]


def test_route_cost_equals_sum_of_edges(spark):
    e = _edges(spark, [(1, 2, "a", 2.0), (2, 3, "b", 3.0), (1, 3, "c", 9.0), (3, 4, "d", 1.0)])
    lab = frontier.search(_starts(spark, [(1, 1)]), e, penalty=5.0)
    r = rebuild_routes(lab).join(lab.select("start", "node", "cost"), ["start", "node"])
    secs = {x.road_id: x.secs for x in e.collect()}
    for row in r.collect():
        assert abs(sum(secs[x] + 5.0 for x in row.route) - row.cost) < 1e-9
    # with 5 s per step the two-hop route (9+5 + 1+5 = 20) beats a,b,d (21)
    assert r.where(F.col("node") == 4).first().route == ["c", "d"]


def test_unreachable_target_is_not_emitted_and_does_not_bound(spark):
    # target 9 is never reached: its placeholder must not appear as a label, and
    # the start stays unbounded, so the reachable target keeps its exact cost
    e = _edges(spark, [(1, 2, "a", 50.0), (1, 3, "b", 1.0), (3, 4, "c", 1.0), (4, 2, "d", 1.0), (9, 1, "z", 1.0)])
    t = _starts(spark, [(1, 2), (1, 9)])
    lab = _labels(frontier.search(_starts(spark, [(1, 1)]), e, targets=t))
    assert (1, 9) not in lab
    assert lab[(1, 2)] == (3.0, 4, "d")
    assert all(v[0] != float("inf") for v in lab.values())


def test_look_at_open_targets_holds_no_bucket_in_memory(spark):
    targets = spark.createDataFrame([(1, 2, 0.0, 0.0), (1, 3, 1.0, 2.0)], "start bigint, node bigint, x double, y double")
    log = spark.createDataFrame([(1, 2, 5.0), (1, 2, 4.0), (1, 9, 1.0)], "start bigint, node bigint, cost double")
    look = frontier._open_targets(targets, log, 4.0)
    assert "ShuffledHashJoin" not in look._jdf.queryExecution().toString()
    assert [tuple(r) for r in look.collect()] == [(1, float("inf"), 0.0, 1.0, 0.0, 2.0)]
