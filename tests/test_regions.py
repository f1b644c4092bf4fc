"""Searches in regions give the labels and routes of the searches by rounds, whatever the groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import frontier, pairs, regions, ucs
from wayfold.operators.routes import rebuild_by_levels, rebuild_routes, routes_by_rounds, routes_to

EDGES = "src string, dst string, road_id string, secs double"


def _graph(seed):
    """Ties, parallel edges, loops, edges without cost, without a name, without a time, and endless ones."""
    r = random.Random(seed)
    node = lambda: f"n{r.randint(0, 24)}"
    return [(node(), node(), r.choice(["a", "b", "é", "c1", None]), r.choice([0.0, 1.0, 1.0, 2.5, 3.0, math.inf, math.nan, -1.0, None])) for _ in range(110)]


def _rows(df):
    return sorted(map(tuple, df.select(*frontier.LABEL_COLS).collect()), key=repr)


@pytest.mark.parametrize("args", [{}, {"most": 3}])
def test_labels_are_those_of_the_search_by_rounds(spark, args):
    e = spark.createDataFrame(_graph(1), EDGES)
    s = spark.createDataFrame([(f"n{k}", f"n{k}", float(k % 5), float(k) if k else math.nan) for k in range(12)] + [("x", "n1", None, None)], "start string, node string, x double, y double")
    for how in ({"penalty": 1.0, "limit": 6.0}, {"penalty": 0.5, "penalty_first": True, "limit": 4.0, "cut_secs": 5.0}):
        old = {("cut" if k == "cut_secs" else k): v for k, v in how.items()}
        assert _rows(regions.search(s, e, size=4, **how, **args)) == _rows(frontier.search(s.select("start", "node"), e, **old))


@pytest.mark.parametrize("most", [2, 1000])
def test_labels_over_own_edges(spark, most):
    rows = [(k, *row) for k in range(4) for row in _graph(k)]
    e = spark.createDataFrame(rows, f"start long, {EDGES}")
    s = spark.createDataFrame([(k, "n3") for k in (0, 1, 2, 3, 9)], "start long, node string")
    points = e.select("start", F.col("src").alias("node")).distinct()
    assert _rows(regions.keyed_search(s, points, e, cut_secs=9.0, most=most)) == _rows(frontier.search(s, e, cut=9.0, edges_keyed_by_start=True))


@pytest.mark.parametrize("most", [5, 100_000])
def test_routes_are_those_built_by_levels(spark, most):
    e = spark.createDataFrame([x for x in _graph(2) if x[2] and x[3] is not None], EDGES)
    s = spark.createDataFrame([(f"n{k}", f"n{k}") for k in range(8)], "start string, node string")
    lab = frontier.search(s, e, limit=20.0)
    for element in ("road_id", "node"):
        got, want = (sorted(map(tuple, df.select("start", "node", "cost", "hops", "route").collect())) for df in (rebuild_routes(lab, element, most=most), rebuild_by_levels(lab, element)))
        assert got == want and len(want) > 8


def test_rounds_hold_groups_not_starts(spark, monkeypatch):
    """Each round went over a row for every start and node."""
    n = 300
    roads = spark.createDataFrame([(str(k), k, k + 1, float(k), 0.0) for k in range(n)], "road_id string, a long, b long, xa double, ya double")
    records = spark.createDataFrame([(k, str(k)) for k in range(n)], "event_id long, road_id string")
    edges = roads.select(F.col("a").alias("src"), F.col("b").alias("dst"), "road_id", F.lit(30.0).alias("secs"))
    seen, plain = [], frontier.search

    def search(*args, **how):
        out = plain(*args, **how)
        seen.append(out.count())
        return out

    monkeypatch.setattr(frontier, "search", search)
    assert ucs.budget_search(records, roads, edges).count() > 5 * n
    assert 0 < sum(seen) < 3 * n


def test_labels_of_targets_are_those_of_the_search_by_rounds(spark):
    """Limits that are doubled, tiles with too many edges, starts left after all tries, and edges without a place or without time."""
    r = random.Random(5)
    place = {f"n{k}": (r.uniform(-9, 9), r.uniform(-9, 9)) for k in range(25)}
    rows = [(*x, *place[x[0]], *place[x[1]]) for x in _graph(3)]
    timed = spark.createDataFrame([x for x in rows if x[3] != 0.0], f"{EDGES}, src_x double, src_y double, dst_x double, dst_y double")
    s = spark.createDataFrame([(f"n{k}", f"n{k}") for k in range(12)], "start string, node string")
    full = frontier.search(s, timed)
    t = full.where("hash(start, node) % 3 = 0 and cost < double('infinity')").select("start", "node")
    want, asked = {(x.start, x.node): tuple(x) for x in full.select(*frontier.LABEL_COLS).collect()}, [tuple(x) for x in t.collect()]
    assert len(asked) > 20
    for args in ({"size": 4}, {"near": 0.6}, {"most": 30, "near": 0.2}, {"near": 0.01}):
        trace = []
        goal = regions.search_to(s, t, timed, trace=trace, **args)
        got = {(x.start, x.node): tuple(x) for x in goal.select(*frontier.LABEL_COLS).collect()}
        assert all(got[k] == want[k] for k in asked), args
        assert trace[0][1] > 0 if args.get("near", 1) < 0.1 else True
    back = [sorted((x.start, x.node, tuple(x.route)) for x in df.collect()) for df in (routes_to(full, t), routes_to(goal, t), routes_to(full, t, most=20), routes_by_rounds(full, t))]
    assert all(x == back[0] for x in back) and len(back[0]) > 15
    for odd in (rows, [(*x[:4], None, *x[5:]) if k == 7 else x for k, x in enumerate(rows)]):
        e = spark.createDataFrame(odd, timed.schema)
        lab = {(x.start, x.node): x.cost for x in regions.search_to(s, t, e).collect()}
        best = {(x.start, x.node): x.cost for x in frontier.search(s, e).collect()}
        assert all(lab[k] == best[k] for k in asked)


def test_pair_search_rounds_hold_groups_not_starts(spark, monkeypatch):
    """Each round of the pair search went over a row for every start and node, and each step back over the routes moved all labels."""
    n = 300
    table = spark.createDataFrame([(str(k), k, k + 1, 30.0, 30.0, float(k), 0.0, k + 1.0, 0.0) for k in range(n)], "roadid string, source long, target long, cost double, reverse_cost double, x1 double, y1 double, x2 double, y2 double")
    near = spark.createDataFrame([(str(k), str(j)) for k in range(n) for j in range(max(k - 5, 0), min(k + 6, n)) if j != k], "start_road string, road_id string")
    seen, plain = [], frontier.search

    def search(*args, **how):
        out = plain(*args, **how)
        seen.append(out.count())
        return out

    monkeypatch.setattr(frontier, "search", search)
    got = {(int(r.start_road), int(r.road_id)): (r.cost, r.route) for r in pairs.edge_table_routes(table, near).collect()}
    want = {(k, j): [str(i) for i in (range(k + 1, j) if j > k else range(k, j - 1, -1))] for k in range(n) for j in range(max(k - 5, 0), min(k + 6, n)) if j not in (k, k + 1)}
    assert got == {k: (30.0 * len(v), v) for k, v in want.items()}
    assert sum(seen) < 3 * n
