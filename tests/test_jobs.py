"""Jobs from text files, ordered scans, the swapped sink, placed tables and the ring search's own promises."""

import os

import pytest
from pyspark.sql import functions as F

from wayfold import jobs
from wayfold.operators import frontier, pairs, reach, spatial_jobs, ucs
from wayfold.operators.components import components, reachable, star_components
from wayfold.operators.routes import rebuild_routes, routes_to
from wayfold.sources import text
from wayfold.sources.network import load_network
from wayfold.tables import Placed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net(spark):
    return load_network(spark, SF)


@pytest.fixture(scope="module")
def files(spark, net, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("map"))
    text.write_lines(text.format_trajectory(net.records), f"{at}/traj")
    text.write_lines(text.format_road_attrs(net.roads), f"{at}/roads")
    text.write_lines(text.format_point_topology(net.edges, net.roads, net.junctions), f"{at}/points")
    text.write_lines(text.format_road_topology(net.roads), f"{at}/topology")
    return at


def _named(net, rows):
    """Junction numbers of a result as the text of their points."""
    at = net.junctions.select(F.col("node").alias("dst"), F.format_string("%.6f,%.6f", "lon", "lat").alias("point"))
    return rows.join(at, "dst").drop("dst").withColumnRenamed("point", "dst")


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).withColumn("cost", F.round("cost", 3)).collect())


def test_jobs_from_files_give_the_rows_of_the_tables(spark, net, files, tmpdir_path):
    road_map = jobs.load_map(spark, f"{files}/roads", f"{files}/points", f"{files}/topology")
    recs = jobs.records(spark, f"{files}/traj")
    assert road_map.bad.count() == 0 and recs.bad.count() == 0
    cols = ["event_id", "start_road", "dst", "cost", "route"]
    own = ucs.budget_routes(recs.rows, road_map.roads, road_map.edges)
    want = ucs.budget_routes(net.records, net.roads, net.edges)
    assert _rows(own, *cols) == _rows(_named(net, want), *cols)
    own = reach.region_routes(recs.rows, road_map.roads, road_map.adj, road_map.edges)
    want = reach.region_routes(net.records, net.roads, net.adj, net.edges)
    assert _rows(own, *cols) == _rows(_named(net, want), *cols)
    # the same through the sinks: lines, keys and counts
    out = f"{tmpdir_path}/tcsp"
    n = jobs.tcsp_job(road_map, recs.rows, out)
    back = jobs.read_routes(spark, out, "tcsp")
    assert n == back.count() == want.count()
    assert sorted((r.start_road, tuple(r.route)) for r in back.collect()) == sorted((r.start_road, tuple(r.route)) for r in want.collect())


def test_each_layout_is_read_back_and_a_failed_write_leaves_the_old(spark, tmpdir_path):
    res = spark.createDataFrame([("5", 1.25, ["5", "7"]), ("5", 2.0, ["5"]), ("9", 3.5, ["9", "5", "7"])], "start_road string, cost double, route array<string>")
    want = sorted((r.start_road, r.cost, tuple(r.route)) for r in res.collect())
    for layout, cols in (("ucs", (1, 2)), ("tcsp", (0, 2)), ("pairs", (2,))):
        path = f"{tmpdir_path}/{layout}"
        for _ in range(2):  # a second run replaces the first
            assert jobs.write_routes(res, path, layout) == 3
        back = jobs.read_routes(spark, path, layout).collect()
        got = sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in back)
        assert got == sorted(tuple(w[c] for c in cols) for w in want)
        broken = res.withColumn("cost", F.raise_error(F.lit("no")).cast("double")).withColumn("start_road", F.raise_error(F.lit("no")))
        with pytest.raises(Exception, match="no"):
            jobs.write_routes(broken, path, layout)
        assert jobs.read_routes(spark, path, layout).count() == 3
        assert os.listdir(tmpdir_path).count(layout) == 1 and not [f for f in os.listdir(tmpdir_path) if "staged" in f or "former" in f]


def test_last_line_of_a_key_over_files_and_splits(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/r")
    for name, lines in (("b.txt", [f"7;n;1,1、2,2;{k}.5" for k in range(400)] + ["8;n;1,1、2,2;1.5"]), ("a.txt", ["7;n;1,1、2,2;9999.0", "8;n;1,1、2,2;2.5", "6;n;1,1、2,2;0.5"])):
        with open(f"{tmpdir_path}/r/{name}", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = text.read_ordered_lines(spark, f"{tmpdir_path}/r")
        assert lines.rdd.getNumPartitions() > 5
        rows = {r.road_id: r.km for r in text.scan_road_attrs(spark, f"{tmpdir_path}/r").rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == {"7": 399.5, "8": 1.5, "6": 0.5}


def test_bad_lines_go_aside_with_counts(spark, tmpdir_path):
    cases = {
        "scan_trajectory": (["1,2,a,b,c,d,e,f,77", "1,2,3"], 1, 1),
        "scan_road_attrs": (["1;n;1,1、2,2;0.5", "2;n;1,1;x", "3", ""], 1, 2),
        "scan_point_topology": (["1,1|2,2,r,0.5", "1,1|2,2,r,0.7", "3,3|2,2,r", "4,4"], 1, 2),
        "scan_road_topology": (["1,1,2,3,4|1,2:2|3,4", "2,a,2,3,4|1,2", "3,1"], 1, 2),
        "scan_grid_index": (['{"GeoHash":"g","nodes":[{"RoadId":"1","LonLats":[]}]}', "no json", '{"GeoHash":"h"}'], 1, 2),
    }
    for name, (lines, good, bad) in cases.items():
        path = f"{tmpdir_path}/{name}.txt"
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        scan = getattr(text, name)(spark, path)
        assert scan.rows.count() == good and scan.bad.count() == bad, name
        assert sum(r.n_lines for r in scan.bad_counts().collect()) == bad
    again = text.scan_point_topology(spark, f"{tmpdir_path}/scan_point_topology.txt").rows.first()
    assert again.secs == 42.0  # the later line of the point


def test_edge_table_written_and_read(spark, net, tmpdir_path):
    path = f"{tmpdir_path}/edges"
    pairs.edge_table(net.roads).write.parquet(path)
    table = text.read_edge_table(spark, path)
    assert dict(table.dtypes)["roadid"] == dict(table.dtypes)["source"] == "string"
    n = jobs.pairs_job(table, net.records, f"{tmpdir_path}/pairs")
    want = pairs.pair_routes(net.records, net.roads)
    got = jobs.read_routes(spark, f"{tmpdir_path}/pairs", "pairs")
    assert n == want.count()
    assert sorted(",".join(r.route) for r in got.collect()) == sorted(",".join(r.route) for r in want.collect())
    pairs.edge_table(net.roads).drop("x1").write.parquet(f"{path}-short")
    with pytest.raises(ValueError, match="x1"):
        text.read_edge_table(spark, f"{path}-short")


def _labels(df):
    return sorted(tuple(r) for r in df.select("start", "node", F.round("cost", 6), "hops", "road_id", "pred").collect())


def test_every_width_and_placement_gives_the_same_labels(spark, net):
    starts = net.junctions.where("node % 37 = 0").select(F.col("node").alias("start"), "node")
    full = None
    for args in ({"width": float("inf")}, {"width": 5.0}, {"width": 1.0, "limit": 100.0}, {}, {"broadcast_bytes": 0}):
        trace = []
        got = _labels(frontier.search(starts, net.edges, **{"limit": 100.0, "penalty": 5.0, **args}, trace=trace))
        full = full or got
        assert got == full, args


def test_rounds_shuffle_candidates_only(spark, monkeypatch):
    """The plan of a round: exchanges below the candidates' aggregate, none of the log, none of bucketed edges."""
    plans = []
    append = frontier.Bucketed.append

    def spy(self, df):
        plans.append((self.name, df._jdf.queryExecution().executedPlan().toString()))
        append(self, df)

    monkeypatch.setattr(frontier.Bucketed, "append", spy)
    e = spark.createDataFrame([(i, i + 1, f"r{i}", 1.0) for i in range(50)], "src long, dst long, road_id string, secs double")
    s = spark.createDataFrame([(0, 0), (5, 5)], "start long, node long")
    frontier.search(s, e, limit=4.0, broadcast_bytes=0)
    rounds = [p for n, p in plans if "labels" in n and "Union" in p]
    assert rounds
    for p in rounds:
        assert p.count("Exchange hashpartitioning") == 2  # the front to the edges, the candidates to the log
        union = p.index("Union")
        log_side = p[union : p.index("\n", p.index("wayfold_labels", union))]
        assert "Exchange" not in log_side
        edge_side = p[p.rindex("Exchange hashpartitioning") :]
        assert "wayfold_edges" in edge_side and "Exchange" not in edge_side[edge_side.index("wayfold_edges") - 200 : edge_side.index("wayfold_edges")].split("\n")[-1]


def test_placed_tables_by_measured_size(spark):
    rows = spark.range(100).withColumnRenamed("id", "src")
    small, large = Placed(rows, "t", ["src"]), Placed(rows, "t", ["src"], broadcast_bytes=0)
    assert small.broadcast and not large.broadcast and small.bytes > 0
    front = spark.range(10).withColumnRenamed("id", "src")
    plans = [front.join(p.df, "src")._jdf.queryExecution().executedPlan().toString() for p in (small, large)]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
    assert front.join(small.df, "src").count() == front.join(large.df, "src").count() == 10


def test_a_start_with_an_unreachable_target_stops(spark):
    line = [(i, i + 1, f"r{i}", 1.0) for i in range(40)] + [(i + 1, i, f"r{i}", 1.0) for i in range(40)] + [(100, 0, "in", 1.0)]
    e = spark.createDataFrame(line, "src long, dst long, road_id string, secs double")
    t = spark.createDataFrame([(0, 1), (0, 100), (0, 999), (5, 5)], "start long, node long")
    ok = reachable(t, e)
    assert sorted(tuple(r) for r in ok.collect()) == [(0, 1), (5, 5)]
    starts = spark.createDataFrame([(0, 0)], "start long, node long")
    lab = frontier.search(starts, e, targets=ok.where("start = 0"), width=1.0)
    assert lab.count() < 12


def test_goal_directed_search_follows_fewer_labels(spark):
    """A lattice with places: the labels behind the start, seen from its targets, are left out, costs stay exact."""
    n = 15
    nodes = [(x * n + y, float(x), float(y)) for x in range(n) for y in range(n)]
    place = {k: (x, y) for k, x, y in nodes}
    arcs = [(a, b) for a in place for b in (a + 1, a - 1, a + n, a - n) if b in place and abs(place[a][0] - place[b][0]) + abs(place[a][1] - place[b][1]) == 1]
    e = spark.createDataFrame([(a, b, f"{a}-{b}", 1.0, *place[a], *place[b]) for a, b in arcs], "src long, dst long, road_id string, secs double, src_x double, src_y double, dst_x double, dst_y double")
    s = spark.createDataFrame([(7 * n + 7, 7 * n + 7)], "start long, node long")
    t = spark.createDataFrame([(7 * n + 7, 7 * n + 13, *place[7 * n + 13])], "start long, node long, x double, y double")
    plain = frontier.search(s, e, targets=t.drop("x", "y"), width=1.0)
    goal = frontier.search(s, e, targets=t, width=1.0)
    assert goal.where("node = 118").first().cost == plain.where("node = 118").first().cost == 6.0
    assert goal.count() <= plain.count()
    assert routes_to(goal, t).first().route == routes_to(plain, t).first().route


def test_routes_by_level_and_walked_back_agree(spark):
    n = 20
    e = spark.createDataFrame([(i, i + 1, f"r{i}", 1.0) for i in range(n)] + [(0, 5, "jump", 2.0)], "src long, dst long, road_id string, secs double")
    lab = frontier.search(spark.createDataFrame([(0, 0), (3, 3)], "start long, node long"), e)
    trace = []
    all_ = {(r.start, r.node): r.route for r in rebuild_routes(lab).collect()}
    want = lab.where("node in (0, 7, 20)").select("start", "node")
    back = {(r.start, r.node): r.route for r in routes_to(lab, want, trace).collect()}
    assert back == {k: v for k, v in all_.items() if k in back} and set(back) == {(0, 7), (0, 20), (3, 7), (3, 20)}
    open_ = [x for _, x in trace]
    assert open_ == sorted(open_, reverse=True) and open_[-1] == 0
    assert all_[(0, 7)] == ["jump", "r5", "r6"]


@pytest.mark.parametrize("local", [3, 1000])
def test_components_by_parts_and_by_stars(spark, local):
    edges = [(k, k + 1) for k in range(30) if k % 10 != 9] + [(40, 2), (50, 51), (51, 50), (7, 7), (60, 33), (33, 34), (25, 34)]
    df = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in edges], "u string, v string")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    want = {f"n{x:02d}": f"n{find(x):02d}" for x in parent}
    assert {r.node: r.component for r in components(df, local).collect()} == want
    assert {r.node: r.component for r in star_components(df).collect()} == want


def test_successors_cross_partitions_and_spread_a_hot_vehicle(spark):
    rows = [(k, 1, 1000 + (k // 2)) for k in range(300)] + [(1000 + k, 2 + k % 50, 5000 - k) for k in range(300)] + [(2000, None, 1), (2001, 7, None)]
    gps = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.event_id, r.nxt.event_id) for r in spatial_jobs.consecutive_pairs(gps).collect())
    want = []
    fine = sorted(((u, s, e) for e, u, s in rows if u is not None and s is not None))
    for a, b in zip(fine, fine[1:]):
        if a[0] == b[0]:
            want.append((a[2], b[2]))
    assert got == sorted(want)
