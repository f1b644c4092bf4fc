"""Spatial column expressions against a plain-Python statement of the same rules."""

import math

from pyspark.sql import functions as F

from wayfold.functions.geohash import geohash7
from wayfold.functions.spatial import facing_end_is_first, great_circle_m, project_to_segment


#: Points away from cell borders, with their public 7-character geohash.
CELLS = [(108.9, 34.2, 'wqj6w1f'), (108.93415, 34.21987, 'wqj6wve'), (-73.985, 40.748, 'dr5ru3v'), (116.39747, 39.90882, 'wx4g09n'), (2.2945, 48.8583, 'u09tunq')]


def test_geohash_of_known_points(spark):
    df = spark.createDataFrame(CELLS, "lon double, lat double, want string").select("want", geohash7("lon", "lat").alias("c"))
    assert all(r.c == r.want for r in df.collect())


def test_projection_inside_outside_and_zero_length(spark):
    rows = [
        (1.0, 1.0, 0.0, 0.0, 2.0, 0.0),  # inside -> foot (1, 0)
        (-1.0, 1.0, 0.0, 0.0, 2.0, 0.0),  # before the first end -> first end
        (5.0, -1.0, 0.0, 0.0, 2.0, 0.0),  # past the last end -> last end
        (3.0, 3.0, 1.0, 1.0, 1.0, 1.0),  # zero-length segment -> its point
    ]
    df = spark.createDataFrame(rows, "x double, y double, x1 double, y1 double, x2 double, y2 double")
    got = [(r.p.x, r.p.y) for r in df.select(project_to_segment("x", "y", "x1", "y1", "x2", "y2").alias("p")).collect()]
    assert got == [(1.0, 0.0), (0.0, 0.0), (2.0, 0.0), (1.0, 1.0)]


def test_great_circle_formula(spark):
    k, r = 0.01745329252, 6370693.5
    lon1, lat1, lon2, lat2 = 108.9, 34.2, 108.95, 34.25
    c = math.sin(lat1 * k) * math.sin(lat2 * k) + math.cos(lat1 * k) * math.cos(lat2 * k) * math.cos(lon1 * k - lon2 * k)
    want = r * math.acos(max(-1.0, min(1.0, c)))
    df = spark.createDataFrame([(lon1, lat1, lon2, lat2)], "a double, b double, c double, d double")
    got = df.select(great_circle_m("a", "b", "c", "d").alias("m"), great_circle_m("a", "b", "a", "b").alias("z")).first()
    assert abs(got.m - want) < 1e-6 and got.z < 1e-3


def test_facing_end_ties_and_undefined_pick_last(spark):
    rows = [
        # other point to the right of the segment's last end -> last end (False)
        (1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 5.0, 0.0),
        # other point to the left -> first end
        (1.0, 0.0, 0.0, 0.0, 2.0, 0.0, -5.0, 0.0),
        # other point equals the projection: undefined angle -> last end
        (1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "gx double, gy double, x1 double, y1 double, x2 double, y2 double, ox double, oy double")
    got = [r.f for r in df.select(facing_end_is_first("gx", "gy", "x1", "y1", "x2", "y2", "ox", "oy").alias("f")).collect()]
    assert got == [False, True, False]


def test_candidate_roads_contain_own_road(spark):
    from wayfold.operators.spatial_jobs import candidate_roads
    from wayfold.sources.network import load_network

    net = load_network(spark, "/root/testdata/sf0.001")
    cand = candidate_roads(net.gps, net.grid)
    own = net.gps.join(cand, ["event_id", "road_id"], "left_semi").count()
    assert own == net.gps.count()
    assert cand.where(F.size("lonlats") == 0).count() == 0


def test_geohash_fast_path_equals_fold(spark):
    """Closed form + border fallback equals the rounded fold, also right at cell borders."""
    import random

    from wayfold.functions.geohash import _fold

    rnd = random.Random(7)
    w1, w2 = 360.0 / 2**18, 180.0 / 2**17
    pts = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(3000)]
    for _ in range(3000):  # points within a few 1e-6 degrees of a border
        k1, k2 = rnd.randrange(2**18), rnd.randrange(2**17)
        pts.append((-180 + k1 * w1 + rnd.uniform(-4e-6, 4e-6), -90 + k2 * w2 + rnd.uniform(-4e-6, 4e-6)))
    df = spark.createDataFrame(pts, "lon double, lat double")
    diff = df.where(geohash7("lon", "lat") != _fold(F.col("lon"), F.col("lat"))).count()
    assert diff == 0


def test_roads_near_the_pole_are_found(spark):
    from wayfold.operators.spatial_jobs import roads_within_distance

    rows = [("a", 0.0, 89.8, 0.01, 89.8), ("b", 2.0, 89.8, 2.01, 89.8)]
    roads = spark.createDataFrame(rows, "road_id string, xa double, ya double, xb double, yb double")
    got = roads_within_distance(roads.select("road_id"), roads, 1000.0).collect()
    assert {(r.start_road, r.road_id) for r in got} == {("a", "b"), ("b", "a")}
    assert all(700 < r.dist_m < 850 for r in got)


def test_long_roads_that_come_close_at_one_end_are_found(spark):
    from wayfold.operators.spatial_jobs import roads_within_distance

    for sign in (1.0, -1.0):
        rows = [("a", 0.0, sign * 60.0, 0.0, sign * 61.0), ("b", 0.0185, sign * 60.0, 0.0185, sign * 61.0)]
        roads = spark.createDataFrame(rows, "road_id string, xa double, ya double, xb double, yb double")
        got = roads_within_distance(roads.select("road_id"), roads, 1000.0).collect()
        assert sorted((r.start_road, r.road_id) for r in got) == [("a", "b"), ("b", "a")]
        assert all(997 < r.dist_m < 998 for r in got)


def _unit(lon, lat):
    import numpy as np

    lo, la = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=-1)


def _densified_m(r, s, n=1500):
    """Least distance between the points of two arcs, each cut into ``n`` parts."""
    import numpy as np

    t = np.linspace(0, 1, n)[:, None]
    p, q = ((1 - t) * _unit(x[1], x[2]) + t * _unit(x[3], x[4]) for x in (r, s))
    p, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (p, q))
    chord = np.sqrt(np.maximum(2 - 2 * (p @ q.T).max(), 0))
    return 2 * 6370693.5 * np.arcsin(chord / 2)


def test_roads_across_the_180_degree_line_are_found(spark):
    from wayfold.operators.spatial_jobs import roads_within_distance

    rows = [("a", 179.99, 10.0, 179.9995, 10.0), ("b", -179.9995, 10.0, -179.99, 10.0), ("c", 179.998, 10.005, -179.998, 10.005), ("d", 179.9, 10.0, 179.95, 10.0)]
    roads = spark.createDataFrame(rows, "road_id string, xa double, ya double, xb double, yb double")
    got = {(r.start_road, r.road_id): r.dist_m for r in roads_within_distance(roads.select("road_id"), roads, 1000.0).collect()}
    assert set(got) == {(p, q) for p in "abc" for q in "abc" if p != q}
    assert abs(got["a", "b"] - 109.5) < 0.5


def test_distance_join_equals_densified_segments(spark):
    """All pairs of random roads at low, middle and polar latitudes and at the 180 degree line, each once."""
    import random

    from wayfold.operators.spatial_jobs import roads_within_distance

    rnd = random.Random(3)
    rows = []
    for lon, lat, wide in [(10, 0, 0.03), (20, 60, 0.06), (179.995, 45, 0.04), (0, 89.99, 180), (0, -89.985, 180)]:
        for _ in range(14):
            ax, ay = lon + rnd.uniform(-wide, wide), min(max(lat + rnd.uniform(-0.01, 0.01), -90.0), 90.0)
            bx, by = ax + rnd.uniform(-wide, wide) / 2, min(max(ay + rnd.uniform(-0.01, 0.01), -90.0), 90.0)
            rows.append((f"r{len(rows)}", (ax + 180) % 360 - 180, ay, (bx + 180) % 360 - 180, by))
    roads = spark.createDataFrame(rows, "road_id string, xa double, ya double, xb double, yb double")
    for radius in (400.0, 1000.0):
        rs = roads_within_distance(roads.select("road_id"), roads, radius).collect()
        got = {(r.start_road, r.road_id): r.dist_m for r in rs}
        assert len(rs) == len(got)  # no pair twice
        for r in rows:
            for s in rows:
                if r != s:
                    d = _densified_m(r, s, 300)
                    if d < radius - 25:
                        assert abs(got[r[0], s[0]] - d) < 25
                    elif d > radius + 25:
                        assert (r[0], s[0]) not in got
    oblique = [("p", 0.012, 60.0, 0.012, 60.0), ("q", 0.0, 60.0, 0.02, 60.02)]
    pair = spark.createDataFrame(oblique, "road_id string, xa double, ya double, xb double, yb double")
    got = roads_within_distance(pair.select("road_id"), pair, 1000.0).collect()
    assert len(got) == 2 and all(abs(r.dist_m - _densified_m(*oblique, 3000)) < 0.5 for r in got)


def test_rows_without_a_time_are_no_part_of_a_sequence(spark):
    from wayfold.operators.spatial_jobs import consecutive_pairs

    rows = [(1, 7, None), (2, 7, "2024-01-01 00:00:00"), (3, 7, "2024-01-01 05:00:00"), (4, None, "2024-01-01 00:00:00")]
    gps = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts")
    assert [(r.event_id, r.nxt.event_id) for r in consecutive_pairs(gps).collect()] == [(2, 3)]


def test_latitudes_beyond_a_pole_take_as_few_cells_as_others(spark):
    """A map that runs on over a pole: its far roads lie in a few cells of their own row, and keep their neighbours."""
    from wayfold.operators.spatial_jobs import _boxes, _cells, roads_within_distance

    rows = []
    for base in (-34.0, 34.0, 146.0, 184.0, 214.0, 326.0):  # 34 degrees from the equator, but 184 (4 degrees)
        rows += [(f"{base}/{k}", 108.9 + 0.005 * k, base, 108.905 + 0.005 * k, base) for k in range(40)]
    roads = spark.createDataFrame(rows, "road_id string, xa double, ya double, xb double, yb double")
    for padded, most in ((False, 4), (True, 25)):
        assert _cells(_boxes(roads), 1000.0, padded).groupBy("road_id").count().agg(F.max("count")).first()[0] <= most
    near = {(r.start_road, r.road_id) for r in roads_within_distance(roads, roads).collect()}
    want = {(f"{b}/{i}", f"{b}/{j}") for b in (-34.0, 34.0, 146.0, 184.0, 214.0, 326.0) for i in range(40) for j in range(40) if 1 <= abs(i - j) <= (2 if b == 184.0 else 3)}
    assert near == want


def test_geohash_beyond_the_ranges_equals_the_bisection(spark):
    from wayfold.functions.geohash import _cell_index, _fold

    inf = float("inf")
    edge = (-180.0, 180.0, -90.0, 90.0, 0.0, -0.0007, 89.9993, 179.9993)
    rows = [(x + dx, y + dy) for x in (108.9, *edge, 400.0, -400.0, inf, -inf) for y in (34.2, *edge, 184.2, -934.5, inf, -inf) for dx in (0.0, 1e-7, -1e-7) for dy in (0.0, 3e-6, -1e-9)]
    rows += [(float("nan"), 1.0), (1.0, float("nan")), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    got = df.select("lon", "lat", geohash7("lon", "lat").alias("fast"), _fold("lon", "lat").alias("want"))
    assert [r for r in got.collect() if r.fast != r.want] == []
    far = spark.createDataFrame([(184.2,), (-934.5,)], "lat double")
    assert far.where(_cell_index(F.col("lat"), -90.0, 90.0, 17)[1]).count() == 0  # no slow path for them


def test_candidate_roads_keep_the_last_corner_and_shuffle_no_result(spark):
    from wayfold.operators.spatial_jobs import CANDIDATE_HALF_WINDOW as h
    from wayfold.operators.spatial_jobs import candidate_roads

    points = [(1, 108.9, 34.2), (1, 108.95, 34.2), (2, 108.9005, 34.2007), (2, 108.9005, 34.2007), (3, 108.9, 34.2), (None, 108.9, 34.2), (None, 108.9013, 34.2), (4, None, 34.2)]
    gps = spark.createDataFrame(points, "event_id bigint, lon double, lat double")
    corners = [(e, pos, x + dx, y + dy) for e, x, y in points if x is not None for pos, (dx, dy) in enumerate([(-h, h), (h, h), (-h, -h), (h, -h)], 1)]
    at = spark.createDataFrame(corners, "e bigint, pos int, x double, y double").select("e", "pos", geohash7("x", "y").alias("cell")).collect()
    cells = sorted({r.cell for r in at})
    grid = [(c, road, [f"{road}@{c}"]) for k, c in enumerate(cells) for road in ("all", f"r{k}", *(["even"] if k % 2 == 0 else []), *([None] if k % 3 == 0 else []))]
    rows = spark.createDataFrame(grid, "cell string, road_id string, lonlats array<string>")
    want = {}
    for r in sorted(at, key=lambda r: r.pos):
        for c, road, points_ in grid:
            if c == r.cell:
                best, had = want.get((r.e, road), (0, set()))
                want[r.e, road] = (r.pos, ({points_[0]} | had) if best == r.pos else {points_[0]})
    out = candidate_roads(gps, rows)
    got = [tuple(r) for r in out.collect()]
    met = {(e, road): {p[0] for e2, r2, p in got if (e2, r2) == (e, road)} for e, road, _ in got}
    assert met.keys() == want.keys() and all(met[k] <= want[k][1] for k in want)
    assert len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan()
    known, unknown = plan.children().head(), plan.children().last()
    assert "max_by" in unknown.toString() and "isnull(event_id" in unknown.toString()
    assert "max_by" not in known.toString()


def test_candidate_roads_deal_roads_and_points_once(spark):
    """Points of roads were shuffled by cell and road and again by road; now roads are dealt before they become points."""
    import re

    from wayfold.operators.spatial_jobs import candidate_roads
    from wayfold.sources.network import build_grid

    ends = "road_id string, xa double, ya double, xb double, yb double"
    roads = spark.createDataFrame([("1", 108.9, 34.2, 108.905, 34.2), ("2", 108.9, 34.2, 108.9, 34.205), ("2", 108.9, 34.2, 108.9, 34.205), (None, 108.9, 34.2, 108.901, 34.2)], ends)
    gps = spark.createDataFrame([(1, 108.9, 34.2), (2, 108.903, 34.2001)], "event_id bigint, lon double, lat double")
    grid = build_grid(roads)
    plan = candidate_roads(gps, grid)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(cell#\d+, road_id#\d+|hashpartitioning\(road_id#\d+, cell#\d+", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(road_id#", plan)) == 2  # of events with an id, and of those without
    points = {}
    for r in grid.collect():
        assert (r.cell, r.road_id) not in points
        points[r.cell, r.road_id] = r.lonlats
    assert sum(len(p) for (_, road), p in points.items() if road == "2") == 42
    again = grid.unionByName(grid.withColumn("lonlats", F.array(F.lit("999,9"))))
    one, two = ({(r.event_id, r.road_id): r.lonlats for r in candidate_roads(gps, g).collect()} for g in (grid, again))
    assert one.keys() == two.keys() and {r for _, r in one} == {"1", "2", None} and all(p == ["999,9"] for p in two.values())
