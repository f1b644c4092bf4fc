"""Distance on the ellipsoid: published values, and the radius search that uses it."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions.spatial import geodesic_m, great_circle_m
from wayfold.operators.spatial_jobs import roads_within_distance

# Published WGS 84 distances.  One degree along the equator is a * pi / 180; a quarter meridian is 10001965.729 m.
KNOWN = [
    (-73.8, 40.6, -0.5, 51.6, 5551759.400),
    (0.0, 0.0, 1.0, 0.0, 111319.491),
    (10.0, 0.0, 10.0, 90.0, 10001965.729),
    (5.0, 45.0, 5.0, 45.0, 0.0),
]


def test_published_distances(spark):
    rows = spark.createDataFrame(KNOWN, "lon1 double, lat1 double, lon2 double, lat2 double, want double")
    for r in rows.withColumn("got", geodesic_m("lon1", "lat1", "lon2", "lat2")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-3)


def test_both_ways_and_across_the_180_degree_line(spark):
    rows = spark.createDataFrame([(179.99, 10.0, -179.99, 10.02), (108.9, 34.2, 108.91, 34.21)], "a double, b double, c double, d double")
    for r in rows.select(geodesic_m("a", "b", "c", "d").alias("x"), geodesic_m("c", "d", "a", "b").alias("y"), great_circle_m("a", "b", "c", "d").alias("s")).collect():
        assert r.x == pytest.approx(r.y, abs=1e-6)
        assert r.x == pytest.approx(r.s, rel=0.01)


def test_radius_on_the_ellipsoid(spark):
    """Two parallel roads on meridians at latitude 60: the sphere and the ellipsoid put them on different sides of the radius."""
    gap = 0.0179
    roads = spark.createDataFrame([("1", 0.0, 60.0, 0.0, 60.01), ("2", gap, 60.0, gap, 60.01), ("3", 0.0, 60.005, gap, 60.005), ("4", 1.0, 60.0, 1.0, 60.0)], "road_id string, xa double, ya double, xb double, yb double")
    starts = roads.select("road_id")
    top = spark.createDataFrame([(0.0, 60.01, gap, 60.01)], "a double, b double, c double, d double")
    want = top.select(geodesic_m("a", "b", "c", "d")).first()[0]
    got = {(r.start_road, r.road_id): r.dist_m for r in roads_within_distance(starts, roads, 1000.0, ellipsoid=True).collect()}
    assert got[("1", "2")] == got[("2", "1")] == pytest.approx(want, abs=0.05)
    assert got[("1", "3")] == got[("3", "2")] == 0.0 or got[("1", "3")] < 0.01
    flat = {(r.start_road, r.road_id): r.dist_m for r in roads_within_distance(starts, roads, 1000.0).collect()}
    assert set(flat) == set(got) and abs(flat[("1", "2")] - want) > 1.0
    tight = (want + flat[("1", "2")]) / 2
    pairs = lambda **k: {(r.start_road, r.road_id) for r in roads_within_distance(starts, roads, tight, **k).collect()}
    assert (("1", "2") in pairs()) != (("1", "2") in pairs(ellipsoid=True))
