"""The reference's text layouts, written as files and read back with spark.read.text."""

import json
import os

from wayfold.sources import text


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_trajectory_scan_field_8_and_short_line(spark, tmpdir_path):
    p = _write(f"{tmpdir_path}/traj.txt", ["7,1,a,b,c,d,e,f,5001,x", "7,2,a,b,c,d,e,f,0", "7,3,short"])
    rows = {r.rec_id: r.road_id for r in text.parse_trajectory(text.read_lines(spark, p)).collect()}
    assert rows == {1: "5001", 2: "0", 3: None}


def test_road_attr_scan(spark, tmpdir_path):
    p = _write(f"{tmpdir_path}/roads.txt", ["11;n;1.0,2.0、1.5,2.5、3.0,4.0;x;0.20001", " 12;n;5.0,6.0;x;1.5 "])
    rows = {r.road_id: r for r in text.parse_road_attrs(text.read_lines(spark, p)).collect()}
    assert rows["11"].p_first == "1.0,2.0" and rows["11"].p_last == "3.0,4.0"
    assert rows["11"].secs == 12.001  # round(km * 3600 / 60, 3), HALF_UP
    assert rows["12"].km == 1.5 and rows["12"].p_first == rows["12"].p_last == "5.0,6.0"


def test_point_topology_scan(spark, tmpdir_path):
    p = _write(f"{tmpdir_path}/pt.txt", ["1.0,2.0|3.0,4.0,r1,0.5;5.0,6.0,r2,1.0;", "3.0,4.0|1.0,2.0,r1,0.5"])
    rows = sorted((r.src, r.dst, r.road_id, r.secs) for r in text.parse_point_topology(text.read_lines(spark, p)).collect())
    assert rows == [("1.0,2.0", "3.0,4.0", "r1", 30.0), ("1.0,2.0", "5.0,6.0", "r2", 60.0),
                    ("3.0,4.0", "1.0,2.0", "r1", 30.0)]


def test_road_topology_scan_missing_and_trailing_lists(spark, tmpdir_path):
    p = _write(
        f"{tmpdir_path}/topo.txt",
        ["1,1.0,2.0,3.0,4.0|1.0,2.0:2,3|3.0,4.0", "2,1.0,2.0,5.0,6.0|1.0,2.0:1,|5.0,6.0:", "3,1,2,3,4|1,2:1"],
    )
    t = {r.road_id: r for r in text.parse_road_topology(text.read_lines(spark, p)).collect()}
    assert t["1"].start_roads == ["2", "3"] and t["1"].end_roads == []
    assert t["2"].start_roads == ["1"] and t["2"].end_roads == []
    assert t["3"].end_roads == []  # missing third part: empty, not an error
    adj = sorted(tuple(r) for r in text.road_topology_adj(text.parse_road_topology(text.read_lines(spark, p))).collect())
    assert ("1", 1, "2") in adj and all(r[0] != "x" for r in adj)


def test_grid_index_scan(spark, tmpdir_path):
    lines = [
        json.dumps({"GeoHash": "wqj6z1a", "nodes": [{"RoadId": "5", "LonLats": ["1,2", "3,4"]}, {"RoadId": "6", "LonLats": []}]}),
        json.dumps({"GeoHash": "wqj6z1b", "nodes": [{"RoadId": "5", "LonLats": ["5,6"]}]}),
    ]
    p = _write(f"{tmpdir_path}/grid.json", lines)
    rows = sorted((r.cell, r.road_id, tuple(r.lonlats)) for r in text.read_grid_index(spark, p).collect())
    assert rows == [("wqj6z1a", "5", ("1,2", "3,4")), ("wqj6z1a", "6", ()), ("wqj6z1b", "5", ("5,6",))]


def test_written_layouts_round_trip(spark, tmpdir_path):
    """Fixture network -> text files -> scans: same roads and edges back."""
    from wayfold.sources.network import load_network

    net = load_network(spark, "/root/testdata/sf0.001")
    text.write_lines(text.format_road_attrs(net.roads), f"{tmpdir_path}/attrs")
    back = text.parse_road_attrs(text.read_lines(spark, f"{tmpdir_path}/attrs"))
    assert back.count() == net.roads.count()
    assert back.join(net.roads.select("road_id", "km", "secs"), ["road_id", "km", "secs"]).count() == net.roads.count()
    text.write_lines(text.format_point_topology(net.edges, net.roads, net.junctions), f"{tmpdir_path}/pt")
    assert text.parse_point_topology(text.read_lines(spark, f"{tmpdir_path}/pt")).count() == net.edges.count()


def test_grid_line_is_not_carried_beside_each_of_its_roads(spark):
    from wayfold.sources import text

    lines = spark.createDataFrame([('{"GeoHash":"g","nodes":[{"RoadId":"1","LonLats":["1,2"]},{"RoadId":"2","LonLats":[]}]}',), ("no json",), ('{"GeoHash":"h"}',)], "value string")
    grid = text.parse_grid_index(lines)
    assert sorted(tuple(r) for r in grid.collect()) == [("g", "1", ["1,2"]), ("g", "2", [])]
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate" in x)
    node = grid._jdf.queryExecution().optimizedPlan()
    while not node.nodeName() == "Generate":
        node = node.children().head()
    kept = [node.requiredChildOutput().apply(i).name() for i in range(node.requiredChildOutput().size())]
    assert kept == ["cell"], generate


def test_grid_line_is_gathered_and_parsed_as_texts_of_roads(spark):
    """Neither side holds all points of a cell as objects: roads become text before they are gathered, and points are parsed after the explode."""
    from pyspark.sql import functions as F

    rows = [('c"1', "r1", ["1,2", '3"']), ('c"1', None, ["x"]), ('c"1', "a\\b", None), ('c"1', "é", [None, "n"]), (None, "r", ["q"]), (None, "r2", []), ("z", "only", ["p"]), ("y", "1", ["é\n"]), ("y", "2", ["t"])]
    grid = spark.createDataFrame(rows, "cell string, road_id string, lonlats array<string>")
    whole = F.array_sort(F.collect_list(F.struct(F.col("road_id").alias("RoadId"), F.col("lonlats").alias("LonLats"))))
    want = grid.groupBy("cell").agg(whole.alias("nodes")).select(F.to_json(F.struct(F.col("cell").alias("GeoHash"), "nodes")).alias("value"))
    lines = text.format_grid_index(grid)
    assert sorted(r.value for r in lines.collect()) == sorted(r.value for r in want.collect())
    back = text.parse_grid_index(lines)
    assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(map(repr, rows))
    node = back._jdf.queryExecution().optimizedPlan()
    while not node.nodeName() == "Generate":
        node = node.children().head()
    assert node.generatorOutput().last().dataType().simpleString() == "string"
    assert "collect_list(struct(road_id" in node.toString() and ", text," in node.toString()
    odd = spark.createDataFrame([('{"GeoHash":"k","nodes":[5,{"RoadId":"1"}]}',), ('{"GeoHash":"l","nodes":[null,{"RoadId":2,"LonLats":"a"}]}',)], "value string")
    assert sorted(map(repr, (tuple(r) for r in text.parse_grid_index(odd).collect()))) == ["('l', '2', None)", "('l', None, None)"]
