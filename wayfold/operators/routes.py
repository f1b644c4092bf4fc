"""Routes from search labels: rebuild, flatten, point paths to roads, sinks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.operators.regions import ROWS, codes, whole
from wayfold.session import spread
from wayfold.tables import Bucketed, cut, dealt, scratch

#: Levels of routes that are built in one job.
CHAIN = 3
#: Steps of all routes of a start, up to which a task walks them back.
STEPS = 2_000_000


def rebuild_routes(labels: DataFrame, element: str = "road_id", most: int = STEPS) -> DataFrame:
    """Road list from the root to every labelled node.

    labels (start, node, cost, pred, road_id, hops): predecessor tree per start.  The trees of some starts, of about ``most``
    steps together, are one group, which a task walks back all at once; so labels are shuffled once.  A start with
    more steps than that goes by ``rebuild_by_levels``.

    ``element`` is the label column listed per step: ``road_id`` gives the road list, ``node`` the point list (root
    excluded).  Returns (start, node, cost, hops, route ARRAY<...>) for every label, root included (empty route).
    """
    size = Observation()
    steps = F.col("hops") + 1
    labels = cut(labels.observe(size, F.sum(steps).alias("steps")), "labels")
    heavy = cut(labels.groupBy("start").agg(F.sum(steps).alias("steps")).where(F.col("steps") > most).select("start"), "heavy")
    some = not heavy.isEmpty()
    small = labels.join(heavy, "start", "left_anti") if some else labels
    kinds = dict(labels.dtypes)
    part = F.pmod(F.xxhash64("start"), F.lit((size.get["steps"] or 0) * 4 // most + 1)).alias("part")
    rows = small.select(part, "start", "node", "cost", "pred", F.col(element).alias("element"), "hops")
    schema = f"start {kinds['start']}, node {kinds['node']}, cost double, hops int, route array<{kinds[element]}>"
    routes = spread(rows, "part").groupBy("part").applyInArrow(_walk, schema)
    return routes.unionByName(rebuild_by_levels(labels.join(heavy, "start", "left_semi"), element)) if some else routes


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The routes of whole trees: every label steps back to its predecessor's until it is at its root.

    Rows with hops -1, if any, name the nodes that are wanted; then roots and other nodes give no row."""
    table = pa.Table.from_batches(list(batches)).sort_by([("hops", "ascending")])
    wanted = table.filter(pc.less(table["hops"], 0))
    table = table.slice(len(wanted))
    if not len(table):
        return
    (start, of), _ = codes(table["start"], wanted["start"])
    (node, pred, goal), nodes = codes(table["node"], table["pred"], wanted["node"])
    hops = whole(table["hops"]).to_numpy().astype(np.int64)
    key, n = start * len(nodes) + node, len(nodes)
    order = np.argsort(key, kind="stable")
    parent = order[np.minimum(np.searchsorted(key[order], start * n + pred), len(key) - 1)]
    good = (hops == 0) | ((key[parent] == start * n + pred) & (hops[parent] == hops - 1))
    edge = np.searchsorted(hops, np.arange(hops[-1] + 2))
    for level in range(1, hops[-1] + 1):
        good[edge[level] : edge[level + 1]] &= good[parent[edge[level] : edge[level + 1]]]
    rows = np.flatnonzero(good & (hops > 0) & np.isin(key, of * n + goal) if len(wanted) else good)
    element = whole(table["element"])
    for k in range(0, len(rows), ROWS):
        own = rows[k : k + ROWS]
        at, end = own, np.cumsum(hops[own])
        steps = np.empty(end[-1], np.int64)
        for back in range(1, hops[own].max() + 1):
            on = hops[own] >= back
            steps[end[on] - back] = at[on]
            at = parent[at]
        route = pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), element.take(pa.array(steps)))
        here = pa.array(own)
        yield pa.RecordBatch.from_arrays([*[whole(table[c]).take(here) for c in ("start", "node", "cost", "hops")], route], ["start", "node", "cost", "hops", "route"])


def rebuild_by_levels(labels: DataFrame, element: str = "road_id", trace: list | None = None) -> DataFrame:
    """Road list from the root to every labelled node, level by level over the number of hops.

    labels (start, node, cost, pred, road_id, hops): predecessor tree per start.  The routes of one level are the
    finished prefixes of the next: a level's labels, dealt by their predecessor, meet the routes of the level before, which
    are bucketed by their node and do not move.  So every label and every route is shuffled once, and a round
    holds the rows of ``CHAIN`` levels only.  There are as many levels as the longest route has roads, which the search needed too.

    ``element`` is the label column listed per step: ``road_id`` gives the road list, ``node`` the point list (root
    excluded).  ``trace`` gets (first level, routes) for every round.

    Returns (start, node, cost, hops, route ARRAY<...>) for every label, root included (empty route).
    """
    spark = labels.sparkSession
    etype = dict(labels.dtypes)[element]
    steps = Bucketed(spark, "steps", ["start", "pred"], ["hops"])
    seen = Observation()
    own = F.col("node") if element == "node" else F.col(element)
    rows = labels.select("start", "node", "cost", "pred", own.alias("element"), "hops").where("hops > 0")
    steps.append(rows.observe(seen, F.max("hops").alias("most")))
    routes = Bucketed(spark, "routes", ["start", "node"], ["hops"])
    routes.append(labels.where("hops = 0").select("start", "node", "cost", F.array().cast(f"array<{etype}>").alias("route"), "hops"))
    for first in range(1, (seen.get["most"] or 0) + 1, CHAIN):
        above = routes.read().where(F.col("hops") == first - 1).select("start", "node", "route")
        parts = []
        for level in range(first, min(first + CHAIN, seen.get["most"] + 1)):
            here = steps.read().where(F.col("hops") == level).join(above.select("start", F.col("node").alias("pred"), F.col("route").alias("prefix")), ["start", "pred"])
            here = here.select("start", "node", "cost", F.concat("prefix", F.array("element")).alias("route"), F.lit(level).alias("hops"))
            above = here.repartition(routes.n, "start", "node")  # written, and read by the next level, from one exchange
            parts.append(above)
        count = Observation()
        done = reduce(DataFrame.unionByName, parts).observe(count, F.count(F.lit(1)).alias("rows"))
        routes.append(dealt(done, "start", "node"))
        if trace is not None:
            trace.append((first, count.get["rows"]))
    steps.drop()
    return routes.close().select("start", "node", "cost", "hops", "route")


def routes_to(labels: DataFrame, wanted: DataFrame, trace: list | None = None, most: int = STEPS) -> DataFrame:
    """Road lists of the wanted (start, node) only, walked back from there.

    As in ``rebuild_routes`` a task walks back all routes of some starts, of about ``most`` steps together; labels and wanted
    nodes are shuffled once.  A start with more steps, or with labels of endless cost, whose hops need not fit, goes by rounds (``routes_by_rounds``).  ``labels`` is read several times, so it
    should be a table.  ``trace`` gets (round, open routes) of the rounds.
    Returns (start, node, cost, route); nodes without a label, and roots themselves, have no row.
    """
    kinds = dict(labels.dtypes)
    size = Observation()
    sums = labels.groupBy("start").agg(F.sum(F.col("hops") + 1).alias("steps"), F.max("cost").alias("dearest")).observe(size, F.sum("steps").alias("steps"))
    heavy = cut(sums.where((F.col("steps") > most) | (F.col("dearest") == math.inf)).select("start"), "heavy")
    part = F.pmod(F.xxhash64("start"), F.lit((size.get["steps"] or 0) * 4 // most + 1)).alias("part")
    rows = labels.select(part, "start", "node", "cost", "pred", F.col("road_id").alias("element"), "hops")
    none = [F.lit(None).cast(kinds[c]).alias(n) for c, n in (("cost", "cost"), ("pred", "pred"), ("road_id", "element"))]
    goals = wanted.select(part, F.col("start").cast(kinds["start"]).alias("start"), F.col("node").cast(kinds["node"]).alias("node"), *none, F.lit(-1).alias("hops"))
    some = not heavy.isEmpty()
    rows = rows.unionByName(goals)
    if some:
        rows = rows.join(heavy, "start", "left_anti").select(*rows.columns)
    schema = f"start {kinds['start']}, node {kinds['node']}, cost double, hops int, route array<string>"
    # a part with labels but without a wanted node would give all its routes: such starts are left out
    known = spread(rows.join(wanted.select("start").distinct(), "start", "left_semi"), "part").groupBy("part").applyInArrow(_walk, schema).select("start", "node", "cost", "route")
    if not some:
        if trace is not None:
            trace.append((0, 0))
        return known
    return known.unionByName(routes_by_rounds(*(df.join(heavy, "start", "left_semi") for df in (labels, wanted)), trace))


def routes_by_rounds(labels: DataFrame, wanted: DataFrame, trace: list | None = None) -> DataFrame:
    """``routes_to`` for starts of any size.

    Each round moves the routes that are not at their root yet to their front road's label, which stands in its bucket; a route
    that has arrived is set aside and read no more, so the rounds hold ever fewer rows.  ``trace`` gets (round, open routes).
    """
    log = labels.select("start", F.col("node").alias("at"), "pred", "road_id", "hops")
    open_ = wanted.select("start", "node").distinct().join(labels, ["start", "node"]).where("hops > 0")
    open_ = open_.select("start", "node", "cost", F.col("pred").alias("at"), F.array("road_id").alias("route"), (F.col("hops") - 1).alias("left"))
    parts, k = [], 0
    while True:
        path = scratch(labels.sparkSession, "walk")
        count = Observation()
        now = open_.withColumn("done", F.col("left") == 0).observe(count, F.count(F.when(F.col("left") > 0, 1)).alias("open"))
        now.write.partitionBy("done").parquet(path)
        table = labels.sparkSession.read.schema(now.schema).parquet(path)
        parts.append(table.where("done").select("start", "node", "cost", "route"))
        if trace is not None:
            trace.append((k, count.get["open"]))
        if not count.get["open"]:
            return reduce(DataFrame.unionByName, parts)
        k += 1
        step = table.where("not done").join(log, ["start", "at"])
        open_ = step.select("start", "node", "cost", F.col("pred").alias("at"), F.concat(F.array("road_id"), F.col("route")).alias("route"), (F.col("left") - 1).alias("left"))


def exploded_routes(routes: DataFrame) -> DataFrame:
    """One row per road of each route: (start, dst, pos, road_id), pos from 1."""
    return routes.select(
        "start", "dst", F.posexplode("route").alias("pos", "road_id")
    ).withColumn("pos", F.col("pos") + 1)


def point_path_roads(point_paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Consecutive points of a path -> road ids (the reference's point-to-road
    step).  Between two points the cheapest edge is taken (tie: smallest id).

    point_paths (start, dst, points ARRAY<node>) -> (start, dst, route ARRAY<STRING>)
    """
    steps = point_paths.select(
        "start", "dst", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1),
                                                   F.slice("points", 2, F.size("points")))).alias("pos", "uv")
    ).select("start", "dst", "pos", F.col("uv")["0"].alias("u"), F.col("uv")["1"].alias("v"))
    cheapest = edges.groupBy("src", "dst").agg(F.min(F.struct("secs", "road_id")).alias("m"))
    joined = steps.join(
        cheapest.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("m.road_id").alias("road_id")),
        ["u", "v"],
    )
    return joined.groupBy("start", "dst").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "road_id"))), lambda s: s["road_id"]).alias("route")
    )


def format_cost(cost) -> F.Column:
    return F.format_string("%.3f", cost)


def route_lines(results: DataFrame) -> DataFrame:
    """Sink text of a result: ``cost:r1,r2,...`` (cost with 3 decimals)."""
    return results.select(
        *[c for c in results.columns if c not in ("cost", "route", "within")],
        F.concat(format_cost(F.col("cost")), F.lit(":"), F.array_join("route", ",")).alias("line"),
    )


def write_route_lines(results: DataFrame, path: str) -> None:
    route_lines(results).select("line").write.mode("overwrite").text(path)
