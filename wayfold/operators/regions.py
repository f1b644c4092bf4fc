"""Searches from many starts in small regions: the region by joins, the labels of its starts inside tasks.

``frontier.search`` keeps a row for each (start, node) and goes over all of them in every round.  Where starts are many and
their regions small, neighbouring starts see nearly the same nodes.  ``search`` puts starts that lie beside each other into
groups, finds with ``frontier.search`` the nodes that any start of a group can reach within the limit (a row for each group and
node), joins these with their edges and labels all starts of a group over them in one task.  ``keyed_search`` does the same for
edge sets that each start brings along.  Both give the labels of ``frontier.search``.  ``search_to`` is for starts with targets
instead of a limit, over edges with places: it guesses a limit, and starts with a target beyond it go on with twice as much.

Place and group decide the work only, never a label.  A group or a start with more than ``MOST`` edges would be a
task of its own; its starts go through ``frontier.search``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.operators import frontier
from wayfold.session import spread
from wayfold.tables import cut

#: Starts of a group.
GROUP = 1000
#: Edges that a task takes in at once.
MOST = 1_000_000
#: (start, node) that a task labels at once, and rows of a batch it gives back.
CELLS = 2_000_000
ROWS = 100_000
#: Points of the starts' own regions that are labelled together.
POINTS = 20_000
NEVER = np.iinfo(np.int32).max
#: Mean steps within which targets are looked for at first, and how often twice as many are tried.
NEAR = 12.0
TRIES = 4
#: Starts of a tile that a task labels.
TILE = 4000


def relax(root: np.ndarray, n: int, rows: int, src: np.ndarray, dst: np.ndarray, secs: np.ndarray, step: Callable, limit: float, dear: float | None, goals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, hops, edge) of every cell ``row * n + node``, the least of all paths from the row's roots; hops is NEVER where none leads.

    Edges are numbered in the order of (road_id, src), so that an edge's number settles ties.  With ``goals`` (cells), only these
    and the cells on their paths need be right: what is dearer than the dearest goal of its row is not followed."""
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1))
    cost, hops, edge = np.full(rows * n, np.inf), np.full(rows * n, NEVER, np.int32), np.full(rows * n, -1, np.int64)
    cost[root], hops[root] = 0.0, 0
    active = root
    while len(active):
        if goals is None:
            active = active[cost[active] <= limit]
        else:
            bound = np.full(rows, -np.inf)
            np.maximum.at(bound, goals // n, cost[goals])
            bound = np.minimum(bound, limit)
            active = active[cost[active] <= bound[active // n]]
        node = active % n
        many = first[node + 1] - first[node]
        at = np.repeat(np.arange(len(active)), many)
        e = order[first[node][at] + np.arange(len(at)) - (np.cumsum(many) - many)[at]]
        total, key, h = step(cost[active][at], secs[e]), (active - node)[at] + dst[e], hops[active][at] + 1
        keep = total <= cost[key]
        if dear is not None:
            keep &= total < dear
        if goals is not None:
            keep &= total <= bound[key // n]
        total, key, h, e = total[keep], key[keep], h[keep], e[keep]
        by = np.lexsort((e, h, total, key))
        by = by[np.diff(key[by], prepend=-1) != 0]
        total, key, h, e = total[by], key[by], h[by], e[by]
        less = (total < cost[key]) | (h < hops[key]) | ((h == hops[key]) & (e < edge[key]))  # none is dearer
        active = key[less]
        cost[active], hops[active], edge[active] = total[less], h[less], e[less]
    return cost, hops, edge


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers for the values of columns of one type, nulls included, and the values by number."""
    found = pa.concat_arrays([whole(c) for c in columns]).dictionary_encode(null_encoding="encode")
    return np.split(found.indices.to_numpy().astype(np.int64), np.cumsum([len(c) for c in columns])[:-1]), found.dictionary


def _labels(rows: DataFrame, key: str, keyed: bool, penalty: float, penalty_first: bool, limit: float | None, dear: float | None) -> DataFrame:
    """Labels of the starts in ``rows`` (key, root, start, src, dst, road_id, secs): a root's node is its src; start is null at shared edges."""
    kinds = dict(rows.dtypes)
    limit = math.inf if limit is None else limit

    def step(cost: np.ndarray, secs: np.ndarray) -> np.ndarray:
        return cost + penalty + secs if penalty_first else cost + secs + penalty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        roots, edges = table.filter(table["root"]), table.filter(pc.invert(table["root"]))
        edges = edges.take(pc.sort_indices(edges, sort_keys=[("road_id", "ascending"), ("src", "ascending")], null_placement="at_start"))
        (at, src, dst), nodes = codes(roots["src"], edges["src"], edges["dst"])
        (row, own), starts = codes(roots["start"], edges["start"])
        n, secs, road = len(nodes), whole(edges["secs"]).to_numpy(), whole(edges["road_id"])
        pred = np.append(src, 0)  # a root's edge, -1, is none
        parts = []
        if keyed:  # every (start, node) is a node of the one row
            cells, found = np.unique(np.concatenate([row * n + at, own * n + src, own * n + dst]), return_inverse=True)
            at, src, dst = np.split(found, np.cumsum([len(at), len(src)]))
            parts.append((at, len(cells), 1))
        else:
            who, row = np.unique(row, return_inverse=True)
            each = max(1, CELLS // max(n, 1))
            for k in range(0, len(who), each):
                here = (row >= k) & (row < k + each)
                parts.append(((row[here] - k) * n + at[here], n, min(each, len(who) - k)))
        done = 0
        for root, width, height in parts:
            cost, hops, edge = relax(np.unique(root), width, height, src, dst, secs, step, limit, dear)
            got = np.flatnonzero(hops != NEVER)
            for k in range(0, len(got), ROWS):
                cell = got[k : k + ROWS]
                start, node = (cells[cell] // n, cells[cell] % n) if keyed else (who[done + cell // n], cell % n)
                by = edge[cell]
                yield pa.RecordBatch.from_arrays(
                    [starts.take(pa.array(start)), nodes.take(pa.array(node)), pa.array(cost[cell]), nodes.take(pa.array(pred[by], mask=by < 0)), road.take(pa.array(by, mask=by < 0)), pa.array(hops[cell])],
                    frontier.LABEL_COLS,
                )
            done += height

    schema = f"start {kinds['start']}, node {kinds['src']}, cost double, pred {kinds['src']}, road_id string, hops int"
    return spread(rows, key).groupBy(key).applyInArrow(run, schema)


def _rows(key: str, starts: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = dict(edges.dtypes)
    start = F.col("start") if "start" in edges.columns else F.lit(None).cast(dict(starts.dtypes)["start"]).alias("start")
    own = edges.select(key, F.lit(False).alias("root"), start, "src", "dst", F.col("road_id").cast("string").alias("road_id"), F.col("secs").cast("double").alias("secs"))
    none = [F.lit(None).cast(kinds["dst"]).alias("dst"), F.lit(None).cast("string").alias("road_id"), F.lit(None).cast("double").alias("secs")]
    return own.unionByName(starts.select(key, F.lit(True).alias("root"), "start", F.col("node").alias("src"), *none))


def _usable(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("secs") >= 0) & ~F.isnan("secs"))


def _curve(x: Column, y: Column) -> Column:
    """The place of whole numbers below 2**20 on the Z curve."""

    def wide(v: Column) -> Column:
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return wide(x).bitwiseOR(F.shiftleft(wide(y), 1))


def grouped(starts: DataFrame, size: int = GROUP) -> DataFrame:
    """(part, start, node): starts in groups of at most ``size`` that lie beside each other, by their places (x, y) if there, else by their order.

    The start with all its nodes is in one group."""
    place = F.lit(0)
    if {"x", "y"} <= set(starts.columns):
        good = F.abs("x") + F.abs("y") < 1e300  # neither null, NaN nor infinite
        x0, x1, y0, y1 = starts.where(good).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        scale = (1 << 20) / (max(x1 - x0, y1 - y0) or 1.0) if x0 is not None else 1.0
        at = [F.least(F.floor((F.col(c) - low) * scale), F.lit((1 << 20) - 1)) for c, low in (("x", x0 or 0.0), ("y", y0 or 0.0))]
        place = F.when(good, _curve(*at))
    own = starts.select("start", "node", place.cast("long").alias("place")).groupBy("start").agg(F.min("place").alias("place"), F.collect_set(F.struct("node")).alias("nodes"))
    own = own.repartitionByRange(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "start").sortWithinPartitions("place", "start")
    number = F.monotonically_increasing_id()  # its low 33 bits count the rows of a partition
    part = number - number.bitwiseAND(F.lit((1 << 33) - 1)) % size
    return cut(own.select(part.alias("part"), "start", "nodes"), "groups").select("part", "start", F.explode("nodes").alias("n")).select("part", "start", "n.node")


def search(starts: DataFrame, edges: DataFrame, *, limit: float, penalty: float = 0.0, penalty_first: bool = False, cut_secs: float | None = None, size: int = GROUP, most: int = MOST) -> DataFrame:
    """The labels of ``frontier.search`` for starts (start, node) [, x, y] over shared edges (src, dst, road_id, secs), within ``limit``."""
    how = {"penalty": penalty, "penalty_first": penalty_first, "limit": limit}
    edges = cut(_usable(edges).select("src", "dst", "road_id", "secs"), "edges")
    named = grouped(starts, size)
    region = frontier.search(named.select(F.col("part").alias("start"), "node"), edges, cut=cut_secs, **how)
    own = cut(region.where(F.col("cost") <= float(limit)).select(F.col("start").alias("part"), F.col("node").alias("src")).join(edges, "src"), "region-edges")
    large = cut(own.groupBy("part").count().where(F.col("count") > most).select("part"), "large")
    if large.isEmpty():
        return _labels(_rows("part", named, own), "part", False, dear=cut_secs, **how)
    small = _labels(_rows("part", named.join(large, "part", "left_anti"), own.join(large, "part", "left_anti")), "part", False, dear=cut_secs, **how)
    return small.unionByName(frontier.search(named.join(large, "part", "left_semi").select("start", "node"), edges, cut=cut_secs, **how))


def keyed_search(starts: DataFrame, points: DataFrame, edges: DataFrame, *, cut_secs: float | None = None, most: int = MOST // 4) -> DataFrame:
    """The labels of ``frontier.search`` for starts (start, node) over edges of their own (start, src, dst, road_id, secs) between ``points`` (start, node)."""
    starts, edges = starts.select("start", "node").distinct(), _usable(edges)
    key = F.pmod(F.xxhash64("start"), F.lit(points.count() // POINTS + 1)).alias("part")
    large = cut(points.groupBy("start").count().where(F.col("count") > most).select("start"), "large")

    def small(df: DataFrame) -> DataFrame:
        return df if large.isEmpty() else df.join(F.broadcast(large), "start", "left_anti")

    out = _labels(_rows("part", small(starts).select(key, "*"), small(edges).select(key, "*")), "part", True, 0.0, False, None, cut_secs)
    if large.isEmpty():
        return out
    return out.unionByName(frontier.search(starts.join(large, "start", "left_semi"), edges.join(large, "start", "left_semi"), cut=cut_secs, edges_keyed_by_start=True))


def _labels_to(rows: DataFrame, limit: float) -> DataFrame:
    """Labels of the targets and of the nodes on their routes, for the starts that have all their targets within ``limit``, from
    rows (part, kind, start, src, dst, road_id, secs): a start's root (kind 1) and target (2) is its src, kind 0 are the shared edges.
    A start with a target beyond gives one row, with hops -1."""
    kinds = dict(rows.dtypes)

    def step(cost: np.ndarray, secs: np.ndarray) -> np.ndarray:
        return cost + secs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        edges, roots, asked = (table.filter(pc.equal(table["kind"], k)) for k in range(3))
        edges = edges.take(pc.sort_indices(edges, sort_keys=[("road_id", "ascending"), ("src", "ascending")], null_placement="at_start"))
        (at, goal, src, dst), nodes = codes(roots["src"], asked["src"], edges["src"], edges["dst"])
        (row, of), starts = codes(roots["start"], asked["start"])
        n, secs, road = len(nodes), whole(edges["secs"]).to_numpy(), whole(edges["road_id"])
        pred = np.append(src, 0)  # a root's edge, -1, is none
        each = max(1, CELLS // n)
        for k in range(0, len(starts), each):
            height, here, own = min(each, len(starts) - k), (row >= k) & (row < k + each), (of >= k) & (of < k + each)
            goals = np.unique((of[own] - k) * n + goal[own])
            cost, hops, edge = relax(np.unique((row[here] - k) * n + at[here]), n, height, src, dst, secs, step, limit, None, goals)
            beyond = np.zeros(height, bool)
            beyond[goals[(hops[goals] == NEVER) | (cost[goals] > limit)] // n] = True
            met, on = np.zeros(height * n, bool), goals[~beyond[goals // n]]
            while len(on):
                met[on] = True
                on = on[edge[on] >= 0]
                on = np.unique(on - on % n + src[edge[on]])
                on = on[~met[on]]
            got = np.flatnonzero(met)
            for j in range(0, len(got), ROWS):
                cell = got[j : j + ROWS]
                by = edge[cell]
                yield pa.RecordBatch.from_arrays(
                    [starts.take(pa.array(k + cell // n)), nodes.take(pa.array(cell % n)), pa.array(cost[cell]), nodes.take(pa.array(pred[by], mask=by < 0)), road.take(pa.array(by, mask=by < 0)), pa.array(hops[cell])],
                    frontier.LABEL_COLS,
                )
            open_ = k + np.flatnonzero(beyond)
            none = [pa.nulls(len(open_), t) for t in (nodes.type, pa.float64(), nodes.type, road.type)]
            yield pa.RecordBatch.from_arrays([starts.take(pa.array(open_)), *none, pa.array(np.full(len(open_), -1, np.int32))], frontier.LABEL_COLS)

    schema = f"start {kinds['start']}, node {kinds['src']}, cost double, pred {kinds['src']}, road_id string, hops int"
    return spread(rows, "part").groupBy("part").applyInArrow(run, schema)


def _placed(edges: DataFrame) -> tuple[DataFrame, DataFrame, float, float]:
    """Edges (src, dst, road_id, secs, x, y) with the place of their src, all nodes' places (node, x, y), the mean step and the greatest speed
    over the plane, which is infinite where a node has no place or an edge takes no time.  A node has one place, the least its edges give."""
    full = _usable(edges)
    good = lambda c: F.abs(c + "_x") + F.abs(c + "_y") < 1e300
    ends = [full.select(F.col(c).alias("node"), F.when(good(c), F.struct(F.col(c + "_x").cast("double").alias("x"), F.col(c + "_y").cast("double").alias("y"))).alias("at")) for c in ("src", "dst")]
    nodes = cut(ends[0].unionByName(ends[1]).groupBy("node").agg(F.min("at").alias("at")).select("node", "at.x", "at.y"), "places")
    slim = full.select("src", "dst", F.col("road_id").cast("string").alias("road_id"), F.col("secs").cast("double").alias("secs"))
    both = slim.join(nodes.withColumnRenamed("node", "src"), "src").join(nodes.select(F.col("node").alias("dst"), F.col("x").alias("to_x"), F.col("y").alias("to_y")), "dst")
    span = F.hypot(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y"))
    speed = F.when(span.isNull() | ((span > 0) & (F.col("secs") == 0)), F.lit(math.inf)).when(span > 0, span / F.col("secs")).otherwise(F.lit(0.0))
    seen = Observation()
    placed = both.observe(seen, F.avg(F.when(F.col("secs") < math.inf, F.col("secs"))).alias("mean"), F.max(speed).alias("speed"))
    placed = cut(placed.select("src", "dst", "road_id", "secs", "x", "y"), "edges")
    return placed, nodes, seen.get["mean"] or 0.0, seen.get["speed"] or 0.0


def search_to(starts: DataFrame, targets: DataFrame, edges: DataFrame, *, near: float = NEAR, size: int = TILE, most: int = MOST, trace: list | None = None) -> DataFrame:
    """The labels of ``frontier.search(starts, edges, targets=targets)``, those of the targets and of the nodes on their routes at least.

    starts (start, node); targets (start, node) [, x, y], all reachable; edges (src, dst, road_id, secs, src_x, src_y, dst_x, dst_y).
    Starts are grouped by square tiles.  A path of at most some cost goes no farther, on the plane, than that times the greatest speed, so a
    tile's starts find all such paths in the edges up to that far around it.  The cost is ``near`` mean steps at first; starts with a target beyond
    go on with twice as much, ``TRIES`` times at most, and then, like those of tiles with too many edges, through ``frontier.search``."""
    placed, nodes, mean, speed = _placed(edges)
    done, rest, left, limit = [], [], None, near * mean
    kinds = {**dict(placed.dtypes), "start": dict(starts.dtypes)["start"]}
    names = {c: c for c in ("src", "dst", "road_id", "secs")}

    def rows(kind: int, df: DataFrame, own: dict[str, str]) -> DataFrame:
        return df.select("part", F.lit(kind).alias("kind"), *[F.col(own[c]).alias(c) if c in own else F.lit(None).cast(kinds[c]).alias(c) for c in ("start", *names)])

    if math.isfinite(speed * limit):
        left = cut(starts.select("start", "node").join(nodes, "node"), "starts")  # a start without an edge has no target
    for _ in range(TRIES if left is not None else 0):
        far = nodes.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
        pad = max(speed * limit * (1 + 1e-6), far * 1e-9) or 1.0
        side = 2 * pad

        def tile(c: str, off: float) -> Column:
            return F.floor((F.col(c) + off) / side)

        around = [F.explode(F.sequence(tile(c, -pad), tile(c, pad))).alias("t" + c) for c in ("x", "y")]
        named = cut(left.select("start", "node", tile("x", 0.0).alias("tx"), tile("y", 0.0).alias("ty")), "named")
        tiles = cut(named.groupBy("tx", "ty").agg((F.ceil(F.count_distinct("start") / size)).alias("parts")), "tiles")
        near_edges = placed.select(*names, "y", around[0]).select(*names, "tx", around[1]).join(tiles, ["tx", "ty"])
        own = cut(near_edges, "tile-edges")
        large = cut(own.groupBy("tx", "ty").count().where(F.col("count") > most).select("tx", "ty"), "large")
        if not large.isEmpty():
            rest.append(cut(named.join(large, ["tx", "ty"], "left_semi").select("start").distinct(), "rest"))
            named, own, tiles = (df.join(large, ["tx", "ty"], "left_anti") for df in (named, own, tiles))
        part = F.concat_ws("/", "tx", "ty", "k").alias("part")
        named = named.join(tiles, ["tx", "ty"]).withColumn("k", F.pmod(F.xxhash64("start"), F.col("parts"))).select(part, "start", "node")
        own = own.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(part, *names)
        asked = named.select("part", "start").distinct().join(targets.select("start", "node"), "start")
        parts = rows(0, own, names).unionByName(rows(1, named, {"start": "start", "src": "node"})).unionByName(rows(2, asked, {"start": "start", "src": "node"}))
        count = Observation()
        found = cut(_labels_to(parts, limit).observe(count, F.count(F.when(F.col("hops") < 0, 1)).alias("open")), "labels")
        done.append(found.where("hops >= 0"))
        if trace is not None:
            trace.append((limit, count.get["open"]))
        if not count.get["open"]:
            left = None
            break
        left, limit = cut(left.join(found.where("hops < 0").select("start").distinct(), "start", "left_semi"), "starts"), 2 * limit
    if not done:
        return frontier.search(starts.select("start", "node"), edges, targets=targets, trace=trace)
    if left is not None:
        rest.append(left.select("start").distinct())
    if rest:
        rest = cut(reduce(DataFrame.unionByName, rest), "rest")
        done.append(frontier.search(starts.join(rest, "start", "left_semi").select("start", "node"), edges, targets=targets.join(rest, "start", "left_semi"), trace=trace))
    return reduce(DataFrame.unionByName, done)
