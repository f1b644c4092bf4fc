"""Multi-source search in rings of cost, on tables that stay where they are.

One loop serves every search of the reference (road reach, uniform-cost search, region Dijkstra, point-to-point
routes).  All distinct starts are searched together.  Labels ``(start, node, cost, hops, road_id, pred)`` stand in a log that is
bucketed by ``(start, node)``; edges are placed once, sent out if measured small, else bucketed by their source.

Costs are cut into rings of one width.  A round expands the labels of the cheapest open ring only:

  log --rows of the ring--> labels --join--> edges --> candidates
  candidates --partial minimum, exchange--> union log (no exchange) --minimum--> what is new --> log

so what is shuffled follows the active labels, never the state; the log is read where it lies.  When the width is no more than the cheapest step, a ring is final when it is expanded.  With cheaper
steps in a ring, it is gone over again for its new labels until there are none.  Where rounds find little, the
next takes twice as many rings, so that a long thin tail of costs does not take a round for each ring.  The log keeps
improvements as rows; every ``COMPACT`` rounds it is rewritten with one row for each label, bucket by bucket.

A label is the least ``(cost, hops, road_id, pred)`` of all its paths.  Every hop adds to ``hops``, so the predecessors form a
tree even over edges without cost, and the result depends on neither the order of rounds nor on partitions.  A synchronous
relaxation with the rule "replace only by a strictly cheaper label, ties by (road_id, pred)" gives the same labels, which is what the oracle runs.

The result is exact: no cap on rounds, frontier or candidates.  ``max_rounds`` guards against a search without an end and
raises instead of truncating.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.tables import BROADCAST_BYTES, Bucketed, Placed, dealt, discard
from wayfold.tables import cut as write_once

LABEL_COLS = ["start", "node", "cost", "pred", "road_id", "hops"]
#: Rounds between two rewritings of the log.
COMPACT = 16
#: Rounds between two looks at the targets that are still open; an older look prunes less, not wrongly.
LOOK = 4
#: A round that finds less than this part of the largest one doubles the number of rings taken at once.
THIN = 0.25
#: A ring is at least so many mean steps wide: fewer rounds, against some labels that are expanded twice.
LEAST_WIDTH = 4.0
#: Rings ahead of the present one that a round reports one by one; further ones are looked up in the log.
AHEAD = 62


def _name(round_: int) -> str:
    """A round's number as text of its order."""
    return f"{round_:08d}"


def _label() -> Column:
    """A label, ordered."""
    return F.struct("cost", "hops", "road_id", "pred")


def _best(log: DataFrame) -> DataFrame:
    """One row for each (start, node): an aggregate inside the log's buckets."""
    return log.groupBy("start", "node").agg(F.min(F.struct(_label().alias("l"), "round")).alias("m")).select("start", "node", "m.l.*", "m.round")


def _box_distance(speed: float | None) -> str:
    """Least seconds from an edge's end to the box of a start's open targets by plane distance; 0 where either has no place."""
    if not speed or math.isinf(speed):
        return "0D"
    dx, dy = "greatest(x0 - dst_x, dst_x - x1, 0D)", "greatest(y0 - dst_y, dst_y - y1, 0D)"
    return f"coalesce(sqrt({dx} * {dx} + {dy} * {dy}) / {speed * (1 + 1e-9)!r}D, 0D) * nvl2(x0 + dst_x + dst_y, 1D, 0D)"


def _open_targets(targets: DataFrame, log: DataFrame, settled_below: float) -> DataFrame:
    """Per start with a target that is not settled: the dearest label among these (infinite if one has none) and their box."""
    best = log.join(targets.select("start", "node").hint("merge"), ["start", "node"]).groupBy("start", "node").agg(F.min("cost").alias("cost"))
    left = targets.join(best, ["start", "node"], "left").where(F.col("cost").isNull() | (F.col("cost") >= settled_below))
    return left.groupBy("start").agg(
        F.max(F.coalesce("cost", F.lit(math.inf))).alias("bound"),
        # a target without a place makes the box unknown
        *[F.when(F.count("*") == F.count("x"), f(c)).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))],
    )


def search(
    starts: DataFrame,
    edges: DataFrame,
    *,
    penalty: float = 0.0,
    penalty_first: bool = False,
    limit: float | None = None,
    cut: float | None = None,
    edges_keyed_by_start: bool = False,
    targets: DataFrame | None = None,
    width: float | None = None,
    max_rounds: int = 100_000,
    broadcast_bytes: int = BROADCAST_BYTES,
    trace: list | None = None,
) -> DataFrame:
    """Cheapest labels from every start at once.

    starts   (start, node): root node of each search; ``start`` is any id.
    edges    (src, dst, road_id, secs) [+ start when ``edges_keyed_by_start``]: directed edges; per-start edge sets (a
             region) carry ``start``.  Edges without a time (null, NaN, negative) are left out.
    penalty  seconds added per step; ``penalty_first`` chooses the summation order ``cost + penalty + secs`` (road reach) instead
             of ``cost + secs + penalty`` (UCS), as the two reference jobs differ.
    limit    labels with cost > limit are kept but not expanded.
    cut      candidates with cost >= cut are dropped (the reference's INF).
    targets  (start, node) [, x, y]: only these labels, and those on their routes, need be final.  A start is searched until
             all its targets are settled.  With places (x, y here; dst_x, dst_y in ``edges``) the search is goal-directed:
             from a node to the box of a start's open targets it takes at least the plane distance divided by the
             fastest edge's speed, and what can't beat the dearest open target's label even so is dropped.
    width    of a ring; by default the cheapest step, or LEAST_WIDTH mean steps if that is more.
    broadcast_bytes  edges that are larger, as written, are bucketed by their source instead of sent out.
    trace    a list that gets (ring, improvements) for every round.

    Returns labels (start, node, cost DOUBLE, pred, road_id STRING, hops), bucketed by (start, node); the root has cost 0, 0
    hops and null pred and road_id.  With ``targets``, labels beyond them may be missing or not the cheapest.
    """
    spark = starts.sparkSession
    node_type = dict(starts.dtypes)["node"]
    placed = targets is not None and {"x", "y"} <= set(targets.columns) and {"dst_x", "dst_y"} <= set(edges.columns)
    keys = ["start", "src"] if edges_keyed_by_start else ["src"]
    usable = edges.where((F.col("secs") >= 0) & ~F.isnan("secs"))
    measures = {"step": F.min("secs"), "mean": F.avg("secs")}
    if placed:
        span = F.hypot(F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y"))
        measures["speed"] = F.max(F.when(F.col("secs") > 0, span / F.col("secs")).when(span > 0, F.lit(math.inf)).otherwise(F.lit(0.0)))
    e = Placed(
        usable.select(*keys, "dst", F.col("road_id").alias("e_road"), "secs", *(["src_x", "src_y", "dst_x", "dst_y"] if placed else [])), "edges", keys, measures, broadcast_bytes
    )
    step, mean = e.measures["step"], e.measures["mean"]
    if width is None:
        width = math.inf if step is None else max(step + penalty, LEAST_WIDTH * (mean + penalty)) or math.inf
    speed = e.measures.get("speed")
    last = math.inf if limit is None or math.isinf(width) else math.floor(limit / width) + 1  # the ring of all that is not expanded

    if math.isinf(width):
        ring = "0L"
    else:
        ring = f"floor(cost / {float(width)!r}D)" if math.isinf(last) else f"least(floor(cost / {float(width)!r}D), {last}L)"

    def log_of(rows: DataFrame) -> Bucketed:
        table = Bucketed(spark, "labels", ["start", "node"])
        table.append(rows)
        return table

    root = starts.select("start", "node").distinct().select(
        "start", "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("road_id"), F.lit(None).cast(node_type).alias("pred"), F.lit(_name(0)).alias("round")
    )
    log = log_of(root)
    goal = None
    if targets is not None:
        goal = Bucketed(spark, "targets", ["start", "node"])
        place = ["x", "y"] if placed else [F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")]
        goal.append(targets.select("start", "node", *place).dropDuplicates(["start", "node"]))

    waiting, unknown = {0}, math.inf  # rings from ``unknown`` on are not in ``waiting``
    now, end, span, again = 0, 1, 1, False  # the rings from ``now`` to before ``end`` are taken together
    rounds, since, largest, open_ = 0, 0, 0, None
    while True:
        if not again:
            if min(waiting, default=math.inf) >= unknown or (not waiting and math.isfinite(unknown)):
                beyond = _best(log.read()).select(F.expr(ring).alias("r")).where(F.col("r") >= end).distinct().collect()  # numbers of rings
                waiting, unknown = waiting | {r["r"] for r in beyond}, math.inf
            if not waiting or min(waiting) >= last:
                break
            now = min(waiting)
            end = now + span
            waiting = {r for r in waiting if r >= end}
        if rounds >= max_rounds:
            raise RuntimeError(f"search did not end in {max_rounds} rounds")
        rounds, since = rounds + 1, since + 1

        if goal is not None and (open_ is None or rounds % LOOK == 0):
            left = Observation()
            look = _open_targets(goal.read(), log.read(), now * width if math.isfinite(width) else 0.0)
            before, open_ = open_, write_once(look.observe(left, F.count(F.lit(1)).alias("starts")), "open")
            if before is not None:
                discard(before)
            if not left.get["starts"]:
                break
        # One statement a round: the ring's labels, their candidates, and the log's minimum over both, which moves nothing of the log.
        # Of a label's rows only the best is worth expanding; a worse one whose better lies in an earlier ring is harmless.
        # What changes from round to round are text and decimal literals, which generated code refers to: it is compiled once a search.
        rows = f"round = '{_name(rounds - 1)}'" if again else f"cast({ring} AS decimal(18, 0)) >= {now}BD"
        within = "" if limit is None else f"AND cost <= {float(limit)!r}D"
        total = f"cost + {float(penalty)!r}D + secs" if penalty_first else f"cost + secs + {float(penalty)!r}D"
        drop = [] if cut is None else [f"total < {float(cut)!r}D"]
        if goal is not None:
            drop.append(f"total + {_box_distance(speed)} <= bound * (1 + 1e-9D) + 1e-9D")
        new = spark.sql(
            f"""
            SELECT start, node, m.cost, m.hops, m.road_id, m.pred, m.round, {ring.replace("cost", "m.cost")} AS ring FROM (
              SELECT start, node, min(struct(cost, hops, road_id, pred, round)) AS m FROM (
                SELECT start, node, cost, hops, road_id, pred, round FROM {log.name}
                UNION ALL  -- of plain columns: over equal types the union keeps the partitioning of both sides
                SELECT start, node, m.cost, m.hops, m.road_id, m.pred, '{_name(rounds)}' AS round FROM (
                  SELECT start, node, min(struct(total AS cost, hops + 1 AS hops, e_road AS road_id, src AS pred)) AS m FROM (
                    SELECT {e.hint("e")} *, dst AS node, {total} AS total FROM (SELECT start, node AS src, cost, hops FROM {log.name} WHERE cast({ring} AS decimal(18, 0)) < {end}BD AND {rows} {within})
                    JOIN {e.name} e USING ({", ".join(keys)}) {"JOIN {looked} USING (start)" if goal is not None else ""}
                  ) {"WHERE " + " AND ".join(drop) if drop else ""} GROUP BY start, node
                )
              ) GROUP BY start, node
            ) WHERE m.round = '{_name(rounds)}'
            """,
            **({"looked": open_} if goal is not None else {}),
        )
        seen = Observation()
        bits = F.expr(f"bit_or(shiftleft(1L, cast(pmod(ring, {AHEAD}) AS int)))")
        new = new.observe(seen, F.count(F.lit(1)).alias("rows"), bits.alias("rings"), F.max("ring").alias("most")).drop("ring")
        log.append(dealt(new, "start", "node"))
        got = seen.get
        met = [r for r in range(now, now + AHEAD) if (got["rings"] or 0) >> (r % AHEAD) & 1]
        if (got["most"] or 0) >= now + AHEAD:  # the bits of rings so far ahead are those of nearer ones too
            unknown = min(unknown, now + AHEAD)
        waiting |= {r for r in met if r >= end}
        again = any(r < end for r in met)
        largest = max(largest, got["rows"])
        span = min(2 * span, AHEAD) if got["rows"] < THIN * largest else 1
        if trace is not None:
            trace.append((now, got["rows"]))
        if since >= COMPACT:
            log, before, since = log_of(dealt(_best(log.read()), "start", "node")), log, 0
            before.drop()

    final = log_of(dealt(_best(log.read()), "start", "node"))
    log.drop()
    e.drop()
    if goal is not None:
        goal.drop()
        if open_ is not None:
            discard(open_)
    return final.close().select(*LABEL_COLS)
