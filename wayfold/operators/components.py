"""Connected components and reachability of node pairs, in few rounds on large graphs.

``components`` first contracts inside tasks: edges are dealt by range into parts of about ``LOCAL`` edges, each part finds its own
components, and only the pairs of part components that share a node remain.  On a graph whose ids follow its
layout these are few; what is left is contracted again, by parts while that shrinks it, else by stars in turn.  A
star round is two joins and two aggregates; no neighbour list is ever gathered into one row.

``reachable`` answers which (start, node) pairs have a directed path.  Where two nodes have edges both ways, direction does not
matter, so the components over such two-way pairs are found first; in a road network these are few and large.  The one-way
edges between different components form a much smaller graph, and only pairs in different components are searched there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.operators import frontier
from wayfold.tables import cut, discard

MAX_ROUNDS = 100
#: Edges that one task contracts.
LOCAL = 500_000


def _contract(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each vertex ties its neighbours (all larger ones, or all smaller ones) to the least of them and itself."""
    if larger_only:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """``components`` by star contractions alone: for edges whose ids follow no layout, so that parts would share most nodes."""
    state = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        before, state = state, cut(_contract(_contract(state, True), False), "edges")
        discard(before)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def least_of_component(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For the nodes 0 to n - 1 the least node of their component: minima along edges, then along pointers, until both rest."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def _contract_parts(edges: DataFrame, parts: int) -> DataFrame:
    """(node, root): for every part of the edges and each of its nodes the least node of its component there."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            ends = pa.chunked_array([c for b in own for c in (b.column(0), b.column(1))]).to_pandas()
            sizes = [b.num_rows for b in own]
            codes, names = pd.factorize(ends, sort=True)
            at = np.cumsum([0] + [2 * n for n in sizes])
            u = np.concatenate([codes[a : a + n] for a, n in zip(at, sizes)])
            v = np.concatenate([codes[a + n : a + 2 * n] for a, n in zip(at, sizes)])
            names = pd.Series(names)
            roots = names.iloc[least_of_component(u, v, len(names))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"node": names.to_numpy(), "root": roots.to_numpy()}), preserve_index=False)

    return edges.repartitionByRange(parts, "u", "v").mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (u, v) with a neighbour: the least vertex it can reach, edges taken both ways."""
    size = Observation()
    state = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    state = cut(state.observe(size, F.count(F.lit(1)).alias("n")), "edges")
    n = size.get["n"]
    parts = -(-n // local) or 1
    named = cut(_contract_parts(state, parts), "parts")
    if parts == 1:
        return named.select("node", F.col("root").alias("component"))
    least = cut(named.groupBy("node").agg(F.min("root").alias("root")), "roots")
    shared = named.select("node", F.col("root").alias("u")).join(least.select("node", F.col("root").alias("v")), "node").where("u <> v").select("u", "v").distinct()
    shared = cut(shared, "shared")
    left = shared.count()
    over = components(shared, local) if left <= n // 2 else star_components(shared)
    found = least.join(over.select(F.col("node").alias("root"), "component"), "root", "left")
    return cut(found.select("node", F.coalesce("component", "root").alias("component")), "components")


def reachable(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct (start, node) of ``pairs`` with a directed path over ``edges`` (src, dst), or start = node."""
    arcs = cut(edges.where("src <> dst").select("src", "dst").distinct(), "arcs")
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    named = cut(components(arcs.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("v"))), "components")

    def part(node: str, name: str) -> DataFrame:
        return named.select(F.col("node").alias(node), F.col("component").alias(name))

    def in_parts(df: DataFrame, one: str, two: str) -> DataFrame:
        out = df.join(part(one, "p"), one, "left").join(part(two, "q"), two, "left")
        return out.withColumn("p", F.coalesce("p", one)).withColumn("q", F.coalesce("q", two))

    own = cut(in_parts(pairs.select("start", "node").distinct(), "start", "node"), "pairs")
    out = own.where("p = q")
    apart = own.where("p <> q")
    if not apart.isEmpty():
        between = cut(in_parts(arcs, "src", "dst").where("p <> q").select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct(), "between")
        if not between.isEmpty():
            steps = between.select("src", "dst", F.lit("").alias("road_id"), F.lit(1.0).alias("secs"))
            starts = apart.select(F.col("p").alias("start")).distinct().select("start", F.col("start").alias("node"))
            met = frontier.search(starts, steps).select(F.col("start").alias("p"), F.col("node").alias("q"))
            out = out.unionByName(apart.join(met, ["p", "q"], "left_semi").select(*out.columns))
    return out.select("start", "node")
