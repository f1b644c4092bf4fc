"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles.  ``HASHES`` minima are taken; ``BANDS`` bands of
``ROWS`` whole minima make candidates, and the low ``BITS`` bits of all minima are packed into longs, from
which bit counts estimate a candidate pair's similarity, corrected for chance agreement of low bits.  The
estimate only rules out pairs that lie ``SIGMAS`` standard errors below the threshold; the rest is confirmed on
the full sets.  A pair at 85 % is missed by all bands with probability (1 - 0.85**4)**24, about 2e-8.

Copies share one set, so sets stand for their copies.  A bucket never gives all its pairs: each member first
meets the bucket's hub (a star), the member that shares most buckets with others and so lies in the
middle of its group.  What the confirmed stars leave in different components is then compared:
members outside the hub's component against the bucket, the bucket dealt into salted shares of about
``SHARE`` rows, each pair in its first common bucket only.  For these members alone a longer signature of
``LONG`` single bits is made, whose estimate rules out most pairs below the threshold, and a table of ``ODD``
parities: a bit says whether the set has an odd number of shingles there, so two tables differ in at most as many
bits as the sets differ in shingles.  That rules out a pair just below the threshold for certain, and what is left to confirm
are links rather than the square of a group of near misses; large sets fill the table, for these its expected
count (and ``SIGMAS`` standard errors) tells.  Pairs inside one component need no comparison, so no link that could change a component is lost, and
there is no cap.

Null texts and texts without words have an empty set and are linked with nothing; shorter texts than a shingle are one
shingle; ids may have any type with an order; equal rows have equal results, and an id with several texts has a row for
each, linked by its own text; rows without an id are linked only to rows with the same set; extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, map_batches, unused
from .graph import components
from .words import LOWER, U64, mix, range_hash, row_windows, slices, spans, window_hash

WIDTH = 5
HASHES = 128
BANDS = 24
ROWS = 4
BITS = 2
SIGMAS = 5.0
SHARE = 2000
LONG = 1024
ODD = 4096
#: Links hold from this share of common shingles on, in percent.
PERCENT = 85
PACKED = HASHES * BITS // 64

_rng = np.random.Generator(np.random.PCG64(5))
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_OFFSETS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_LONG_FACTORS = _rng.integers(1, 2**63, LONG, dtype=np.uint64) * U64(2) + U64(1)


def _sets(column) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, the sorted distinct shingle hashes of each row)."""
    for lo, hi, offsets, data in slices(column):
        low = LOWER[data]
        start, end, row = spans(low, offsets)
        word = range_hash(low, start, end)
        at, h = row_windows(word, row, WIDTH)
        count = np.bincount(row, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(row[at], np.arange(hi - lo + 1))
        out = []
        for k in range(hi - lo):
            own = h[edge[k] : edge[k + 1]]
            if 0 < count[k] < WIDTH:  # the whole sequence is the one shingle; its length keeps it apart
                own = window_hash(word[first[k] : first[k + 1]], int(count[k])) ^ U64(count[k])
            out.append(np.unique(own))
        yield lo, hi, out


def signature(shingles: np.ndarray, factors: np.ndarray = _FACTORS, offsets: np.ndarray | int = _OFFSETS[:, None]) -> np.ndarray:
    """The minima of a set, one for each factor."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        x = shingles[k : k + 1024]
        x = x ^ (x >> U64(29))
        # Multiplication modulo 2**64 orders by the high bits, which all bits of x reach.
        np.minimum(best, (x[None, :] * factors[:, None] + offsets).min(1), out=best)
    return best


def parities(shingles: np.ndarray) -> np.ndarray:
    """For ODD places whether an odd number of the set's shingles lies there, packed into longs."""
    at = mix(shingles ^ U64(0x9E3779B97F4A7C15)) % U64(ODD)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).view(np.int64)


def long_signatures(sets: DataFrame) -> DataFrame:
    """node, the lowest bit of each of LONG minima, packed into longs, and the parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, odd = [], []
            for body in batch.column(1):
                own = np.frombuffer(body.as_buffer(), np.uint64)
                bits = (mix(signature(own, _LONG_FACTORS, U64(1))) & U64(1)).astype(np.uint8)
                rows.append(np.packbits(bits).view(np.int64))
                odd.append(parities(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], ["node", "long", "odd"])

    return map_batches(sets.select("node", "shingles"), run, "node bigint, long array<bigint>, odd array<bigint>")


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int((mix(s ^ U64(0x5DEECE66D)) * U64(3)).sum(dtype=np.uint64).view(np.int64))


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits (after mixing) of each minimum, packed into PACKED longs."""
    low = mix(minima) & U64((1 << BITS) - 1)
    per = 64 // BITS
    out = np.zeros(PACKED, np.uint64)
    for k in range(per):
        out |= low[k * PACKED : (k + 1) * PACKED] << U64(k * BITS)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    rows = minima[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        h = mix(h ^ rows[:, k])
    return h


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d0, d1 (a 128-bit digest of the set), packed, bands; the last two null for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in _sets(batch.column(1)):
                d0, d1, packed, bands = [], [], [], []
                for s in sets:
                    both = digest(s)
                    d0.append(both[0])
                    d1.append(both[1])
                    m = signature(s) if len(s) else None
                    packed.append(None if m is None else pack(m).view(np.int64))
                    bands.append(None if m is None else band_keys(m).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "d0", "d1", "packed", "bands"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles bigint, d0 bigint, d1 bigint, packed array<bigint>, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """d0, d1, n_shingles and the sorted shingle hashes as bytes, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _sets(batch.column(0)):
                both = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in both], pa.int64()), pa.array([d[1] for d in both], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["d0", "d1", "n_shingles", "shingles"])

    return map_batches(docs.select("text"), run, "d0 bigint, d1 bigint, n_shingles bigint, shingles binary")


def mismatches(a: str, b: str) -> Column:
    """The number of minima whose low bits differ, by bit counts over the packed longs."""
    total = F.lit(0)
    field = F.lit(sum(1 << (k * BITS) for k in range(64 // BITS)) - (1 << 64 if BITS == 1 else 0))
    for k in range(PACKED):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        any_bit = x
        for j in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, j))
        total = total + F.bit_count(any_bit.bitwiseAND(field))
    return total


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from the packed minima, corrected for chance agreement of BITS bits."""
    return 1 - mismatches(a, b) / F.lit(HASHES * (1 - 0.5**BITS))


def long_estimate(a: str, b: str) -> Column:
    """The same from the longer signatures of single bits."""
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(LONG // 64)), F.lit(0))
    return 1 - differ / F.lit(LONG * 0.5)


def odd_bits(a: str, b: str) -> Column:
    """The number of places where two tables of parities differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)


def most_odd_bits(a: str, b: str, percent: int = PERCENT) -> Column:
    """The most places where tables of sets of these sizes differ at the threshold: one for each shingle that only one set has, or,
    where so many fall together, SIGMAS standard errors above the expected number."""
    apart = (F.col(a) + F.col(b)) * ((100 - percent) / (100 + percent)) + 1e-6
    same = F.exp(apart * math.log(1 - 2 / ODD))
    return F.least(apart, (1 - same) * (ODD / 2) + F.sqrt((1 - same * same) * (ODD / 4)) * SIGMAS)


def least_estimate(percent: int = PERCENT, hashes: int = HASHES, bits: int = BITS) -> float:
    """The estimate SIGMAS standard errors below the threshold."""
    j, chance = percent / 100, 1 - 0.5**bits
    miss = (1 - j) * chance
    return j - SIGMAS * (miss * (1 - miss) / hashes) ** 0.5 / chance


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    rows = rows.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                if len(p) > len(q):
                    p, q = q, p
                spot = np.searchsorted(q, p)
                both = int((q[np.minimum(spot, len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return map_batches(rows, run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    key = ["d0", "d1", "n_shingles"]
    signed = cut(signatures(docs), "signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("id"))
    # Classes are numbered once, so that nodes are short whatever the type of ids, and an id with two texts is two nodes.
    heads = signed.join(classes, key).where("doc_id = id").dropDuplicates(key).select("id", *key, "packed", "bands")
    heads = cut(heads.withColumn("node", F.monotonically_increasing_id()), "heads")

    buckets = heads.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    linked = cut(buckets.join(shared, "key"), "linked")  # key, node, n
    middle = linked.groupBy("node").agg(F.sum("n").alias("w"))
    hubs = linked.join(middle, "node").groupBy("key").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("hub"))
    members = cut(linked.join(hubs, "key"), "members")  # key, node, n, hub
    discard(linked)

    # Stars: every member with the hubs of its buckets, the pairs that may be similar enough.
    floor = least_estimate(percent)
    sizes = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    packed = heads.select("node", F.col("n_shingles").alias("n"), "packed")
    star = star.join(packed.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("packed").alias("pb")), "b")
    star = star.join(packed.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("packed").alias("pa")), "a")
    star = star.where(sizes(F.col("na"), F.col("nb"))).where(estimate("pa", "pb") >= floor)
    # One hub for a member is enough to begin with; what it does not settle, the second part compares.
    star = cut(star.groupBy("b").agg(F.max_by("a", F.struct(F.round(estimate("pa", "pb"), 6), -F.col("a"))).alias("a")).select("a", "b"), "stars")

    wanted = heads.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("doc_id"), *key)
    near = shingle_sets(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
    sets = cut(near.join(wanted.drop("doc_id"), key).dropDuplicates(["node"]).select("node", "shingles"), "sets")
    edges = cut(_confirm(star, sets, percent), "confirmed")
    found = cut(components(edges), "components")

    rest = residual_pairs(members, heads, sets, found, percent)
    more = cut(_confirm(rest, sets, percent), "confirmed")
    if not more.isEmpty():
        before, found = found, cut(components(edges.unionByName(more)), "components")
        discard(before)

    named = heads.select("node", "id", *key).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = cut(named.join(least, "component").select(*key, "least"), "named")
    discard(heads, members, star, sets, edges, more, found)
    out = signed.select("doc_id", *key).join(named, key, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def residual_pairs(members: DataFrame, heads: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) that share a bucket, lie in different components and may be similar enough."""
    name = found.select("node", "component")
    own = members.join(name, "node", "left").withColumn("component", F.coalesce("component", "node"))
    hubs = name.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    own = own.join(hubs, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))
    open_ = own.groupBy("key").agg(F.max(F.col("component") != F.col("hub_component")).alias("open")).where("open").select("key")
    own = cut(own.join(open_, "key", "left_semi"), "open-buckets")
    nodes = own.select("node").distinct()
    detail = heads.join(nodes, "node", "left_semi").select("node", F.col("n_shingles").alias("s"), "packed", F.transform("bands", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("tags")).join(long_signatures(sets.join(nodes, "node", "left_semi")), "node")
    own = cut(own.join(detail, "node").withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int")), "open-members")
    floor, long_floor = least_estimate(percent), least_estimate(percent, LONG, 1)
    left = own.where("component <> hub_component").select(
        "key", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("s").alias("sx"), F.col("packed").alias("px"), F.col("long").alias("lx"), F.col("odd").alias("ox"), F.col("tags").alias("tx"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
    )
    right = own.select("key", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("hub_component").alias("hy"), F.col("s").alias("sy"), F.col("packed").alias("py"), F.col("long").alias("ly"), F.col("odd").alias("oy"), F.col("tags").alias("ty"), F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))
    # Two members outside the hub's component meet once in a bucket, in order of their nodes, and a pair is compared in its
    # first common bucket only; 31 bits of a bucket's key tell it (a false earlier one has a chance of about 1e-8 a pair,
    # as likely as a pair that no band finds).
    common = F.filter(F.zip_with("tx", "ty", lambda p, q: F.when(p == q, p)), lambda k: k.isNotNull())
    pairs = left.join(right, ["key", "share"]).where(
        (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("hy")) | (F.col("x") < F.col("y"))) & (100 * F.least("sx", "sy") >= percent * F.greatest("sx", "sy"))
        & (estimate("px", "py") >= floor) & (long_estimate("lx", "ly") >= long_floor) & (odd_bits("ox", "oy") <= most_odd_bits("sx", "sy", percent)) & (common[0] == F.col("key").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    )
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that are not kept: one document of each component stays, whole."""
    gone = unused(docs, "__id")
    verdict = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(verdict, F.col("doc_id") == F.col(gone), "left_anti")
