"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit position that is set in over half of the XXH64 hashes of a text's 3-word
shingles.  Two fingerprints that differ in at most ``RADIUS`` = 2a + 1 (or 2a) bits meet at a third one between
them: each emits all variants within half the radius, and the shuffle brings equal variants together.

* All emit the variants within a bits (65 for a radius of 3), so those within 2a bits of each other meet.
* At 2a + 1 bits one of the two has an odd number of set bits and the other an even one.  The odd one also emits
  variants at a + 1 bits.  Of 2a + 1 bits, a + 1 lie in the same half of the word, so flips within one half suffice
  (992 for a radius of 3).

All members of a variant's bucket that came within a bits are within 2a of each other, and those that came
with a + 1 are within 2a + 1 of these.  So a bucket is confirmed by its geometry: a star around its least near
member links it exactly, without a pair being formed; a bucket without a near member links nothing.  A ball holds
a bounded number of fingerprints, so no bucket can grow with the data.

Most fingerprints have no partner.  They are sifted out first by the same hashing on fewer bits: the word
has ``GROUPS`` groups of bits, one of them is left out, and two partners that differ inside that group differ
in at most 2a bits elsewhere, so they meet within a bits there (131 variants for 3 groups).  Only those that
meet another fingerprint go on to the whole words.  Equal fingerprints are one from the start, so a copied text counts once.

Null texts and texts without words have the fingerprint zero, linked like any other.  Ids may have any type with an
order; rows with a null id take part, but the least id is taken over the others (null if there is none).  Repeated rows have
equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import spread

from .common import attach, cut
from .graph import components
from .words import LOWER, slices, spans

WIDTH = 3
SEED = 42
RADIUS = 3
#: Groups of bits of the first sifting.  With 3, two unrelated fingerprints meet with a chance of about 3e-10.
GROUPS = 3
BITS = 64


def shingle_hashes(text: bytes, start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the hashes of its shingles; ``text`` holds words with one space after each, row after row.

    start, end: places of the words; edge: first word of every row and the end."""
    from xxhash import xxh64_intdigest

    first, last = start.tolist(), end.tolist()
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        n = hi - lo
        if n >= WIDTH:
            yield np.array([xxh64_intdigest(text[i:j], SEED) for i, j in zip(first[lo : hi - WIDTH + 1], last[lo + WIDTH - 1 : hi], strict=True)], np.uint64)
        else:
            yield np.array([xxh64_intdigest(text[first[lo] : last[hi - 1]], SEED)] if n else [], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    set_ = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_ += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in slices(batch.column(1)):
                low = LOWER[data]
                start, end, row = spans(low, offsets)
                # Words with one space between them, whatever white space the text has.
                size = end - start
                to = np.cumsum(size + 1) - (size + 1)
                kept = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
                kept[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                fp = [majority(h) if len(h) else 0 for h in shingle_hashes(kept.tobytes(), to, to + size, edge)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def flips(bits: list[int], most: int, least: int = 0) -> list[int]:
    """Masks of all sets of ``least`` to ``most`` of the bits."""
    return [_signed(sum(1 << k for k in chosen)) for size in range(least, most + 1) for chosen in combinations(bits, size)]


def _variants(fp: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: fp.bitwiseXOR(m))


def sifted(heads: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """The fingerprints (fp) that meet another one in the ball of half the radius when one group of bits is left out."""
    edges = [BITS * k // groups for k in range(groups + 1)]
    parts = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        kept = [k for k in range(BITS) if not lo <= k < hi]
        keep = F.lit(_signed(sum(1 << k for k in kept))).cast("bigint")
        # The left-out bits carry one of their own, so that groups mix by chance only; that would cost work, not change links.
        tag = F.lit(_signed(1 << lo)).cast("bigint")
        parts.append(_variants(F.col("fp").bitwiseAND(keep).bitwiseOR(tag), flips(kept, radius // 2)))
    met = spread(heads, "fp").select("fp", F.explode(F.concat(*parts)).alias("key"))
    same = Window.partitionBy("key")
    return met.select("fp", F.min("fp").over(same).alias("lo"), F.max("fp").over(same).alias("hi")).where("lo <> hi").select("fp").distinct()


def links(heads: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fingerprints (fp, distinct) within the radius."""
    half, bits = radius // 2, list(range(BITS))
    near = F.transform(_variants(F.col("fp"), flips(bits, half)), lambda v: F.struct(v.alias("key"), F.lit(True).alias("near")))
    if radius % 2:
        far = flips(bits[: BITS // 2], half + 1, half + 1) + flips(bits[BITS // 2 :], half + 1, half + 1)
        odd = F.bit_count("fp") % 2 == 1
        far = F.when(odd, F.transform(_variants(F.col("fp"), far), lambda v: F.struct(v.alias("key"), F.lit(False).alias("near"))))
        near = F.concat(near, F.coalesce(far, F.array().cast("array<struct<key:bigint,near:boolean>>")))
    met = spread(heads, "fp").select("fp", F.explode(near).alias("v")).select("fp", "v.key", "v.near")
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("key"))
    return met.select("fp", hub.alias("hub")).where("hub <> fp").select(F.col("hub").alias("u"), F.col("fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least id that its links reach)."""
    rows = cut(fingerprints(docs), "fingerprints")
    heads = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "heads")
    close = cut(sifted(heads, radius, groups), "sifted") if radius else heads.limit(0)
    found = components(cut(links(close, radius), "links"))
    named = heads.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named, "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    names = named.join(least, "component").select("fp", "n", "component_id")
    out = attach(rows, "fp", names, "component_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
