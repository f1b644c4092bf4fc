"""Vector code compression: one code for each part of a vector, nearest entries by slice-and-intersect bitmasks.

Vectors are cut into ``PARTS`` equal parts, each with a codebook of up to ``ENTRIES`` integer entries.  The search for the
nearest entry is exact.  For every position of a part the entries' coordinates are sorted, and each place in that
order carries the mask (uint64 words, one bit for each entry) of all entries before it.  The entries whose coordinate lies
within a radius of a vector's are then two binary searches and one XOR of masks; the AND over all positions
gives the entries in the box.  An initial radius gives a first set and with it the least distance found there; a box of
that size holds every entry that is as near, so its members are all candidates there are, and only they
are measured.  Ties go to the lower entry.

Codebooks start as the parts of the vectors with the smallest ids and are refined in ``ROUNDS`` rounds.  In a round every task
sums its parts for each entry, Spark adds these sums up, and only the sums of the fixed number of entries come to the driver.  Codebooks go out
with the plan (``PARTS * ENTRIES`` parts, a fixed size).

Rows whose vector is null or holds a null, NaN or infinite component are dropped.  Components count as
``floor(SCALE * x)``, held to 2**28 in size so that squares stay exact.  The length of vectors is that of the smallest id's; vectors of another
length are dropped; a length that is no multiple of ``PARTS`` is filled up with zeros.  With fewer rows than entries the
codebooks are smaller.  A null id is coded, but is no start for a codebook.  Of rows that share an id, the one with the
smallest vector is the start.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 2**28
#: Parts searched at once, and the first box as a share of the typical distance between an entry and its nearest one.
AT_ONCE = 1024
FIRST_BOX = 0.6


class Slices:
    """Exact nearest entries of one codebook (entries x width, integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        self.words = -(-k // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        one = np.zeros((k, self.words), np.uint64)
        one[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, k + 1, self.words), np.uint64)
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(one[order[:, d]], 0)
        self.all = np.bitwise_or.reduce(one, 0)
        self.first = self._first_radius()

    def _first_radius(self) -> int:
        k = len(self.entries)
        if k < 2:
            return 0
        least = np.empty(k)
        for i in range(k):
            d = ((self.entries - self.entries[i]) ** 2).sum(1)
            d[i] = np.iinfo(np.int64).max
            least[i] = d.min()
        return max(1, int(FIRST_BOX * np.median(least) ** 0.5))

    def box(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries whose every coordinate is within the radius of q's."""
        mask = np.broadcast_to(self.all, (len(q), self.words)).copy()
        for d in range(q.shape[1]):
            lo = np.searchsorted(self.sorted[d], q[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[d], q[:, d] + radius, "right")
            mask &= self.prefix[d, hi] ^ self.prefix[d, lo]
        return mask

    def measure(self, q: np.ndarray, mask: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        """Lower ``best`` and ``entry`` by the candidates in the masks, in place."""
        bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
        row, cand = np.nonzero(bits)
        if not len(row):
            return
        diff = q[row] - self.entries[cand]
        d = np.einsum("ij,ij->i", diff, diff)
        edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(d, edge)
        # The first of a row's candidates at its least distance has the lowest index.
        hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(edge, len(d)))))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        at, new = row[hit], cand[hit]
        better = (least < best[at]) | ((least == best[at]) & (new < entry[at]))
        best[at[better]], entry[at[better]] = least[better], new[better]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for every row of q."""
        n = len(q)
        entry, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for lo in range(0, n, AT_ONCE):
            entry[lo : lo + AT_ONCE], best[lo : lo + AT_ONCE] = self._nearest(q[lo : lo + AT_ONCE])
        return entry, best

    def _nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.iinfo(np.int64).max
        best, entry = np.full(len(q), far, np.int64), np.full(len(q), len(self.entries), np.int64)
        radius = np.full(len(q), self.first, np.int64)
        seen = np.zeros((len(q), self.words), np.uint64)
        todo = np.arange(len(q))
        while len(todo):
            mask = self.box(q[todo], radius[todo])
            fresh = mask & ~seen[todo]
            seen[todo] = mask
            b, e = best[todo], entry[todo]
            self.measure(q[todo], fresh, b, e)
            best[todo], entry[todo] = b, e
            # An entry as near as the best lies in a box of that distance; an empty box grows.
            need = np.where(b == far, 2 * radius[todo] + 1, np.ceil(np.sqrt(b.astype(np.float64))).astype(np.int64))
            more = need > radius[todo]
            radius[todo] = need
            todo = todo[more]
        return entry, best


def integers(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rows`` whose vector is usable, with ``ints``: its components as integers."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("ints", whole)


def _parts(column, parts: int) -> np.ndarray:
    """(rows, parts, width) of a list column whose lists are equally long, filled up with zeros."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)
    width = -(-flat.shape[1] // parts)
    out = np.zeros((n, parts * width), np.int64)
    out[:, : flat.shape[1]] = flat
    return out.reshape(n, parts, width)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, position, total: sums of the parts nearest to each entry; position -1 has their number."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Slices(b) for b in books]
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _parts(batch.column(0), parts)
            for p in range(parts):
                e, _ = search[p].nearest(x[:, p])
                total[p, :, 0] += np.bincount(e, minlength=entries)
                order = np.argsort(e, kind="stable")
                first = np.flatnonzero(np.append(True, e[order][1:] != e[order][:-1])) if len(e) else order
                if len(first) and width:
                    total[p, e[order][first], 1:] += np.add.reduceat(x[order, p], first, axis=0)
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width + 1).astype(np.int32)), pa.array(np.repeat(e, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, width), len(p)).astype(np.int32)), pa.array(total[p, e].ravel())],
            ["part", "entry", "position", "total"],
        )

    out = rows.select("ints").mapInArrow(run, "part int, entry int, position int, total bigint")
    return out.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"))


@dataclass(frozen=True)
class Codebooks:
    """entries (parts, entries, width) for vectors of ``length`` components."""

    entries: np.ndarray
    length: int

    def digest(self) -> str:
        """Hash of all components by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from rows with ``vec_id`` and ``ints``; None where there is no row with an id."""
    named = rows.where("vec_id is not null")
    one = named.orderBy("vec_id", "ints").select(F.size("ints").alias("n")).first()
    if one is None:
        return None
    rows = rows.where(F.size("ints") == one["n"])
    start = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").limit(entries).collect()  # at most ``entries`` rows
    books = np.ascontiguousarray(_parts(pa.array([r["ints"] for r in start], pa.list_(pa.int64())), parts).transpose(1, 0, 2))
    for _ in range(rounds):
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for r in _sums(rows, books).collect():  # at most one row for each component of the codebooks, and one for each entry
            if r["position"] < 0:
                count[r["part"], r["entry"]] = r["total"]
            else:
                total[r["part"], r["entry"], r["position"]] = r["total"]
        used = count > 0
        books = books.copy()
        books[used] = np.floor_divide(total[used], count[used][:, None])
    return Codebooks(books, one["n"])


def encode(rows: DataFrame, model: Codebooks) -> DataFrame:
    """``rows`` with ``code`` (two hex digits for each part) and ``error`` (squared distances summed) in place of ``ints``."""
    books, parts = model.entries, len(model.entries)
    keep = [c for c in rows.columns if c != "ints"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Slices(b) for b in books]
        for batch in batches:
            x = _parts(batch.column(len(keep)), parts)
            entry = np.zeros((len(x), parts), np.int64)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                entry[:, p], d = search[p].nearest(x[:, p])
                error += d
            code = [bytes(e).hex() for e in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(code, pa.string()), pa.array(error)], [*keep, "code", "error"])

    return rows.where(F.size("ints") == model.length).select(*keep, "ints").mapInArrow(run, f"{schema}, code string, error bigint")


def decode(rows: DataFrame, model: Codebooks, scale: int = SCALE) -> DataFrame:
    """``rows`` with ``vector``: the vector that a code stands for, each component in the middle of its step."""
    keep = [F.col(c) for c in rows.columns]
    parts = []
    for p, book in enumerate(model.entries):
        entries = F.array(*[F.array(*[F.lit((float(v) + 0.5) / scale) for v in e]) for e in book])
        parts.append(F.get(entries, F.conv(F.substring("code", 1 + 2 * p, 2), 16, 10).cast("int")))
    return rows.select(*keep, F.slice(F.concat(*parts), 1, model.length).alias("vector"))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per usable vector: vec_id, code, error, label_error (error over rows of one label, nulls together), codebooks_sha256."""
    rows = integers(vectors).select("vec_id", "label", "ints")
    model = fit(rows, parts, entries, rounds)
    if model is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = cut(encode(rows, model).withColumn("key", F.concat(F.lit("="), F.col("label").cast("string"))).withColumn("key", F.coalesce("key", F.lit("null"))), "codes")
    by_label = coded.groupBy("key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    out = attach(coded, "key", by_label, "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
