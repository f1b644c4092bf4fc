"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

p(token | context) = p(class | context) * p(token | class).  The class part is a softmax over
``CLASSES`` classes whose features (the last token, the last two, and skips to the second and third last) are hashed
into ``BUCKETS`` weight rows.  The token part is the softmax over a class's tokens with one bias each, whose optimum is
the smoothed relative frequency, unseen tokens sharing one slot for each class.

Counts are taken over all training texts.  Weights are trained in ``PARTS`` synchronous rounds, each on the share of
the texts that the hash of the text deals to it, so that every text is used once.  In a round all tasks hold the same weights, and each
sums, for every weight row and class, how often the class came and how often the model expected it.  The sums of all tasks are added
on the executors, dealt by weight row, and give one preconditioned gradient step (the logarithm of the
two sums' ratio, damped).  Expectations are summed as whole multiples of 2**-20, so sums don't depend on their order: the
model is the same for any partitioning of the texts, bit by bit.  The weight table's size is fixed, so it is sent to the
executors; only steps, one table's size, come to the driver.  At most ``TASKS`` tasks work on a round, which bounds what is shuffled.
Of the counts, the ``HEAD`` most frequent tokens are sent; all others are joined by token
hash.  Those carry no hot key, because the frequent tokens are exactly the ones taken out.

Texts are read as UTF-8 bytes, A-Z in lower case, tokens white-space separated, each text closed by an end
token.  Null and empty texts consist of the end token.  Rows that agree in id and text give one result
row.  Without training texts nothing is known and N is 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import LOWER, U64, mix, range_hash, slices, spans

CLASSES = 32
OWN_CLASS = 12  # most frequent tokens with a class of their own; class 0 is the end token
BUCKETS = 1 << 15
HEAD = 1 << 17
STEP = 4096
#: Tokens whose expectations are summed at once.
TALLIED = 1 << 15
#: Shares of the texts (of 64) by round, tasks of a round, groups of weight rows that are added up, damping and smoothing of a step.
PARTS = (24, 40)
TASKS = 256
SHARDS = 16
DAMPING = 0.4
SMOOTH = 20.0
FIXED = 2.0**20
#: Tokens gathered before a task counts and emits them.
COUNTED_AT_ONCE = 3_000_000
END = np.array([0x2545F4914F6CDD1D], np.uint64)
_before = mix(np.arange(101, 104, dtype=np.uint64))  # what stands before a text's first token
_salts = mix(np.arange(1, 5, dtype=np.uint64))


def tokens(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with each text's end token, row of each, ending of each, byte lengths)."""
    for lo, hi, offsets, data in slices(column):
        low = LOWER[data]
        start, end, row = spans(low, offsets)
        h = range_hash(low, start, end)
        n = hi - lo
        counts = np.bincount(row, minlength=n) + 1
        stop = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.uint64)
        ending = np.zeros(len(out), np.int64)
        inner = np.ones(len(out), bool)
        inner[stop] = False
        out[stop], out[inner] = END[0], h
        last = low[end - 1].astype(np.int64)
        ending[inner] = last * 256 + np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0)
        yield lo, hi, out, np.repeat(np.arange(n), counts), ending, np.diff(offsets)


class Classes:
    """The class of every token: the end, the most frequent ones, and the rest by their last two bytes."""

    def __init__(self, own: np.ndarray):
        self.order = np.argsort(own)
        self.own = own[self.order]

    def __call__(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        rest = CLASSES - 1 - OWN_CLASS
        out = 1 + OWN_CLASS + (mix(ending.astype(np.uint64)) % U64(rest)).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            hit = self.own[at] == h
            out[hit] = 1 + self.order[at[hit]]
        out[h == END[0]] = 0
        return out


def features(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(4, tokens) weight rows of each token's context."""
    back = []
    for k in (1, 2, 3):
        prev = np.empty_like(h)
        prev[:k] = _before[k - 1]
        prev[k:] = np.where(row[k:] == row[:-k], h[:-k], _before[k - 1])
        back.append(prev)
    a, b, c = back
    hashed = (mix(a ^ _salts[0]), mix(a * U64(3) + b ^ _salts[1]), mix(b ^ _salts[2]), mix(c ^ _salts[3]))
    return np.stack([(x >> U64(40)).astype(np.int64) % BUCKETS for x in hashed])


def log_softmax(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = weights[f[0]]
    for k in range(1, len(f)):
        z += weights[f[k]]
    z += bias
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def tally(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray, came: np.ndarray, expected: np.ndarray) -> None:
    """Add tokens' classes to ``came`` (rows, classes) and the model's expectations, in whole multiples of 1/FIXED, to
    ``expected`` (classes, rows)."""
    p = np.empty((CLASSES, len(y)))
    for k in range(0, len(y), STEP):
        z = log_softmax(weights, bias, f[:, k : k + STEP])
        np.exp(z, out=z)
        z *= np.float32(FIXED)
        p[:, k : k + STEP] = np.rint(z, out=z).T
    pair, n = np.unique((f * CLASSES + y).ravel(), return_counts=True)
    came.reshape(-1)[pair] += n.astype(np.int32)
    # Class by class, a row of sums fits the processor's cache; whole numbers below 2**53 add up exactly.
    for c in range(CLASSES):
        for rows in f:
            expected[c] += np.bincount(rows, weights=p[c], minlength=BUCKETS)


def step(came: np.ndarray, expected: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The change of weights from both sums: the damped logarithm of their ratio, smoothed by the classes' shares."""
    base = SMOOTH * prior
    return (DAMPING * (np.log(came + base) - np.log(expected / FIXED + base))).astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []
    size = 0

    def emit():
        h, e = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        got, first, n = np.unique(h, return_index=True, return_counts=True)
        held.clear()
        for k in range(0, len(got), 200_000):
            s = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(got[s].view(np.int64)), pa.array(e[first[s]]), pa.array(n[s].astype(np.int64))], ["h", "ending", "c"])

    for batch in batches:
        for _, _, h, _, ending, _ in tokens(batch.column(0)):
            held.append((h, ending))
            size += len(h)
            if size >= COUNTED_AT_ONCE:
                yield from emit()
                size = 0
    if held:
        yield from emit()


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, ending, c: every distinct token of ``docs`` with its count."""
    rows = docs.select("text").mapInArrow(_counted, "h bigint, ending bigint, c bigint")
    return rows.groupBy("h").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


def train(docs: DataFrame, classes: Classes, bias: np.ndarray) -> np.ndarray:
    """The weight table after one synchronous round for each of PARTS."""
    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    prior = np.exp(bias.astype(np.float64))
    prior /= prior.sum()
    rows = BUCKETS // SHARDS
    context = docs.sparkSession.sparkContext
    place, lo = F.pmod(F.xxhash64("text"), F.lit(64)), 0
    for share in PARTS:
        sent = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            came, expected = np.zeros((BUCKETS, CLASSES), np.int32), np.zeros((CLASSES, BUCKETS))
            now, some = sent.value, False
            for batch in batches:
                for _, _, h, row, ending, _ in tokens(batch.column(0)):
                    f, y, some = features(h, row), classes(h, ending), True
                    for k in range(0, len(y), TALLIED):
                        tally(now, bias, f[:, k : k + TALLIED], y[k : k + TALLIED], came, expected)
            if some:
                parts = [slice(k * rows, (k + 1) * rows) for k in range(SHARDS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([came[x].tobytes() for x in parts], pa.binary()), pa.array([expected[:, x].tobytes() for x in parts], pa.binary())], ["shard", "came", "expected"])

        def add(pdf):
            came, expected = np.zeros(rows * CLASSES, np.int64), np.zeros(rows * CLASSES)
            for x, z in zip(pdf["came"], pdf["expected"], strict=True):
                came += np.frombuffer(x, np.int32)
                expected += np.frombuffer(z, np.float64)
            change = step(came.reshape(rows, CLASSES), expected.reshape(CLASSES, rows).T, prior)
            return pdf[["shard"]].iloc[:1].assign(change=[change.tobytes()])

        part = docs.where((place >= lo) & (place < lo + share)).select("text").coalesce(TASKS)
        sums = part.mapInArrow(run, "shard int, came binary, expected binary")
        weights = weights.copy()
        for r in sums.groupBy("shard").applyInPandas(add, "shard int, change binary").toLocalIterator():  # one table's size
            weights[r["shard"] * rows : (r["shard"] + 1) * rows] += np.frombuffer(bytes(r["change"]), np.float32).reshape(rows, CLASSES)
        lo += share
        sent.unpersist()
    return weights


def fit(docs: DataFrame) -> dict:
    """The model from training texts (``docs``: text): counts stay a table, the rest has a fixed size."""
    counts = cut(count_tokens(docs), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("h") != int(END.view(np.int64)[0])).orderBy(F.desc("c"), "h").limit(OWN_CLASS).collect()
    classes = Classes(np.array([r["h"] for r in top], np.int64).view(np.uint64))
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).select("h", "c").toPandas()
    keys = head["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    # Tokens and count mass of every class, over the whole table of counts.
    by_ending = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # at most 65,536 rows
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    own = Classes(np.zeros(0, np.uint64))
    end = counts.where(F.col("h") == int(END.view(np.int64)[0])).agg(F.sum("c")).first()[0] or 0
    for r in by_ending:
        k = int(own(np.array([1], np.uint64), np.array([r["ending"]]))[0])
        mass[k] += r["c"]
        kinds[k] += r["v"]
    k = int(own(np.array([1], np.uint64), np.array([0]))[0])
    mass[k] -= end
    kinds[k] -= bool(end)
    mass[0], kinds[0] = end, bool(end)
    for j, r in enumerate(top):
        k = int(own(np.array([1], np.uint64), np.array([r["ending"]]))[0])
        mass[k] -= r["c"]
        kinds[k] -= 1
        mass[1 + j], kinds[1 + j] = r["c"], 1
    bias = np.log((mass + 0.5) / (n + 0.5 * CLASSES)).astype(np.float32)
    weights = train(docs, classes, bias) if n else np.zeros((BUCKETS, CLASSES), np.float32)
    return {"counts": counts, "n": int(n), "v": int(v), "classes": classes, "bias": bias, "weights": weights, "keys": keys[order], "c": head["c"].to_numpy(np.float64)[order], "room": np.log10(mass + 0.5 * (kinds + 1))}


def _head_counts(model: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token is in the head, its count there)."""
    keys = model["keys"]
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    return hit, np.where(hit, model["c"][at], 0.0)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    head = {k: model[k] for k in ("keys", "c")}
    small = docs.sparkSession.sparkContext.broadcast(head | {k: model[k] for k in ("classes", "bias", "weights", "room")})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a row's own task can tell: the class part, and the counts of frequent tokens."""
        model = small.value
        for batch in batches:
            for lo, hi, h, row, ending, _ in tokens(batch.column(2)):
                f, y = features(h, row), model["classes"](h, ending)
                p = np.empty(len(h))
                for k in range(0, len(h), STEP):
                    z = log_softmax(model["weights"], model["bias"], f[:, k : k + STEP])
                    p[k : k + STEP] = z[np.arange(len(z)), y[k : k + STEP]]
                hit, c = _head_counts(model, h)
                edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                total = lambda x: np.add.reduceat(x, edge)  # noqa: B023, E731
                logs = np.where(hit, np.log10(c + 0.5), np.log10(0.5))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.bincount(row).astype(np.int64)), pa.array(total(hit.astype(np.int64))), pa.array(total(logs)), pa.array(total(p / np.log(10) - model["room"][y]))], ["doc_id", "th", "n_tokens", "known", "logs", "own"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens outside the head, once for each row with their number there."""
        for batch in batches:
            for lo, hi, h, row, _, _ in tokens(batch.column(2)):
                at = np.flatnonzero(~_head_counts(small.value, h)[0])
                order = at[np.lexsort((h[at], row[at]))]
                a, b = row[order], h[order]
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(order) else order
                m = np.diff(np.append(first, len(order)))
                take = pa.array(a[first] + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(b[first].view(np.int64)), pa.array(m.astype(np.int32))], ["doc_id", "th", "h", "m"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    per_row = rows.mapInArrow(local, f"doc_id {kind}, th bigint, n_tokens bigint, known bigint, logs double, own double")
    base = per_row.groupBy("doc_id", "th").agg(F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n_tokens", "known", "logs", "own")])
    tail = rows.mapInArrow(rare, f"doc_id {kind}, th bigint, h bigint, m int").join(model["counts"].select("h", "c"), "h")
    # An unseen token counted log10(0.5) above; a seen one adds what it has beyond that.
    more = tail.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.sum("m").alias("m"), F.sum(F.col("m") * (F.log10(F.col("c") + 0.5) - F.lit(float(np.log10(0.5))))).alias("extra"))
    out = base.join(more, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left")
    logs = F.col("logs") + F.coalesce(F.col("extra") / F.col("copies"), F.lit(0.0))
    known = F.col("known") + F.coalesce((F.col("m") / F.col("copies")).cast("long"), F.lit(0).cast("long"))
    room = float(np.log10(model["n"] + 0.5 * (model["v"] + 1)))
    return out.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(room)).alias("base_score"), (logs + F.col("own")).alias("score"))
