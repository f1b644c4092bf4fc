"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one integer of
failure bits; policies are versioned masks over those bits, so applying another policy, or asking what
a rule removes on its own or beside others, never reads a text again: it is bitwise aggregation.

Measurements are made in Arrow batches on the UTF-8 bytes of whole texts.  Words are runs of
characters other than U+0020 and U+0009..U+000D.  Null or empty texts have no words (and fail
``few_words``); repeated rows each have a row; an empty table gives an empty ledger; extra columns are
ignored.  Texts of any length are measured whole; memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE, U64, mix, per_row, range_hash, row_windows, slices, spans

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]

#: Rule i sets bit i where its condition (SQL over the measurements, in whole numbers) holds.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("duplicate_lines", "n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: a document is kept if none of the policy's rules fails.
POLICIES = {
    "1": BITS["few_words"] | BITS["repeated_words"],
    "2": (1 << len(RULES)) - 1,
}
LATEST = "2"

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True
_upper = np.zeros(256, bool)
_upper[ord("A") : ord("Z") + 1] = True
_letter = _upper.copy()
_letter[ord("a") : ord("z") + 1] = True


def _measure(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    start, end, row = spans(data, offsets)
    word = range_hash(data, start, end)
    inside = ~SPACE[data]
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": per_row(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_row(_symbol[data], offsets)}
    out |= {"n_upper": per_row(_upper[data], offsets), "n_letters": per_row(_letter[data], offsets)}
    # Lines: from a text's start or the byte after \n to the next \n or the text's end.
    feed = np.flatnonzero(data == 0x0A)
    lo = np.union1d(offsets[:-1], feed + 1)
    owner = np.searchsorted(offsets, lo, "right") - 1
    real = (owner < rows) & (lo < len(data))
    lo, owner = lo[real], owner[real]
    stop = np.append(feed, len(data))
    hi = np.minimum(stop[np.searchsorted(stop, lo)], offsets[owner + 1])
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    worded = words_before[hi] > words_before[lo]
    lo, hi, owner = lo[worded], hi[worded], owner[worded]
    salt = mix(np.arange(rows, dtype=np.uint64) + U64(1))
    _, first = np.unique(range_hash(data, lo, hi) ^ salt[owner], return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=rows)
    # Words in windows of WINDOW words that occur twice or more in the text.
    at, h = row_windows(word, row, WINDOW)
    h = h ^ salt[row[at]]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(word) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=rows)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, offsets, data in slices(batch.column(1)):
            got = _measure(offsets, data)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(got[k].astype(np.int64)) for k in MEASURES]], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i set where rule i of ``RULES`` fails."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in MEASURES))
    bits = F.lit(0)
    for name, condition in RULES:
        bits = bits + F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0))
    return rows.withColumn("failed", bits)


def passes(failed: Column | str, policy: str = LATEST) -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """For every rule of a policy: documents that fail it, that fail it alone, and what the policy
    would keep without it.  One pass over the ledger's ``failed`` column, no text is read."""
    mask = POLICIES[policy]
    own = F.col("failed").bitwiseAND(F.lit(mask))
    counts = rows.groupBy(own.alias("bits")).agg(F.count("*").alias("n"))  # at most 2**rules rows
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BITS.items() if b & mask])).alias("r")
    each = counts.select("bits", "n", named).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(hit)("n_failed"), total(only)("n_only"), total(only | (F.col("bits") == 0))("n_kept_without"))
