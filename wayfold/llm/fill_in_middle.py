"""Fill-in-middle transformation by a sparse exception index.

A text is cut at two places, counted in code points, and its prefix, middle and suffix are written in another
order between marks, so that a model learns to fill the gap.  Texts are handled as the UTF-8 bytes that Arrow
holds.  The index of a run of texts records only the characters of more than one byte: their place in code
points and the bytes they have in excess.  A code-point cut becomes a byte cut by adding the excess of the
characters before it, found by ``searchsorted``; where a text is ASCII that is plain arithmetic, and no
text is ever decoded or copied to find its length or its cuts.

Cuts and form come from a hash of the seed and the id alone, so every run and every partitioning
gives the same result.  A null text counts as empty; an empty text, or one that holds a mark, stays plain; a null id is
hashed like an empty one; texts of any length are cut whole; repeated rows have equal results; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Shares in percent: texts that are transformed, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1


class ExceptionIndex:
    """Code points and bytes of a run of texts, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)  # first bytes of characters of two bytes or more
        head = data[lead]
        excess = 1 + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
        self.before = np.append(0, np.cumsum(excess))  # excess bytes before the k-th of them
        self.byte = lead
        self.point = lead - self.before[:-1]
        self.offsets = self.to_points(offsets)

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before a byte position on a character's border."""
        return at - self.before[np.searchsorted(self.byte, at, "left")]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before a code point."""
        return at + self.before[np.searchsorted(self.point, at, "left")]


def numbers(doc_id: str, seed: int = SEED) -> list[Column]:
    """The first four groups of eight hex digits of a row's hash, as numbers."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = [m.encode() for m in MARKS]
    p_mark, s_mark, m_mark = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            for lo, hi, offsets, data in slices(batch.column(1)):
                index = ExceptionIndex(data, offsets)
                first = index.offsets[:-1]
                n = np.diff(index.offsets)
                one, two = h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)
                a, b = np.minimum(one, two), np.maximum(one, two)
                cut_a, cut_b = index.to_bytes(first + a), index.to_bytes(first + b)
                body = data.tobytes()
                turned = (n > 0) & (h[2][lo:hi] % 100 < transformed)
                swapped = h[3][lo:hi] % 100 < suffix_first
                output, form = [], []
                for k in range(hi - lo):
                    i, p, q, j = int(offsets[k]), int(cut_a[k]), int(cut_b[k]), int(offsets[k + 1])
                    if not turned[k] or any(body.find(m, i, j) >= 0 for m in marks):
                        turned[k] = False
                        output.append(body[i:j])
                        form.append("plain")
                    elif swapped[k]:
                        output.append(b"".join((s_mark, body[q:j], p_mark, body[i:p], m_mark, body[p:q])))
                        form.append("spm")
                    else:
                        output.append(b"".join((p_mark, body[i:p], s_mark, body[q:j], m_mark, body[p:q])))
                        form.append("psm")
                plain = ~turned
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(form, pa.string()), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(output, pa.binary())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select("doc_id", "text", *numbers("doc_id", seed))
    out = rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form: str = "form", output: str = "output") -> Column:
    """The text again, from its output and form.  No mark stands in a transformed text, and none can arise at a cut."""
    part = F.split(F.col(output), "|".join(MARKS))
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def digests(rows: DataFrame) -> DataFrame:
    """The result of ``transform`` with hashes in place of the output: of itself and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
