"""Language identification by compression.

For every language a zstandard raw-content dictionary is made of training text.  A text, in
lower case, is encoded with each dictionary, piece by piece, and belongs to the language whose dictionary makes it smallest.
Where the runner-up is hardly larger the answer is narrow and the text is rejected.

Fitting takes at most ``SAMPLE_ROWS`` training rows for each language and a stretch from the middle of each, equally
long where the texts are long enough; together they fill at most ``DICTIONARY_BYTES``, and the first pieces
of all stretches the ``MAIN_BYTES`` at the end.  The number of languages is the number of values in the training column
(at most ``MAX_LANGUAGES``).  Scoring reads every text whole, in pieces of
``PIECE_BYTES`` so that the dictionary and not the text's own beginning explains each piece.

A null text, or one without a letter, is ``und`` with score 0 and is rejected.  With no training row at
all every text is ``und``.  Ties go to the language that sorts first and are rejected as narrow.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, remainder

SAMPLE_ROWS = 300
DICTIONARY_BYTES = 1 << 16
MAX_LANGUAGES = 1000
PIECE_BYTES = 8192
LEVEL = 6
#: The main encoding uses the last half of a dictionary; offsets into it are cheaper.
MAIN_BYTES = DICTIONARY_BYTES // 2
#: Every text is encoded twice, the second time with whole dictionaries at this level, and sizes are added, since one
#: encoding of a few words is often equally long in two languages.
WHOLE_LEVEL = 4
#: Parts of a language in which sampled ids are chosen first.
SALTS = 64
#: Rejected if the runner-up is less than this share larger than the smallest encoding.
MIN_MARGIN = 0.002
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Per language the content of its dictionary, from ``docs`` (doc_id, text, lang: training rows).

    The rows of a language are those whose ids hash lowest: at most ``sample_rows``, wherever they lie.
    They are chosen from ids and languages alone; then each gives a stretch from the middle of its
    text, so that one long text can't fill the dictionary and shared headings don't either.
    """
    ids = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    # First inside each of SALTS parts of a language, then among what these leave: a language's rows never meet in one task.
    ids = ids.withColumn("__s", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for own in (["lang", "__s"], ["lang"]):
        order = Window.partitionBy(*own).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample_rows).drop("__n")
    ids = ids.drop("__s")
    rows = docs.join(F.broadcast(ids.limit(sample_rows * MAX_LANGUAGES)), ["doc_id", "lang"], "left_semi")
    # More than an equal share of each, since short texts leave the others room; what is too much goes again.
    stretch = 4 * (dictionary_bytes // sample_rows + 1)
    start = F.greatest(F.lit(1), ((F.length("text") - stretch) / 2).cast("int"))
    rows = rows.select("lang", F.xxhash64("doc_id").alias("k"), F.lower(F.substring(F.col("text"), start, F.lit(stretch))).alias("part"))
    parts: dict[str, list] = {}
    for r in rows.collect():
        parts.setdefault(r["lang"], []).append((r["k"], r["part"].encode("utf-8", "replace")))
    return {lang: dictionary(list(dict.fromkeys(p for _, p in sorted(own))), dictionary_bytes) for lang, own in parts.items()}


def share(parts: list[bytes], total: int) -> int:
    """The most bytes of each part (and a separator) that fit together into ``total``."""
    left, n = total, len(parts)
    for size in sorted(map(len, parts)):
        if (size + 1) * n > left:
            return max(0, left // n - 1)
        left, n = left - size - 1, n - 1
    return max(map(len, parts), default=0)


def dictionary(parts: list[bytes], total: int) -> bytes:
    """A stretch from the middle of every part; the last half of the result has the first piece of each."""
    size = share(parts, total - len(parts))  # two pieces of each, a separator behind both
    parts = [p[max(0, (len(p) - size) // 2) :][:size] for p in parts]
    first = share(parts, total // 2)
    main = b"\n".join(p[:first] for p in parts)
    rest = b"\n".join(p[first:] for p in parts if len(p) > first)
    return (rest + b"\n" + main)[-total:] if rest else main


class Encoder:
    """The compressors of one worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.main = [self.coder(dictionaries[k][-MAIN_BYTES:], LEVEL) for k in self.langs]
        self.whole = [self.coder(dictionaries[k], WHOLE_LEVEL) for k in self.langs]

    @staticmethod
    def coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if not self.langs or not text or not _letter.search(text):
            return UNKNOWN, 0.0, 0.0
        body = text.lower().encode("utf-8", "replace")
        pieces = [body[k : k + PIECE_BYTES] for k in range(0, len(body), PIECE_BYTES)]
        sizes = np.array([sum([len(c.compress(p)) + len(w.compress(p)) for p in pieces]) for c, w in zip(self.main, self.whole, strict=True)], float)
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else 1.0
        # Bits saved over each rival, a share of the text's length, as odds.
        score = 1.0 / np.exp(np.clip((sizes[best] - sizes) / max(1.0, sizes[best]) * 50.0, -60, 0)).sum()
        return self.langs[best], float(score), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries)
        for batch in batches:
            got = [encoder.judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[2] < min_margin for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    """The contract's training rows: crc32 of the id modulo 3 is not 1, and a language is given."""
    return docs.where(remainder("doc_id", 3) != 1).where("lang is not null")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; all columns kept, nothing shuffled."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries)
        for batch in batches:
            got = [encoder.judge(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[2] >= min_margin for g in got], pa.bool_()))

    return map_batches(docs, run, docs.schema)
