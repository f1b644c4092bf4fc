"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Texts are lower-cased (A-Z) and cut into runs of letters, digits and non-ASCII characters.  The
benchmark gives a set of word windows: 13 words each, or the whole item where it is shorter.  Every
window of every training text is hashed and looked up in the hash set that goes out with the plan to
all executors; hits are verified word by word against the windows themselves, and the words inside
verified windows are counted (and can be removed).

Only DataFrame functions.  Scan, lookup and verification of a text happen in its own row: no text is
shuffled.  One pass over the texts takes at most ``MAX_SET`` windows to the executors; a larger
benchmark is worked off in blocks of that size, each a pass of its own, so nothing sent out grows
without bound and no window is left out.

Null and empty texts have no words and no hits; an empty benchmark leaves every document clean.  Rows
that agree in id and text give one result row; of rows with one id and different texts, each has its
own.  Extra columns are ignored by the report and kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused
from .url_filter import lower_ascii

#: A word, after lower-casing: anything but ASCII characters that are no digit or lower-case letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
#: Windows sent to the executors in one pass (about 100 bytes each).
MAX_SET = 50_000
CANDIDATES = "array<struct<at:int,size:int,gram:string>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each (item, distinct window): item_id, size, gram (words joined by a space), h."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.slice(F.col("w"), i, size)))
    rows = items.select("item_id", size.alias("size"), F.explode(grams).alias("g"))
    return rows.select("item_id", "size", F.array_join("g", " ").alias("gram"), F.xxhash64("size", "g").alias("h"))


def _verified(w: str, grams: list[tuple[int, str, int]]) -> Column:
    """The windows of the words in column ``w`` that are among ``grams`` (size, gram, hash).

    As SQL text, because a set of thousands of literals is parsed in one go.  Grams hold no quotes
    and no backslashes: ``WORD`` admits neither.
    """

    def of_size(n: int) -> str:
        hashes = ", ".join(f"{g[2]}L" if g[2] > -(2**63) else f"(-{2**63 - 1}L - 1L)" for g in grams if g[0] == n)
        texts = ", ".join(f"'{g[1]}'" for g in grams if g[0] == n)
        near = f"filter(sequence(1, size({w}) - {n - 1}), i -> xxhash64({n}, slice({w}, i, {n})) IN ({hashes}))"
        named = f"transform({near}, i -> named_struct('at', i, 'size', {n}, 'gram', array_join(slice({w}, i, {n}), ' ')))"
        return f"CASE WHEN size({w}) >= {n} THEN filter({named}, x -> x.gram IN ({texts})) ELSE CAST(array() AS {CANDIDATES}) END"

    parts = [of_size(n) for n in sorted({g[0] for g in grams})]
    return F.expr(f"concat(CAST(array() AS {CANDIDATES}), {', '.join(parts)})" if parts else f"CAST(array() AS {CANDIDATES})")


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names, which no column of ``docs`` has: its words, and verified windows as
    (at from 1, size, gram)."""
    grams = benchmark_windows(benchmark, width).select("size", "gram", "h").distinct()
    blocks = max(1, -(-grams.count() // MAX_SET))
    words, hits = unused(docs, "__w"), unused(docs, "__hits")
    out = docs.withColumn(words, words_of(F.col("text")))
    if blocks == 1:
        return out.withColumn(hits, _verified(words, [tuple(r) for r in grams.collect()])), words, hits
    out = out.withColumn(hits, F.array().cast(CANDIDATES))
    for k in range(blocks):
        own = [tuple(r) for r in grams.where(F.expr(f"pmod(h, {blocks}) = {k}")).collect()]
        out = cut(out.withColumn(hits, F.concat(hits, _verified(words, own))), f"decontaminate-{k}")
    return out, words, hits


def _covered(hits: Column) -> Column:
    """The number of distinct words inside any of the windows."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))).cast("long")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``spans``: the
    verified windows as 0-based word ranges [from, to), in order of position."""
    own = docs.select("doc_id", "text").withColumn("__th", F.xxhash64("text"))
    rows, words, hits = with_hits(own, benchmark, width)
    spans = F.array_sort(F.transform(hits, lambda x: F.struct((x["at"] - 1).alias("from"), (x["at"] - 1 + x["size"]).alias("to"))))
    rows = rows.select(
        "doc_id", "__th", F.size(words).cast("long").alias("n_words"), _covered(F.col(hits)).alias("n_hit"), spans.alias("spans"),
        F.array_distinct(F.transform(hits, lambda x: x["gram"])).alias("g"),
    )
    rows = rows.select("doc_id", "__th", "n_words", "n_hit", "spans", F.explode_outer("g").alias("gram"))
    items = benchmark_windows(benchmark, width).select("gram", F.col("item_id").cast("string").alias("item"))
    rows = rows.join(items, "gram", "left")
    out = rows.groupBy("doc_id", "__th", "n_words", "n_hit", "spans").agg(F.collect_set("item").alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "spans",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept; nothing is shuffled."""
    rows, words, hits = with_hits(docs, benchmark, width)
    clean = ~is_contaminated(_covered(F.col(hits)), F.size(words).cast("long"))
    # As a generator and not a filter: a filter would be pushed below the columns it reads, and the
    # words cut anew for every window.
    mark = unused(docs, "__clean")
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.when(clean, F.array(F.lit(1)))).alias(mark))
    return rows.drop(mark)


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` reduced to its words outside hit windows, lower-cased and joined by a
    space, where it has a hit; other texts stay as they are.  The time is linear in a text's words and hits."""
    rows, words, hits = with_hits(docs, benchmark, width)
    hit = F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))
    places = F.array_except(F.sequence(F.lit(1), F.size(words)), hit)
    left = F.array_join(F.transform(places, lambda i: F.element_at(F.col(words), i)), " ")
    rows = rows.withColumn("text", F.when(F.size(hits) > 0, left).otherwise(F.col("text")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
