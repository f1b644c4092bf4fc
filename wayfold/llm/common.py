"""Helpers shared by the operators of this subpackage.

``cut`` writes intermediate tables below ``spark.checkpoint.dir``, the one folder all executors share, so that a
lost executor never takes a finished step with it; ``discard`` deletes them when nothing reads them any more.
``map_batches`` runs a function over Arrow batches of bounded size and leaves no unused memory in the Python workers.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.tables import cut, discard, scratch

__all__ = ["attach", "bounded_sample", "cut", "discard", "fits", "map_batches", "remainder", "scratch", "table", "unused"]

#: Bytes of an Arrow batch that a Python worker gets; a single longer row makes a larger batch.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` within bounds of memory.

    Spark hands over 10,000 rows at once, whatever they hold: a batch is limited to ``BATCH_BYTES`` instead, unless the
    session has a limit of its own (which is never overridden).  Workers are used again by later tasks and stages, and
    freed memory would stay with them, beside an executor that needs it: it is given back when a task's rows are worked off.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(whole, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or what it becomes with underscores behind it, so that no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, key: str, values: DataFrame, column: str, share: int = 1000) -> DataFrame:
    """``rows`` with ``column`` of ``values`` (one row for each ``key``, with ``n``, the number of ``rows`` that have it).

    Keys with more than one row in ``share`` are at most ``share`` many: these are broadcast, and their rows are dealt evenly
    in the join with all other keys, so that no task gets the rows of a hot key.  A null key finds nothing.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = values.where(F.col("n") * share > total).select(F.col(key).alias("__hot"), F.col(column).alias("__hot_value"))
    rest = values.where(F.col("n") * share <= total).select(F.col(key).alias("__rest"), F.col(column).alias("__value"))
    kind = rows.schema[key].dataType
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    settled = F.col("__hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("__key", F.when(settled, F.xxhash64(F.monotonically_increasing_id()).cast(kind)).otherwise(F.col(key)))
    out = out.join(rest, F.col("__key") == F.col("__rest"), "left")
    out = out.withColumn(column, F.when(F.col("__hot").isNotNull(), F.col("__hot_value")).when(F.col(key).isNotNull(), F.col("__value")))
    return out.drop("__hot", "__hot_value", "__key", "__rest", "__value")


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id gives null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows (counts no further than one more)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose key hashes lowest: deterministic, and at most ``rows`` of them.

    Used to fit classifiers only.  The ids are chosen from the key column alone and come back as a
    table of at most ``rows`` rows, so the broadcast in the semi join has a proven bound.
    """
    ids = df.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    ids = ids.orderBy(F.xxhash64("__k"), "__k").limit(rows)
    return df.join(F.broadcast(ids), F.col(key) == F.col("__k"), "left_semi")
