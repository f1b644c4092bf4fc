"""Intermediate tables in the shared checkpoint folder.

``cut`` writes a plain table and reads it back, which ends lineage: a lost executor never takes a finished step
with it.  ``Bucketed`` keeps a table hash-partitioned by key columns on disk.  Spark reads such a table without an
exchange in every join, aggregate or union on these keys, so rows that stay where they are cost no shuffle; what is
new in a round is appended to the bucket it belongs to.  ``placed`` chooses between a broadcast and a bucketed
table by the size it has measured.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayfold.session import ensure_checkpoint_dir

#: Tables of at most this many bytes (as written) are sent to every executor.
BROADCAST_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (cuts lineage)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """(the file system that holds ``path``, the path) as Hadoop objects."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below ``path``."""
    files, at = file_system(spark, path)
    return int(files.getContentSummary(at).getLength())


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing lazy reads them any more."""
    for df in tables:
        files, at = file_system(df.sparkSession, df.scratch_path)
        files.delete(at, True)


def buckets(spark: SparkSession) -> int:
    """The number of buckets: that of shuffle partitions, so that what is shuffled meets its bucket."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Bucketed:
    """A table bucketed by ``keys``, optionally in folders by ``folders``, written by appends."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str], folders: list[str] | None = None):
        self.spark, self.keys, self.folders = spark, keys, folders or []
        self.path = scratch(spark, name)
        self.name = f"wayfold_{name}_{uuid.uuid4().hex}".replace("-", "_")
        self.n = buckets(spark)

    def append(self, df: DataFrame) -> None:
        """Add rows, which lie or are dealt by the keys, to their buckets."""
        rows = df.repartition(self.n, *self.keys) if not self._dealt(df) else df
        out = rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.n, *self.keys)
        (out.partitionBy(*self.folders) if self.folders else out).saveAsTable(self.name)

    def _dealt(self, df: DataFrame) -> bool:
        return getattr(df, "dealt_by", None) == self.keys

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The table as a DataFrame that no longer needs its name: the files stay, the name goes.

        A table in folders keeps its list of folders under its name, so it is read by path, without its buckets."""
        df = self.read()
        if self.folders:
            df = self.spark.read.schema(df.schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE {self.name}")
        return df

    def drop(self) -> None:
        """Remove the name and the files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        files, at = file_system(self.spark, self.path)
        files.delete(at, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Mark ``df`` as hash-partitioned by ``keys`` into the number of buckets (the result of an aggregate on them)."""
    df.dealt_by = list(keys)
    return df


class Placed:
    """A table that many joins on ``keys`` read: sent out if it is measured small, else bucketed by the keys."""

    def __init__(self, df: DataFrame, name: str, keys: list[str], measures: dict | None = None, broadcast_bytes: int = BROADCAST_BYTES):
        spark = df.sparkSession
        self.measures = {}
        if measures:
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
        self._table = Bucketed(spark, name, keys)
        self._table.append(df)
        if measures:
            self.measures = seen.get
        self.bytes = stored_bytes(spark, self._table.path)
        self.broadcast = self.bytes <= broadcast_bytes

    @property
    def df(self) -> DataFrame:
        """For a join: with the hint that the measured size asks for."""
        rows = self._table.read()
        return F.broadcast(rows) if self.broadcast else rows.hint("merge")

    @property
    def name(self) -> str:
        return self._table.name

    def hint(self, alias: str) -> str:
        """The same for a statement in which the table has this alias."""
        return f"/*+ {'BROADCAST' if self.broadcast else 'MERGE'}({alias}) */"

    def drop(self) -> None:
        self._table.drop()
