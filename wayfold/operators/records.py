"""Record-level projections and joins: matched records and their start points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "0"  # fixed value: road id of a record not matched to any road


def matched_records(records: DataFrame) -> DataFrame:
    """Records whose road is not the unmatched marker (pushed down to the scan)."""
    return records.where(F.col("road_id") != UNMATCHED)


def start_points(records: DataFrame, roads: DataFrame) -> DataFrame:
    """Record -> its road's first point (``a``).  Records on unknown roads drop out
    (inner join; the reference throws there)."""
    return matched_records(records).join(
        roads.select("road_id", F.col("a").alias("start_node"), F.col("xa").alias("lon"), F.col("ya").alias("lat")),
        "road_id",
    )


def start_roads(records: DataFrame, roads: DataFrame) -> DataFrame:
    """Distinct known roads among the matched records: one search per road, not
    per record.  ``distinct`` aggregates map-side, so a hot road costs one row."""
    return (
        matched_records(records)
        .select("road_id")
        .distinct()
        .join(roads.select("road_id", "a", "b"), "road_id")
    )


def record_counts(records: DataFrame, roads: DataFrame, key: str) -> DataFrame:
    """Records per start key (``road_id`` or ``start_node``), pre-aggregated."""
    return start_points(records, roads).groupBy(key).agg(F.count(F.lit(1)).alias("n_records"))
