"""Scans of the reference's text layouts, and writers producing them.

Each ``parse_*`` takes a DataFrame with one text line per row in column
``value`` (what ``spark.read.text`` returns) and parses it with native string
functions; ``read_*`` are the file entry points.  ``format_*`` build the same
lines from network tables (used for fixtures and to write map files).

Layouts (FIXTURES.md §1):
  trajectory      f0,f1,...,f7,roadId[,...]           road id at index 8, '0' = unmatched
  road attributes roadId;name;lon,lat、lon,lat、...;...;km   (point list separator U+3001)
  point topology  lon,lat|lon,lat,roadId,km;lon,lat,roadId,km
  road topology   roadId,lon1,lat1,lon2,lat2|lon1,lat1:r1,r2|lon2,lat2:r3   (list may be absent)
  grid index      {"GeoHash": "...", "nodes": [{"RoadId": "...", "LonLats": ["lon,lat", ...]}]}

Splits follow Java's ``String.split`` where the reference relies on it:
trailing empty items are dropped.  A short line yields nulls (``get``), not an
error.

The ``parse_*`` functions keep every line.  The ``scan_*`` functions read files as the
reference's loaders do: a key that several lines give keeps its last line, in the order of file
name and place in the file, and lines that do not fit the layout go to a side table with the
reason, instead of ending the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.sources.network import fmt_point, road_seconds

# Fixed values of the reference's layouts: separators and field positions.
POINT_LIST_SEP = "、"
TRAJ_ROAD_FIELD = 8

GRID_SCHEMA = T.StructType(
    [
        T.StructField("GeoHash", T.StringType()),
        T.StructField(
            "nodes",
            T.ArrayType(
                T.StructType(
                    [T.StructField("RoadId", T.StringType()), T.StructField("LonLats", T.ArrayType(T.StringType()))]
                )
            ),
        ),
    ]
)


#: Roads of a line that are copied into a row together.
LINE_ROADS = 1000
#: A line whose roads are left as text.
GRID_LINE_SCHEMA = T.StructType([GRID_SCHEMA["GeoHash"], T.StructField("nodes", T.ArrayType(T.StringType()))])


def _split_nonempty(s: Column, sep: str) -> Column:
    """Java-like split: drop the empty items (trailing ones in the reference)."""
    return F.filter(F.split(s, sep), lambda x: x != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines with their place.  ``at`` orders lines by file name, block and place in the block: one task reads
    a block from front to back, so the row number that Spark counts there follows the lines, whatever task it is."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("at"))


@dataclass(frozen=True)
class Scan:
    """``rows`` of the lines that fit the layout, ``bad``: (file, value, reason) of the others."""

    rows: DataFrame
    bad: DataFrame

    def bad_counts(self) -> DataFrame:
        return self.bad.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _scanned(lines: DataFrame, reason: Column, key: Column | None, parse) -> Scan:
    """Lines with a reason put aside; of the others the last one for each key, parsed."""
    judged = lines.select("value", "at", reason.alias("reason")).where(F.trim("value") != "")
    good = judged.where("reason is null")
    if key is not None:
        good = good.groupBy(key.alias("key")).agg(F.max_by("value", "at").alias("value"))
    return Scan(parse(good.select("value")), judged.where("reason is not null").select(F.col("at.file").alias("file"), "value", "reason"))


def _is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def scan_trajectory(spark: SparkSession, path: str) -> Scan:
    """Every record with a road id field; lines of fewer than nine fields are put aside."""
    short = F.size(F.split("value", ",")) <= TRAJ_ROAD_FIELD
    return _scanned(read_ordered_lines(spark, path), F.when(short, "fewer than nine fields"), None, parse_trajectory)


def scan_road_attrs(spark: SparkSession, path: str) -> Scan:
    parts = F.split(F.trim(F.col("value")), ";")
    reason = F.when(F.size(parts) < 4, "fewer than four fields").when(~_is_number(F.element_at(parts, -1)), "length is no number")
    return _scanned(read_ordered_lines(spark, path), reason, F.get(parts, 0), parse_road_attrs)


def scan_point_topology(spark: SparkSession, path: str) -> Scan:
    """A point's last line replaces all edges of its earlier ones."""
    parts = F.split(F.trim(F.col("value")), "\\|")
    items = _split_nonempty(F.coalesce(F.get(parts, 1), F.lit("")), ";")
    off = F.exists(items, lambda i: (F.size(F.split(i, ",")) != 4) | ~_is_number(F.get(F.split(i, ","), 3)))
    reason = F.when(F.size(parts) < 2, "no list of neighbours").when(off, "a neighbour without four fields and a length")
    return _scanned(read_ordered_lines(spark, path), reason, F.get(parts, 0), parse_point_topology)


def scan_road_topology(spark: SparkSession, path: str) -> Scan:
    head = F.split(F.get(F.split(F.trim(F.col("value")), "\\|"), 0), ",")
    off = F.size(head) != 5
    number = F.forall(F.slice(head, 2, 4), lambda x: _is_number(x))
    reason = F.when(off, "head without five fields").when(~number, "a place is no number")
    return _scanned(read_ordered_lines(spark, path), reason, F.get(head, 0), parse_road_topology)


def scan_grid_index(spark: SparkSession, path: str) -> Scan:
    row = F.from_json(F.col("value"), GRID_SCHEMA)
    reason = F.when(row.isNull() | row["GeoHash"].isNull(), "no cell").when(row["nodes"].isNull(), "no list of roads")
    return _scanned(read_ordered_lines(spark, path), reason, row["GeoHash"], parse_grid_index)


# ------------------------------------------------------------------ trajectory

def parse_trajectory(lines: DataFrame) -> DataFrame:
    """(traj_id, rec_id, road_id) from trajectory lines; only the road id is
    required by the searches (index 8)."""
    parts = F.split(F.col("value"), ",")
    return lines.select(
        F.get(parts, 0).try_cast("bigint").alias("traj_id"),
        F.get(parts, 1).try_cast("bigint").alias("rec_id"),
        F.get(parts, TRAJ_ROAD_FIELD).alias("road_id"),
    )


def format_trajectory(records: DataFrame) -> DataFrame:
    return records.select(
        F.concat_ws(",", "user_id", "event_id", F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"),
                    F.lit("0"), "road_id").alias("value")
    )


# ------------------------------------------------------------- road attributes

def parse_road_attrs(lines: DataFrame) -> DataFrame:
    """(road_id, km, secs, p_first, p_last): seconds at 60 km/h, 3 decimals."""
    parts = F.split(F.trim(F.col("value")), ";")
    pts = F.split(F.get(parts, 2), POINT_LIST_SEP)
    km = F.element_at(parts, -1).try_cast("double")
    return lines.select(
        F.get(parts, 0).alias("road_id"),
        km.alias("km"),
        road_seconds(km).alias("secs"),
        F.element_at(pts, 1).alias("p_first"),
        F.element_at(pts, -1).alias("p_last"),
    )


def format_road_attrs(roads: DataFrame) -> DataFrame:
    mid = fmt_point((F.col("xa") + F.col("xb")) / 2.0, (F.col("ya") + F.col("yb")) / 2.0)
    pts = F.concat_ws(POINT_LIST_SEP, fmt_point(F.col("xa"), F.col("ya")), mid, fmt_point(F.col("xb"), F.col("yb")))
    return roads.select(
        F.concat_ws(";", "road_id", F.lit("road"), pts, F.lit("1"), F.col("km").cast("string")).alias("value")
    )


# -------------------------------------------------------------- point topology

def parse_point_topology(lines: DataFrame) -> DataFrame:
    """(src, dst, road_id, secs): one directed edge per item, seconds = km * 60."""
    parts = F.split(F.trim(F.col("value")), "\\|")
    items = lines.select(
        F.get(parts, 0).alias("src"), F.explode(_split_nonempty(F.get(parts, 1), ";")).alias("item")
    )
    f = F.split(F.col("item"), ",")
    return items.select(
        "src",
        F.concat_ws(",", F.get(f, 0), F.get(f, 1)).alias("dst"),
        F.get(f, 2).alias("road_id"),
        (F.get(f, 3).try_cast("double") * 60.0).alias("secs"),
    )


def format_point_topology(edges: DataFrame, roads: DataFrame, junctions: DataFrame) -> DataFrame:
    pt = junctions.select("node", fmt_point(F.col("lon"), F.col("lat")).alias("pt"))
    e = (
        edges.join(roads.select("road_id", "km"), "road_id")
        .join(pt.withColumnRenamed("node", "src").withColumnRenamed("pt", "src_pt"), "src")
        .join(pt.withColumnRenamed("node", "dst").withColumnRenamed("pt", "dst_pt"), "dst")
    )
    item = F.concat_ws(",", "dst_pt", "road_id", F.col("km").cast("string"))
    return e.groupBy("src_pt").agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        F.concat("src_pt", F.lit("|"), F.array_join("items", ";")).alias("value")
    )


# --------------------------------------------------------------- road topology

def _end_roads(part: Column) -> Column:
    kv = F.split(part, ":")
    return F.when(F.size(_split_nonempty(part, ":")) > 1, _split_nonempty(F.get(kv, 1), ",")).otherwise(
        F.array().cast("array<string>")
    )


def parse_road_topology(lines: DataFrame) -> DataFrame:
    """(road_id, lon1, lat1, start_roads, lon2, lat2, end_roads)."""
    parts = F.split(F.trim(F.col("value")), "\\|")
    head = F.split(F.get(parts, 0), ",")
    return lines.select(
        F.get(head, 0).alias("road_id"),
        F.get(head, 1).try_cast("double").alias("lon1"),
        F.get(head, 2).try_cast("double").alias("lat1"),
        _end_roads(F.coalesce(F.get(parts, 1), F.lit(""))).alias("start_roads"),
        F.get(head, 3).try_cast("double").alias("lon2"),
        F.get(head, 4).try_cast("double").alias("lat2"),
        _end_roads(F.coalesce(F.get(parts, 2), F.lit(""))).alias("end_roads"),
    )


def road_topology_adj(topo: DataFrame) -> DataFrame:
    """Exploded form (road_id, end_no, nbr)."""
    return topo.select(
        "road_id",
        F.explode(
            F.concat(
                F.transform("start_roads", lambda r: F.struct(F.lit(1).alias("end_no"), r.alias("nbr"))),
                F.transform("end_roads", lambda r: F.struct(F.lit(2).alias("end_no"), r.alias("nbr"))),
            )
        ).alias("e"),
    ).select("road_id", "e.end_no", "e.nbr")


def format_road_topology(roads: DataFrame) -> DataFrame:
    ends = roads.select("road_id", F.explode(F.array(
        F.struct(F.lit(1).alias("end_no"), F.col("a").alias("node")),
        F.struct(F.lit(2).alias("end_no"), F.col("b").alias("node")))).alias("e")).select("road_id", "e.*")
    at = ends.select(F.col("node"), F.col("road_id").alias("nbr"))
    lists = (
        ends.join(at, "node")
        .where(F.col("road_id") != F.col("nbr"))
        .groupBy("road_id", "end_no")
        .agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))
    )
    s = lists.where(F.col("end_no") == 1).select("road_id", F.col("nbrs").alias("s"))
    e = lists.where(F.col("end_no") == 2).select("road_id", F.col("nbrs").alias("e"))
    r = roads.join(s, "road_id", "left").join(e, "road_id", "left")

    def end(x, y, lst):
        return F.when(F.size(F.coalesce(lst, F.array())) > 0,
                      F.concat(fmt_point(x, y), F.lit(":"), F.array_join(lst, ","))).otherwise(fmt_point(x, y))

    head = F.concat_ws(",", "road_id", fmt_point(F.col("xa"), F.col("ya")), fmt_point(F.col("xb"), F.col("yb")))
    return r.select(
        F.concat_ws("|", head, end(F.col("xa"), F.col("ya"), F.col("s")), end(F.col("xb"), F.col("yb"), F.col("e")))
        .alias("value")
    )


# ------------------------------------------------------------------ grid index

def parse_grid_index(lines: DataFrame) -> DataFrame:
    """(cell, road_id, lonlats ARRAY<STRING>) from JSON lines.

    The cell's name is taken out before its roads are exploded: beside ``j.nodes`` exploded, every road's row would
    carry the whole line, so a cell of many roads would cost the square of them.  A line's roads are cut into
    one text each and leave it ``LINE_ROADS`` at a time, and their points are parsed after the explode, so a long line's points are
    never all in memory as objects, nor its roads copied into one row.  The outer forms, whose rows for empty
    cells go again, keep the optimizer from parsing each line a second time to find these beforehand.
    A line with a road that is no object has no list of roads; all objects as text lie between ``{`` and ``|``."""

    def chunks(j: Column) -> Column:
        nodes = j["nodes"]
        objects = F.coalesce((F.array_min(nodes) >= "{") & (F.array_max(nodes) < "|"), F.lit(True))
        last = F.floor((F.size(nodes) - 1) / F.lit(LINE_ROADS)).cast("int")
        some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct(j["GeoHash"].alias("cell"), F.slice(nodes, k * LINE_ROADS + 1, F.lit(LINE_ROADS)).alias("nodes")))
        return F.when(nodes.isNotNull() & objects, some)

    line = F.array(F.from_json(F.col("value"), GRID_LINE_SCHEMA))  # of one, so that it is parsed once
    cells = lines.select(F.explode_outer(F.element_at(F.transform(line, chunks), 1)).alias("c")).select("c.cell", "c.nodes")
    roads = cells.select("cell", F.posexplode_outer("nodes").alias("at", "text")).where("at is not null")
    roads = roads.select("cell", F.from_json("text", GRID_SCHEMA["nodes"].dataType.elementType).alias("n"))
    return roads.select("cell", F.col("n.RoadId").alias("road_id"), F.col("n.LonLats").alias("lonlats"))


def read_grid_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_grid_index(spark.read.text(path))


def format_grid_index(grid: DataFrame) -> DataFrame:
    """A cell's roads become text before they are gathered, and the line is put together at once from these texts: a
    cell of many roads takes its line's size a few times, not all its points as objects."""
    road = F.to_json(F.struct(F.col("road_id").alias("RoadId"), F.col("lonlats").alias("LonLats")))
    texts = F.sort_array(F.collect_list(F.struct("road_id", road.alias("text"))))["text"]
    name = F.to_json(F.struct(F.col("cell").alias("GeoHash")))
    head = F.when(F.col("cell").isNull(), F.lit('{"nodes":[')).otherwise(F.concat(F.left(name, F.length(name) - 1), F.lit(',"nodes":[')))
    first, tail, n = F.concat(head, F.element_at(texts, 1)), F.lit("]}"), F.size(texts)
    many = F.concat_ws(",", first, F.slice(texts, F.lit(2), n - 2), F.concat(F.element_at(texts, -1), tail))
    return grid.groupBy("cell").agg(F.when(n > 1, many).otherwise(F.concat(first, tail)).alias("value"))


# ------------------------------------------------------------------ edge table

EDGE_COLUMNS = {"id": "string", "roadid": "string", "source": "string", "target": "string", "cost": "double", "reverse_cost": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double"}


def read_edge_table(spark: SparkSession, path: str) -> DataFrame:
    """Edge table from parquet, ids as text whatever their type was; rows without a road, a node or a cost are left out.
    The same contract could be read with ``spark.read.jdbc``."""
    table = spark.read.parquet(path)
    missing = set(EDGE_COLUMNS) - set(table.columns)
    if missing:
        raise ValueError(f"the edge table at {path} lacks {sorted(missing)}")
    own = table.select(*[F.col(c).cast(t).alias(c) for c, t in EDGE_COLUMNS.items()])
    return own.where("roadid is not null and source is not null and target is not null and cost is not null").withColumn("reverse_cost", F.coalesce("reverse_cost", F.lit(-1.0)))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
