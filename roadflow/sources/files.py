"""Readers and writers for trajectory text, GraphML networks, query CSV and speed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock

QUERY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("source_lat", T.DoubleType()),
        T.StructField("source_lon", T.DoubleType()),
        T.StructField("dest_lat", T.DoubleType()),
        T.StructField("dest_lon", T.DoubleType()),
        T.StructField("source_time", T.StringType()),
    ]
)


def vehicle_key(name):
    """A vehicle id without folder or ``.txt``."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.txt$", "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Pings from ``lines(vehicle_id, line_no, value)``.

    A line has at least four tokens (``lat lon flag ts``), else it is skipped;
    further tokens are ignored.  A vehicle with a token that is no number is
    dropped whole.  ``seq`` numbers the pings by time, then by line.
    """
    t = lines.withColumn("t", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).where(F.size("t") >= 4)
    cast = [F.expr(f"try_cast(t[{k}] AS {kind})").alias(n) for k, (n, kind) in enumerate((("lat", "double"), ("lon", "double"), ("flag", "int"), ("ts", "bigint")))]
    p = t.select("vehicle_id", "line_no", *cast)
    bad = p.where("lat IS NULL OR lon IS NULL OR flag IS NULL OR ts IS NULL").select("vehicle_id").distinct()
    return number(p.join(bad, "vehicle_id", "left_anti"))


def number(p: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return p.withColumn("seq", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("ts", "line_no")).cast("long")).select("vehicle_id", "seq", "lat", "lon", "flag", "ts")


def read_trajectories(spark: SparkSession, *dirs: str) -> DataFrame:
    """Pings of all ``*.txt`` files of one or more folders; the file's stem is the vehicle id."""
    parts = [f"{d.rstrip('/')}/*.txt" for d in dirs]
    raw = spark.read.text(parts, wholetext=True).select(vehicle_key(F.col("_metadata.file_name")).alias("vehicle_id"), "value")
    return parse_lines(raw.select("vehicle_id", F.posexplode(F.split("value", "\n")).alias("line_no", "value")))


def union_pings(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(node_id, lat, lon)`` and ``edges(u, v, k, highway, length_m, geom)`` of a GraphML road network.

    Keys are resolved by their declared names.  A list-valued highway tag gives
    its first entry, an empty one ``unclassified``; an edge without geometry is a
    straight line.
    """
    keys = {(r["_attr.name"], r["_for"]): r["_id"] for r in spark.read.format("xml").option("rowTag", "key").load(path).select("`_attr.name`", "_for", "_id").collect()}
    data = "data ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>"

    def value(name: str, kind: str):
        return F.get(F.filter("data", lambda x: x["_key"] == keys.get((name, kind), "")), F.lit(0))["_VALUE"] if (name, kind) in keys else F.lit(None).cast("string")

    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id STRING, {data}").load(path)
    nodes = n.select(F.col("_id").cast("long").alias("node_id"), value("y", "node").cast("double").alias("lat"), value("x", "node").cast("double").alias("lon"))
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source STRING, _target STRING, _id STRING, {data}").load(path)
    tag = value("highway", "edge")
    first = F.regexp_extract(tag, r"^\[\s*['\"]?([^'\",\]]*)", 1)
    e = e.select(
        F.col("_source").cast("long").alias("u"),
        F.col("_target").cast("long").alias("v"),
        F.coalesce(F.expr("try_cast(_id AS int)"), F.lit(0)).alias("k"),
        F.coalesce(F.nullif(F.trim(F.when(tag.startswith("["), first).otherwise(tag)), F.lit("")), F.lit("unclassified")).alias("highway"),
        value("length", "edge").cast("double").alias("length_m"),
        value("geometry", "edge").alias("wkt"),
    )
    inner = F.regexp_extract("wkt", r"\(([^)]*)\)", 1)
    points = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat")))
    a, b = nodes.toDF("u", "alat", "alon"), nodes.toDF("v", "blat", "blon")
    line = F.array(F.struct(F.col("alon").alias("lon"), F.col("alat").alias("lat")), F.struct(F.col("blon").alias("lon"), F.col("blat").alias("lat")))
    edges = e.join(a, "u").join(b, "v").select("u", "v", "k", "highway", "length_m", F.when(F.col("wkt").isNotNull(), points).otherwise(line).alias("geom"))
    return nodes, edges


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query trips; ``source_time`` in seconds, vehicle ids without ``.txt``."""
    q = spark.read.csv(path, header=True, schema=QUERY_SCHEMA)
    return q.withColumn("source_time", clock.parse_query_time(F.col("source_time"))).withColumn("vehicle_id", vehicle_key(F.col("vehicle_id")))


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """The synthetic validation trips: ``source_time`` in seconds, with ``duration_min``, without ``id``."""
    return spark.read.csv(path, header=True, inferSchema=False).select(
        vehicle_key(F.col("vehicle_id")).alias("vehicle_id"),
        *[F.col(c).cast("double").alias(c) for c in ("source_lat", "source_lon", "dest_lat", "dest_lon", "duration_min")],
        F.col("source_time").cast("double").cast("long").alias("source_time"),
    )


def write_predictions(df: DataFrame, path: str) -> None:
    """``id,duration_min`` with a header."""
    df.select("id", "duration_min").write.mode("overwrite").csv(path, header=True)


def write_speeds(df: DataFrame, path: str) -> None:
    """A speed table, partitioned by date so that readers of a day open that day alone."""
    df.write.mode("overwrite").partitionBy("date").parquet(path)


def route_geojson(route: DataFrame) -> DataFrame:
    """One GeoJSON feature a row of ``route(lat, lon, ...)``, for maps."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    rest = [c for c in route.columns if c not in ("lat", "lon")]
    return route.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))


def spill(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that iterative fits don't recompute it."""
    import tempfile
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        base = f"file://{tempfile.gettempdir()}/roadflow-shared"
    path = f"{base.rstrip('/')}/spill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
