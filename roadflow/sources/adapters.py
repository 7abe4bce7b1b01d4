"""Deterministic trajectory views of the star-schema tables.

They stand in for GPS files: ``pings`` walks each user's events over a 16 x 16
street grid, ``nodes`` and ``edges`` are that grid, ``weather`` is an hourly table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo

BASE_TS = 1212796800  # 2008-06-07 00:00 UTC
GRID, STEP, LAT0, LON0 = 16, 0.005, 37.70, -122.50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(events: DataFrame) -> DataFrame:
    """``(vehicle_id, seq, lat, lon, flag, ts)``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.select("user_id", "event_id", "event_type", F.row_number().over(w).cast("long").alias("rn"))
    row = F.pmod(F.col("user_id") * 5 + F.floor(F.col("rn") / 16), F.lit(16))
    col = F.pmod(F.col("user_id") * 3 + F.col("rn"), F.lit(16))
    return e.select(
        F.col("user_id").alias("vehicle_id"),
        F.col("rn").alias("seq"),
        (F.lit(LAT0) + F.lit(STEP) * row.cast("double") + (F.pmod(F.col("event_id") * 7919, F.lit(401)) - 200).cast("double") * F.lit(1e-6)).alias("lat"),
        (F.lit(LON0) + F.lit(STEP) * col.cast("double") + (F.pmod(F.col("event_id") * 104729, F.lit(401)) - 200).cast("double") * F.lit(1e-6)).alias("lon"),
        F.when(F.col("event_type").isin("click", "purchase", "view"), 1).otherwise(0).alias("flag"),
        (F.lit(BASE_TS) + F.pmod("user_id", F.lit(7)) * 10800 + F.col("rn") * 75 + F.pmod(F.col("event_id") * 31, F.lit(60))).cast("long").alias("ts"),
    )


def nodes(spark: SparkSession) -> DataFrame:
    n = spark.range(GRID * GRID).withColumnRenamed("id", "node_id")
    return n.select("node_id", (F.lit(LAT0) + F.lit(STEP) * F.floor(F.col("node_id") / GRID).cast("double")).alias("lat"), (F.lit(LON0) + F.lit(STEP) * F.pmod("node_id", F.lit(GRID)).cast("double")).alias("lon"))


def edges(spark: SparkSession) -> DataFrame:
    """``(u, v, k, highway, length_m, geom)``: both directions between grid neighbours."""
    n = nodes(spark).withColumn("x", F.pmod("node_id", F.lit(GRID))).withColumn("y", F.floor(F.col("node_id") / GRID))
    move = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("m")
    e = n.select("*", move).withColumn("vx", F.col("x") + F.col("m.dx")).withColumn("vy", F.col("y") + F.col("m.dy"))
    e = e.where(F.col("vx").between(0, GRID - 1) & F.col("vy").between(0, GRID - 1))
    vlat, vlon = F.lit(LAT0) + F.lit(STEP) * F.col("vy").cast("double"), F.lit(LON0) + F.lit(STEP) * F.col("vx").cast("double")
    index = F.pmod(F.when(F.col("m.dx") == 0, F.col("x")).otherwise(F.col("y")), F.lit(5)).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("motorway", "primary", "secondary_link", "residential", "tertiary"))), index + 1)
    return e.select(
        F.col("node_id").alias("u"),
        (F.col("vy") * GRID + F.col("vx")).alias("v"),
        F.lit(0).alias("k"),
        kind.alias("highway"),
        geo.haversine_m(F.col("lat"), F.col("lon"), vlat, vlon).alias("length_m"),
        F.array(F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat")), F.struct(vlon.alias("lon"), vlat.alias("lat"))).alias("geom"),
    )


def weather(events: DataFrame) -> DataFrame:
    """``(timestamp_hour, temp_c, precip_mm, wind_kph, condition)``; temperature and wind have gaps."""
    hk = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - 473352).cast("long")
    g = events.groupBy(hk.alias("hk")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    gap = F.pmod("hk", F.lit(11)) == 0
    return g.select(
        (F.lit(BASE_TS) + F.col("hk") * 3600).alias("timestamp_hour"),
        F.when(~gap, F.col("lo") / 10.0).alias("temp_c"),
        (F.pmod("n", F.lit(5)).cast("double") / 10.0).alias("precip_mm"),
        F.when(~gap, F.col("hi") / 20.0).alias("wind_kph"),
        F.pmod("n", F.lit(27)).cast("string").alias("condition"),
    )
