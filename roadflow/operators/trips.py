"""Trip segmentation, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TRIP_GAP_S, TRIP_MAX_S, TRIP_MIN_POINTS, TRIP_MIN_S
from ..functions import clock, geo



def _by_vehicle():
    return Window.partitionBy("vehicle_id").orderBy("ts", "seq")


def prefix(pings: DataFrame, cap: int, min_points: int = TRIP_MIN_POINTS) -> DataFrame:
    """The first ``cap`` pings of vehicles with at least ``min_points``."""
    n = F.count("*").over(Window.partitionBy("vehicle_id"))
    p = pings.withColumn("_n", n).withColumn("_r", F.row_number().over(_by_vehicle()))
    return p.where((F.col("_n") >= min_points) & (F.col("_r") <= cap)).drop("_n", "_r")


def _bounds(runs: DataFrame, min_points: int) -> DataFrame:
    first, last = (f(F.struct("seq", "ts", "lat", "lon")) for f in (F.min, F.max))
    t = runs.groupBy("vehicle_id", "grp").agg(first.alias("a"), last.alias("z"), F.count("*").alias("n_points")).where(F.col("n_points") >= min_points)
    return t.select(
        "vehicle_id",
        "grp",
        "n_points",
        F.col("a.seq").alias("first_seq"),
        F.col("z.seq").alias("last_seq"),
        F.col("a.lat").alias("source_lat"),
        F.col("a.lon").alias("source_lon"),
        F.col("a.ts").alias("source_time"),
        F.col("z.lat").alias("dest_lat"),
        F.col("z.lon").alias("dest_lon"),
        ((F.col("z.ts") - F.col("a.ts")) / 60.0).alias("duration_min"),
    )


def flag_runs(pings: DataFrame) -> DataFrame:
    """Pings of occupied runs with ``grp``: from a flag of 1 to the last ping before a flag of 0; other flags neither start nor end one."""
    p = pings.withColumn("grp", F.sum((F.col("flag") == 0).cast("long")).over(_by_vehicle().rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.max((F.col("flag") == 1).cast("int")).over(Window.partitionBy("vehicle_id", "grp").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("_in", seen).where("_in = 1 AND flag <> 0").drop("_in")


def gap_runs(pings: DataFrame, gap_s: int = TRIP_GAP_S) -> DataFrame:
    """All pings with ``grp``: a new one begins where more than ``gap_s`` seconds passed."""
    late = (F.col("ts") - F.lag("ts").over(_by_vehicle()) > gap_s).cast("long")
    p = pings.withColumn("_late", F.coalesce(late, F.lit(0).cast("long")))
    return p.withColumn("grp", F.sum("_late").over(_by_vehicle().rowsBetween(Window.unboundedPreceding, 0))).drop("_late")


def in_band(trips: DataFrame) -> DataFrame:
    return trips.where(F.col("duration_min").between(TRIP_MIN_S / 60.0, TRIP_MAX_S / 60.0))


def gap_trips(pings: DataFrame, min_points: int = TRIP_MIN_POINTS, gap_s: int = TRIP_GAP_S) -> DataFrame:
    """Trips of all vehicles cut at long gaps alone."""
    return _bounds(gap_runs(pings, gap_s), min_points)


def segments(pings: DataFrame, min_points: int = TRIP_MIN_POINTS) -> DataFrame:
    """Trips within the duration band: by flag, or by gaps for vehicles without any flag of 1."""
    has = F.max((F.col("flag") == 1).cast("int")).over(Window.partitionBy("vehicle_id"))
    p = pings.withColumn("_has", has)
    flagged = _bounds(flag_runs(p.where("_has = 1").drop("_has")), min_points)
    return in_band(flagged.unionByName(_bounds(gap_runs(p.where("_has = 0").drop("_has")), min_points)))


def prefix_samples(pings: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Up to ``k`` shorter trips from each flagged trip: interior end points picked by an integer hash, at least a minute long."""
    runs = flag_runs(pings)
    w = Window.partitionBy("vehicle_id", "grp")
    r = runs.withColumn("idx", F.row_number().over(w.orderBy("ts", "seq")) - 1).withColumn("n", F.count("*").over(w)).where(F.col("n") >= TRIP_MIN_POINTS)
    start = F.first(F.struct("ts", "lat", "lon")).over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("ts").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = r.withColumn("a", start).withColumn("end_ts", last).where((F.col("end_ts") - F.col("a.ts")).between(TRIP_MIN_S, TRIP_MAX_S))
    draw = F.pmod((F.col("vehicle_id") * 7919 + F.col("grp") * 104729 + F.col("idx") * 15485863 + seed) * 31, F.lit(1000003))
    r = r.where((F.col("idx") >= 2) & (F.col("idx") <= F.col("n") - 2)).withColumn("draw", draw)
    r = r.withColumn("pick", F.row_number().over(w.orderBy("draw", "idx"))).where((F.col("pick") <= k) & (F.col("ts") - F.col("a.ts") >= TRIP_MIN_S))
    return r.select("vehicle_id", "grp", "idx", F.col("a.lat").alias("source_lat"), F.col("a.lon").alias("source_lon"), F.col("a.ts").alias("source_time"), F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"), ((F.col("ts") - F.col("a.ts")) / 60.0).alias("duration_min"))


def training_rows(pings: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Whole trips and the shorter ones cut from them; ``idx`` is null for whole trips."""
    columns = ["vehicle_id", "grp", "idx", "source_lat", "source_lon", "source_time", "dest_lat", "dest_lon", "duration_min"]
    whole = segments(pings).withColumn("idx", F.lit(None).cast("int")).select(*columns)
    return whole.unionByName(prefix_samples(pings, k, seed).withColumn("idx", F.col("idx").cast("int")).select(*columns))


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that come first in an integer-hash order of ``key``: the same ones on every run."""
    draw = F.pmod((F.col(key) * 7919 + seed) * 31, F.lit(1000003))
    return rows.orderBy(draw, key).limit(n)


def validation_pairs(pings: DataFrame, per_vehicle: int = 8, seed: int = 42, min_points: int = 20, min_m: float = 100.0) -> DataFrame:
    """Synthetic validation trips: interior start points in the first 90 % of a vehicle's pings, each with one later end within the duration band, picked by an integer hash."""
    w = Window.partitionBy("vehicle_id")
    p = pings.withColumn("idx", F.row_number().over(_by_vehicle()) - 1).withColumn("n", F.count("*").over(w)).where(F.col("n") >= min_points)
    a = p.where(F.col("idx") < F.floor(F.col("n") * 9 / 10)).select("vehicle_id", F.col("idx").alias("a"), F.col("lat").alias("source_lat"), F.col("lon").alias("source_lon"), F.col("ts").alias("source_time"))
    b = p.select("vehicle_id", F.col("idx").alias("b"), F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"), F.col("ts").alias("dest_time"))
    late = F.col("dest_time") - F.col("source_time")
    ab = a.join(b, "vehicle_id").where((F.col("b") > F.col("a")) & late.between(TRIP_MIN_S, TRIP_MAX_S))
    draw = F.pmod((F.col("vehicle_id") * 7919 + F.col("a") * 104729 + F.col("b") * 15485863 + seed) * 31, F.lit(1000003))
    ab = ab.withColumn("draw", draw).where(geo.haversine_m(*map(F.col, ("source_lat", "source_lon", "dest_lat", "dest_lon"))) >= min_m)
    one = ab.withColumn("r", F.row_number().over(Window.partitionBy("vehicle_id", "a").orderBy("draw", "b"))).where("r = 1")
    some = one.withColumn("r", F.row_number().over(w.orderBy("draw", "a"))).where(F.col("r") <= per_vehicle)
    return some.select("vehicle_id", "a", "b", "source_lat", "source_lon", "source_time", "dest_lat", "dest_lon", (late / 60.0).alias("duration_min"))


def chrono_split(trips: DataFrame, days: float = 3.0) -> DataFrame:
    """``is_val``: the trips of the last ``days``."""
    latest = trips.agg((F.max("source_time") - F.lit(days * 86400)).alias("cutoff"))
    return trips.crossJoin(F.broadcast(latest)).withColumn("is_val", F.col("source_time") > F.col("cutoff")).drop("cutoff")


def basic_features(trips: DataFrame) -> DataFrame:
    """Distance, bearing and calendar features of trips."""
    od = [F.col(c) for c in ("source_lat", "source_lon", "dest_lat", "dest_lon")]
    ts = F.col("source_time")
    dow = clock.day_of_week(ts)
    return trips.select(
        "*",
        (geo.haversine_m(*od) / 1000.0).alias("haversine_km"),
        geo.manhattan_km(*od).alias("manhattan_km"),
        geo.bearing_deg(*od).alias("bearing"),
        clock.hour(ts).alias("hour"),
        clock.minute_of_day(ts).alias("minute_of_day"),
        dow.alias("day_of_week"),
        (dow >= 5).cast("int").alias("is_weekend"),
        F.sin(clock.hour_angle(ts)).alias("hour_sin"),
        F.cos(clock.hour_angle(ts)).alias("hour_cos"),
    )
