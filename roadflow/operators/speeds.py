"""Segment speeds: observation, aggregation, propagation, default fill, merge and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_CAP_MS, HOPS, MAX_SPEED_MS, OBSERVED_BOOST, SPEED_CAP_MS
from ..functions import clock, geo
from ..sources.files import spill
from .network import adjacency, default_speed, lookup

EDGE = ["u", "v", "k"]
KEY = ["u", "v", "k", "date", "bin"]


def consecutive(pings: DataFrame, columns: list[str]) -> DataFrame:
    """Each ping with the next one's ``columns`` as ``n_*``, by raw adjacency."""
    w = Window.partitionBy("vehicle_id").orderBy("ts", "seq")
    return pings.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in columns])


def valid(pairs: DataFrame, max_speed: float = MAX_SPEED_MS) -> DataFrame:
    """Pairs with time, distance and a possible speed between them: adds ``dist_m, dt_s, speed_ms``."""
    p = pairs.withColumn("dist_m", geo.haversine_m(*map(F.col, ("lat", "lon", "n_lat", "n_lon")))).withColumn("dt_s", F.abs(F.col("n_ts") - F.col("ts")))
    p = p.where("dt_s <> 0 AND dist_m <> 0").withColumn("speed_ms", F.col("dist_m") / F.col("dt_s"))
    return p.where(F.col("speed_ms") <= max_speed)


def pair_speeds(pings: DataFrame) -> DataFrame:
    """Speeds between consecutive raw pings."""
    return valid(consecutive(pings, ["lat", "lon", "ts", "flag"]).where("n_ts IS NOT NULL"))


def with_bin(df: DataFrame, ts: Column) -> DataFrame:
    return df.withColumn("date", clock.date_str(ts)).withColumn("bin", clock.tod_bin(ts))


def cap(highway: Column) -> Column:
    return lookup(SPEED_CAP_MS, F.coalesce(highway, F.lit("")), DEFAULT_CAP_MS)


def matched_pairs(matched: DataFrame, respect_breaks: bool = False) -> DataFrame:
    """Neighbouring pings (raw adjacency) that are both matched, at their matched positions.

    ``matched`` has a row a raw ping, its match null where there is none.
    ``respect_breaks`` also leaves out pairs across a change of ``segment_id``.
    """
    columns = ["u", "v", "k", "proj_lat", "proj_lon", "ts", "flag"] + (["segment_id"] if respect_breaks else [])
    p = consecutive(matched, columns).where("u IS NOT NULL AND n_u IS NOT NULL")
    return p.where("segment_id = n_segment_id") if respect_breaks else p


def observations(pairs: DataFrame, highways: DataFrame | None = None) -> DataFrame:
    """``(u, v, k, date, bin, speed, weight)``: both edges of a pair are credited, once if they are the same.

    A pair that is occupied at both ends weighs 2.  ``highways(u, v, k, highway)``
    switches the road-class caps on: the higher cap of the two edges counts.
    """
    p = pairs.select(*EDGE, "n_u", "n_v", "n_k", F.col("proj_lat").alias("lat"), F.col("proj_lon").alias("lon"), F.col("n_proj_lat").alias("n_lat"), F.col("n_proj_lon").alias("n_lon"), "ts", "n_ts", "flag", "n_flag")
    p = valid(p)
    if highways is not None:
        own = highways.select(*EDGE, F.col("highway").alias("hw"))
        nxt = own.toDF("n_u", "n_v", "n_k", "n_hw")
        p = p.join(own, EDGE, "left").join(nxt, ["n_u", "n_v", "n_k"], "left").where(F.col("speed_ms") <= F.greatest(cap(F.col("hw")), cap(F.col("n_hw"))))
    p = with_bin(p, F.floor((F.col("ts") + F.col("n_ts")) / 2))
    both = F.array_distinct(F.array(F.struct(*EDGE), F.struct(F.col("n_u").alias("u"), F.col("n_v").alias("v"), F.col("n_k").alias("k"))))
    weight = F.when((F.col("flag") == 1) & (F.col("n_flag") == 1), 2).otherwise(1)
    return p.select(F.explode(both).alias("e"), "date", "bin", F.col("speed_ms").alias("speed"), weight.alias("weight")).select("e.*", "date", "bin", "speed", "weight")


def aggregate(obs: DataFrame) -> DataFrame:
    """Weighted median speed of each segment and half hour."""
    return obs.groupBy(*KEY).agg(F.expr("percentile(speed, 0.5, weight)").alias("speed"), F.sum("weight").cast("long").alias("n_obs"))


def at_least(matched: DataFrame, n: int = 2) -> DataFrame:
    """The pings of vehicles with at least ``n`` matches."""
    return matched.withColumn("_m", F.count("u").over(Window.partitionBy("vehicle_id"))).where(F.col("_m") >= n).drop("_m")


def time_of_day(speeds: DataFrame) -> DataFrame:
    """Median over dates for each segment and half hour of the day."""
    return speeds.groupBy(*EDGE, "bin").agg(F.percentile("speed", 0.5).alias("tod_speed"))


def road_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.replace(a, F.lit("_link"), F.lit("")) == F.replace(b, F.lit("_link"), F.lit("")), 0.5).otherwise(0.2)


def length_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise(F.exp(-F.abs(a - b) / top))


def neighbours(edges: DataFrame) -> DataFrame:
    """Adjacency with the similarity weight of each pair; computed once and reused by every hop."""
    meta = edges.select(*EDGE, F.coalesce("highway", F.lit("unclassified")).alias("hw"), F.coalesce("length_m", F.lit(0.0)).alias("len"))
    other = meta.toDF("nu", "nv", "nk", "nhw", "nlen")
    a = adjacency(edges).join(meta, EDGE).join(other, ["nu", "nv", "nk"])
    return a.select(*EDGE, "nu", "nv", "nk", (road_similarity(F.col("hw"), F.col("nhw")) * length_similarity(F.col("len"), F.col("nlen"))).alias("w"))


def propagate_hop(known: DataFrame, near: DataFrame) -> DataFrame:
    """Estimates ``(u, v, k, date, bin, speed)`` for unknown segments next to ``known(u, v, k, date, bin, speed, observed)``, all bins at once."""
    src = known.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("k").alias("nk"), "date", "bin", "speed", "observed")
    w = F.col("w") * F.when(F.col("observed"), OBSERVED_BOOST).otherwise(1.0)
    met = near.join(src, ["nu", "nv", "nk"])
    est = met.groupBy(*KEY).agg((F.sum(w * F.col("speed")) / F.sum(w)).alias("speed"))
    return est.join(known.select(*KEY), KEY, "left_anti")


def propagate(observed: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """Observed speeds plus ``hops`` rounds of estimates; ``origin`` is ``observed`` or ``propagated``.

    A hop's decay would multiply all weights of a weighted mean alike, so it
    cancels and is left out.  Each round reads the values before it.
    """
    near = spill(neighbours(edges))
    known = spill(observed.select(*KEY, "speed", F.lit(True).alias("observed")))
    for hop in range(hops):  # a hop reads what is known twice, so it is written between hops
        known = known.unionByName(propagate_hop(known, near).withColumn("observed", F.lit(False)))
        known = spill(known) if hop < hops - 1 else known
    return known.select(*KEY, "speed", F.when(F.col("observed"), "observed").otherwise("propagated").alias("origin"))


def default_fill(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` plus the road-class default for every other segment in every active half hour."""
    bins = known.select("date", "bin").distinct()
    # the result has a row a segment and active half hour by definition: at most 48 a day, whatever the pings
    every = edges.select(*EDGE, "highway").join(F.broadcast(bins), F.lit(True))
    rest = every.join(known.select(*KEY), KEY, "left_anti")
    return known.unionByName(rest.select(*KEY, default_speed(F.col("highway")).alias("speed"), F.lit("default").alias("origin")))


def complete(observed: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """Phase B: observed speeds, ``hops`` rounds of estimates, then road-class defaults for the rest of every active half hour."""
    return default_fill(spill(propagate(observed, edges, hops)), edges)


def merge(existing: DataFrame, new_obs: DataFrame) -> DataFrame:
    """Existing speeds as one more observation (weight 1) beside the new ones; the weighted median of each key."""
    both = existing.select(*KEY, "speed", F.lit(1).alias("weight")).unionByName(new_obs.select(*KEY, "speed", "weight"))
    return both.groupBy(*KEY).agg(F.expr("percentile(speed, 0.5, weight)").alias("speed"))


def look_up(wanted: DataFrame, speeds: DataFrame) -> DataFrame:
    """``wanted(u, v, k, date, bin)`` with ``speed``: the exact one, else the median over dates, else null."""
    exact = speeds.select(*KEY, F.col("speed").alias("_exact"))
    return wanted.join(exact, KEY, "left").join(time_of_day(speeds), [*EDGE, "bin"], "left").withColumn("speed", F.coalesce("_exact", "tod_speed")).drop("_exact", "tod_speed")


def travel_time(wanted: DataFrame) -> DataFrame:
    """Adds ``tt`` in seconds to ``wanted(length_m, highway, speed)``: 0 without length; speeds up to 0.1 m/s count as missing."""
    speed = F.when(F.col("speed") > 0.1, F.col("speed")).otherwise(default_speed(F.col("highway")))
    return wanted.withColumn("tt", F.when(F.coalesce("length_m", F.lit(0.0)) <= 0, 0.0).otherwise(F.col("length_m") / speed))


def coverage(obs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: keys, observations, segments seen, their share of the network, median observations of a key."""
    keys = obs.groupBy(*KEY).agg(F.sum("weight").alias("n"))
    a = keys.agg(F.count("*").alias("n_keys"), F.sum("n").cast("long").alias("n_obs"), F.count_distinct(F.struct(*EDGE)).alias("n_edges_seen"), F.percentile("n", 0.5).alias("median_obs_per_key"))
    b = edges.agg(F.count("*").alias("n_edges"))
    return a.crossJoin(b).withColumn("pct_covered", 100.0 * F.col("n_edges_seen") / F.col("n_edges"))


def bin_summary(speeds: DataFrame) -> DataFrame:
    return speeds.agg(F.count_distinct("date", "bin").alias("n_bins"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct(*EDGE).alias("n_segments"))
