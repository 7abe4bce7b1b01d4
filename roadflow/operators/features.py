"""Vehicle, weather and historical features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from . import speeds, trips

VEHICLE = ["v_mean_speed_ms", "v_median_speed_ms", "v_p20_speed_ms", "v_p80_speed_ms", "v_total_km", "v_n_points", "v_hour_dominant", "v_hour_entropy", "v_pct_highway", "v_typical_trip_min", "v_n_trips"]
HOURS = [f"v_hour_speed_h{h:02d}" for h in range(24)]


def vehicle_pairs(matched: DataFrame, highways: DataFrame) -> DataFrame:
    """Valid matched pairs with the hour of the first ping and the road class of the second match."""
    p = speeds.matched_pairs(matched)
    p = p.select("vehicle_id", "seq", "ts", F.col("proj_lat").alias("lat"), F.col("proj_lon").alias("lon"), F.col("n_proj_lat").alias("n_lat"), F.col("n_proj_lon").alias("n_lon"), "n_ts", "n_u", "n_v", "n_k")
    p = speeds.valid(p).withColumn("hour", clock.hour(F.col("ts")))
    return p.join(highways.select(F.col("u").alias("n_u"), F.col("v").alias("n_v"), F.col("k").alias("n_k"), "highway"), ["n_u", "n_v", "n_k"], "left")


def vehicle_stats(pairs: DataFrame) -> DataFrame:
    p = F.percentile("speed_ms", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))
    s = pairs.groupBy("vehicle_id").agg(F.avg("speed_ms").alias("v_mean_speed_ms"), p.alias("p"), (F.sum("dist_m") / 1000.0).alias("v_total_km"), F.count("*").alias("n_pairs"))
    return s.where("n_pairs >= 2").select("vehicle_id", "v_mean_speed_ms", F.col("p")[1].alias("v_median_speed_ms"), F.col("p")[0].alias("v_p20_speed_ms"), F.col("p")[2].alias("v_p80_speed_ms"), "v_total_km", "n_pairs")


def dominant_hour(pairs: DataFrame) -> DataFrame:
    """The most frequent hour; the one seen first wins ties."""
    h = pairs.groupBy("vehicle_id", "hour").agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "hour"))
    return h.groupBy("vehicle_id").agg(best.alias("b")).select("vehicle_id", F.col("b.hour").alias("v_hour_dominant"))


def hour_entropy(pairs: DataFrame) -> DataFrame:
    h = pairs.groupBy("vehicle_id", "hour").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("vehicle_id"))
    return h.withColumn("p", p).groupBy("vehicle_id").agg((-F.sum(F.col("p") * F.log("p")) / math.log(24)).alias("v_hour_entropy"))


def pct_highway(pairs: DataFrame) -> DataFrame:
    on = F.coalesce(F.col("highway").rlike("motorway|trunk"), F.lit(False)).cast("double")
    return pairs.groupBy("vehicle_id").agg(F.avg(on).alias("v_pct_highway"))


def typical_trip(pings: DataFrame) -> DataFrame:
    """Median and number of flagged trips in the duration band, of any number of pings; 10 minutes where there is none."""
    runs = trips.flag_runs(pings).groupBy("vehicle_id", "grp").agg(((F.max("ts") - F.min("ts")) / 60.0).alias("duration_min"))
    t = trips.in_band(runs).groupBy("vehicle_id").agg(F.percentile("duration_min", 0.5).alias("m"), F.count("*").alias("n"))
    v = pings.groupBy("vehicle_id").agg(F.count("*").alias("v_n_points"))
    return v.join(t, "vehicle_id", "left").select("vehicle_id", "v_n_points", F.coalesce("m", F.lit(10.0)).alias("v_typical_trip_min"), F.coalesce("n", F.lit(0)).alias("v_n_trips"))


def hour_speeds(pairs: DataFrame) -> DataFrame:
    """24 median speeds, one an hour; hours without pairs take the overall median."""
    cells = [F.percentile(F.when(F.col("hour") == h, F.col("speed_ms")), 0.5).alias(c) for h, c in enumerate(HOURS)]
    g = pairs.groupBy("vehicle_id").agg(F.percentile("speed_ms", 0.5).alias("_all"), *cells)
    return g.select("vehicle_id", *[F.coalesce(c, "_all").alias(c) for c in HOURS])


def enrich_hours(features: DataFrame, pings: DataFrame) -> DataFrame:
    """24 hourly speeds from raw pings for known vehicles; those without speeds take their median or 10."""
    known = pings.join(features.select("vehicle_id"), "vehicle_id", "left_semi")
    h = hour_speeds(speeds.pair_speeds(known).withColumn("hour", clock.hour(F.col("ts"))))
    rest = features.drop(*[c for c in HOURS if c in features.columns])
    return rest.join(h, "vehicle_id", "left").select(*rest.columns, *[F.coalesce(c, "v_median_speed_ms", F.lit(10.0)).alias(c) for c in HOURS])


def vehicle_features(matched: DataFrame, pings: DataFrame, highways: DataFrame) -> DataFrame:
    """All 35 features of vehicles with at least two valid pairs."""
    p = vehicle_pairs(matched, highways)
    out = vehicle_stats(p).drop("n_pairs")
    for part in (dominant_hour(p), hour_entropy(p), pct_highway(p), typical_trip(pings), hour_speeds(p)):
        out = out.join(part, "vehicle_id")
    return out.select("vehicle_id", *VEHICLE, *HOURS)


def join_vehicles(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Vehicle features of ``rows(vehicle_id, hour)``, medians of the vehicle table where unknown, and the speed at the row's hour."""
    cols = VEHICLE + HOURS
    medians = features.agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(12.0 if c == "v_hour_dominant" else 0.0)).alias(f"m_{c}") for c in cols])
    j = rows.join(features, "vehicle_id", "left").crossJoin(F.broadcast(medians))  # one row
    filled = [F.coalesce(F.col(c).cast("double"), F.floor(f"m_{c}").cast("double") if c == "v_hour_dominant" else F.col(f"m_{c}")).alias(c) for c in cols]
    j = j.select(*rows.columns, *filled).withColumn("v_hour_dominant", F.col("v_hour_dominant").cast("int"))
    return j.withColumn("v_hour_speed_at_src", F.element_at(F.array(*HOURS), F.col("hour") + 1)).drop(*HOURS)


def fill_weather(weather: DataFrame) -> DataFrame:
    """Missing temperature and wind take the median of the last three hours, then the overall median; missing rain is none."""
    w = Window.orderBy("timestamp_hour").rowsBetween(-2, 0)  # an hourly table of a few years: tens of thousands of rows
    out = weather.withColumn("precip_mm", F.coalesce("precip_mm", F.lit(0.0)))
    for c in ("temp_c", "wind_kph"):
        out = out.withColumn(c, F.coalesce(c, F.percentile(c, 0.5).over(w)))
    m = out.agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in ("temp_c", "wind_kph")])
    out = out.crossJoin(F.broadcast(m))
    return out.select("timestamp_hour", F.coalesce("temp_c", "m_temp_c").alias("temp_c"), "precip_mm", F.coalesce("wind_kph", "m_wind_kph").alias("wind_kph"), F.coalesce("condition", F.lit("0")).alias("condition"))


def join_weather(rows: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of the hour of ``source_time``; medians and condition ``0`` where unknown, 0 where there is no weather at all."""
    m = weather.agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(f"m_{c}") for c in ("temp_c", "precip_mm", "wind_kph")])
    w = weather.withColumnRenamed("timestamp_hour", "_hour")
    j = rows.withColumn("_hour", clock.floor_hour(F.col("source_time"))).join(w, "_hour", "left").crossJoin(F.broadcast(m))
    vals = [F.coalesce(c, f"m_{c}").alias(c) for c in ("temp_c", "precip_mm", "wind_kph")]
    out = j.select(*rows.columns, *vals, F.coalesce("condition", F.lit("0")).alias("condition"))
    return out.withColumn("weather_is_rain", (F.col("precip_mm") > 0.1).cast("int"))


def weather_hit_rate(rows: DataFrame, weather: DataFrame) -> DataFrame:
    w = weather.select(F.col("timestamp_hour").alias("_hour"), F.lit(1).alias("_hit"))
    j = rows.select(clock.floor_hour(F.col("source_time")).alias("_hour")).join(w, "_hour", "left")
    return j.agg(F.count("*").alias("n_rows"), F.avg(F.col("_hit").isNotNull().cast("double")).alias("hit_rate"))


GRAINS = (("hist_duration_min", ["src_cluster", "dst_cluster", "hour"]), ("hist_duration_od", ["src_cluster", "dst_cluster"]), ("hist_duration_hour", ["hour"]))


def hist_medians(train: DataFrame) -> DataFrame:
    """Median durations at all three grains and overall, in one pass; ``grain`` names the columns."""
    g = train.groupingSets([["src_cluster", "dst_cluster", "hour"], ["src_cluster", "dst_cluster"], ["hour"], []], "src_cluster", "dst_cluster", "hour")
    name = F.when(F.grouping_id() == 0, "od_hour").when(F.grouping_id() == 1, "od").when(F.grouping_id() == 6, "hour").otherwise("all")
    return g.agg(name.alias("grain"), F.percentile("duration_min", 0.5).alias("median_min"), F.count("*").alias("n")).select("grain", "src_cluster", "dst_cluster", "hour", "median_min", "n")


def _cascade(df: DataFrame, overall: Column) -> DataFrame:
    a, b, c = (F.col(n) for n, _ in GRAINS)
    return df.withColumn("hist_duration_min", F.coalesce(a, b, c, overall)).withColumn("hist_duration_od", F.coalesce(b, c, overall)).withColumn("hist_duration_hour", F.coalesce(c, overall))


def hist_encode(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Median training durations of each row's origin, destination and hour, with the cascade to coarser grains."""
    out = rows
    for name, keys in GRAINS:
        out = out.join(train.groupBy(*keys).agg(F.percentile("duration_min", 0.5).alias(name)), keys, "left")
    every = train.agg(F.percentile("duration_min", 0.5).alias("_all"))
    return _cascade(out.crossJoin(F.broadcast(every)), F.col("_all")).drop("_all")


def oof_encode(rows: DataFrame, folds: int = 5) -> DataFrame:
    """The same for training rows with ``fold``: medians over the other folds only, so that no row sees its own label."""
    out = rows
    which = F.explode(F.array(*map(F.lit, range(folds)))).alias("_f")
    others = rows.select("src_cluster", "dst_cluster", "hour", "duration_min", F.col("fold").alias("_own"), which).where("_own <> _f").withColumnRenamed("_f", "fold")
    for name, keys in GRAINS:
        out = out.join(others.groupBy("fold", *keys).agg(F.percentile("duration_min", 0.5).alias(name)), ["fold", *keys], "left")
    every = rows.agg(F.percentile("duration_min", 0.5).alias("_all"))
    return _cascade(out.crossJoin(F.broadcast(every)), F.col("_all")).drop("_all")
