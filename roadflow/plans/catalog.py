"""The registered queries: each applies one operator to the adapter views of the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, geo
from ..operators import features, matching, network, predict, routing, speeds, trips
from ..sources import adapters, files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; ``-0.0`` becomes ``0.0``."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _pings(s, d):
    return adapters.pings(adapters.table(s, d, "events"))


def _trips(s, d):
    t = trips.segments(_pings(s, d))
    return t.withColumn("trip_id", F.concat_ws("_", F.col("vehicle_id").cast("string"), F.col("grp").cast("string")))


def _block(name, lat, lon):
    cell = (F.least(F.lit(3), F.greatest(F.lit(0), F.floor((F.col(lat) - 37.7) / 0.02))) * 4 + F.least(F.lit(3), F.greatest(F.lit(0), F.floor((F.col(lon) + 122.5) / 0.02)))).cast("int")
    return cell.alias(name)


def _labelled(s, d):
    t = trips.basic_features(_trips(s, d))
    return t.select("*", _block("src_cluster", "source_lat", "source_lon"), _block("dst_cluster", "dest_lat", "dest_lon"), F.pmod("grp", F.lit(5)).cast("int").alias("fold"))


def _matched(s, d):
    return matching.nearest_match(_pings(s, d), adapters.edges(s))


def _obs(s, d, caps=True):
    return speeds.observations(speeds.matched_pairs(_matched(s, d)), adapters.edges(s) if caps else None)


def _speeds(s, d):
    return speeds.aggregate(_obs(s, d))


def _stored_speeds(s, d):
    """The speed table written once, for plans that read it several times."""
    return files.spill(_speeds(s, d))


def _cands(s, d):
    return matching.candidates(_pings(s, d), adapters.edges(s), 200.0, 200.0)


@query
def pair_speeds(s, d):
    return r6(speeds.pair_speeds(_pings(s, d)).select("vehicle_id", "seq", "dist_m", "dt_s", "speed_ms"), "dist_m", "speed_ms")


@query
def bin_speed(s, d):
    p = speeds.with_bin(speeds.pair_speeds(_pings(s, d)), F.floor((F.col("ts") + F.col("n_ts")) / 2))
    w = F.when((F.col("flag") == 1) & (F.col("n_flag") == 1), 2).otherwise(1)
    g = p.withColumn("weight", w).groupBy("date", "bin").agg(F.expr("percentile(speed_ms, 0.5, weight)").alias("median_speed"), F.sum("weight").cast("long").alias("n_obs"))
    return r6(g, "median_speed")


@query
def geo_scalars(s, d):
    p = speeds.consecutive(_pings(s, d), ["lat", "lon"]).where("n_lat IS NOT NULL")
    c = [F.col(x) for x in ("lat", "lon", "n_lat", "n_lon")]
    p = p.select("vehicle_id", "seq", geo.haversine_m(*c).alias("hav_m"), geo.bearing_deg(*c).alias("bearing"), geo.bearing_delta(geo.bearing_deg(*c), F.lit(350.0)).alias("delta"), geo.manhattan_km(*c).alias("manhattan"))
    return r6(p, "hav_m", "bearing", "delta", "manhattan")


@query
def time_bins(s, d):
    ts = F.col("ts")
    return _pings(s, d).select("vehicle_id", "seq", clock.date_str(ts).alias("date"), clock.tod_bin(ts).alias("bin"), clock.floor_hour(ts).alias("hour_ts"), clock.hour(ts).alias("hour"), clock.day_of_week(ts).alias("dow"))


@query
def parse_query_time(s, d):
    text = F.date_format(F.timestamp_seconds("ts"), "M/d/yy H:mm")
    return _pings(s, d).select("vehicle_id", "seq", clock.parse_query_time(text).alias("parsed_ts"))


@query
def class_bucket(s, d):
    e = adapters.edges(s)
    return r6(e.select("u", "v", "k", "highway", network.bucket(F.col("highway")).alias("bucket"), network.default_speed(F.col("highway")).alias("default_ms"), speeds.cap(F.col("highway")).alias("cap_ms")), "default_ms", "cap_ms")


@query
def ping_prefix(s, d):
    return trips.prefix(_pings(s, d), 50).select("vehicle_id", "seq", "ts", "flag")


@query
def trip_segments(s, d):
    return r6(_trips(s, d).select("vehicle_id", "first_seq", "last_seq", "n_points", "source_time", "source_lat", "source_lon", "dest_lat", "dest_lon", "duration_min"), "source_lat", "source_lon", "dest_lat", "dest_lon", "duration_min")


@query
def gap_trips(s, d):
    return r6(trips.gap_trips(_pings(s, d), gap_s=80).select("vehicle_id", "first_seq", "last_seq", "n_points", "duration_min"), "duration_min")


@query
def prefix_samples(s, d):
    return r6(trips.prefix_samples(_pings(s, d)).select("vehicle_id", "grp", "idx", "source_time", "duration_min"), "duration_min")


@query
def val_pairs(s, d):
    return r6(trips.validation_pairs(_pings(s, d)).select("vehicle_id", "a", "b", "source_time", "duration_min"), "duration_min")


@query
def chrono_split(s, d):
    return trips.chrono_split(_trips(s, d), days=0.5).select("vehicle_id", "grp", "source_time", "is_val")


@query
def basic_features(s, d):
    f = trips.basic_features(_trips(s, d)).select("vehicle_id", "grp", "haversine_km", "manhattan_km", "bearing", "hour", "minute_of_day", "day_of_week", "is_weekend", "hour_sin", "hour_cos")
    return r6(f, "haversine_km", "manhattan_km", "bearing", "hour_sin", "hour_cos")


@query
def target_modes(s, d):
    t = trips.basic_features(_trips(s, d))
    phys = F.col("haversine_km") / 11.2 / 0.06
    x = F.col("duration_min")
    cols = [predict.target(x, phys, m).alias(f"t_{m}") for m in ("residual", "log", "raw")] + [predict.invert(predict.target(x, phys, m), phys, m).alias(f"i_{m}") for m in ("residual", "log", "raw")]
    return r6(t.select("vehicle_id", "grp", *cols), *[f"{a}_{m}" for a in "ti" for m in ("residual", "log", "raw")])


@query
def nearest_node(s, d):
    return network.nearest_node(_pings(s, d).select("vehicle_id", "seq", "lat", "lon"), adapters.nodes(s)).select("vehicle_id", "seq", "node_id")


@query
def edge_adjacency(s, d):
    return network.adjacency(adapters.edges(s))


@query
def simple_edges(s, d):
    e = adapters.edges(s).drop("geom")
    twin = e.where("u % 3 = 0").withColumn("k", F.lit(1)).withColumn("length_m", F.when(F.pmod("u", F.lit(2)) == 0, F.col("length_m") * 0.5))
    return r6(network.simple(e.unionByName(twin)).select("u", "v", "k", "length_m"), "length_m")


@query
def edge_samples(s, d):
    return r6(network.samples(adapters.edges(s)), "lat", "lon", digits=7)


@query
def dedup_fold(s, d):
    p = _pings(s, d)
    return matching.dedup_fold(p, 600.0).select("vehicle_id", "seq", "ts")


@query
def adaptive_radius(s, d):
    return r6(matching.adaptive_radius(matching.dedup_fold(_pings(s, d))).select("vehicle_id", "seq", "step", "radius"), "radius")


@query
def candidates(s, d):
    return r6(_cands(s, d).select("vehicle_id", "seq", "u", "v", "k", "dist_m", "rank"), "dist_m")


@query
def emission(s, d):
    e = matching.emission(_cands(s, d), sigma=50.0).select("vehicle_id", "seq", "step", "u", "v", "k", "logp")
    return r6(e, "logp")


@query
def sssp(s, d):
    e = adapters.edges(s)
    return r6(network.sssp(e.select(F.col("v").alias("src")), e), "dist")


@query
def transitions(s, d):
    e = matching.emission(_cands(s, d))
    t = matching.transitions(e, adapters.edges(s), beta=30.0)
    return r6(t.groupBy("vehicle_id", "step").agg(F.count("*").alias("n"), F.max("logp").alias("best"), F.min("logp").alias("worst")), "best", "worst", digits=5)


@query
def path_breaks(s, d):
    t = matching.transitions(matching.emission(_cands(s, d)), adapters.edges(s), beta=30.0)
    return matching.path_breaks(t).select("vehicle_id", "step", "breaks", "segment_id")


@query
def viterbi(s, d):
    m = matching.match(_pings(s, d), adapters.edges(s), sigma=20.0, beta=30.0)
    return m.select("vehicle_id", "seq", "u", "v", "k", "segment_id")


def _phase_a(s, d, points=C.MAX_POINTS):
    """Speeds as observed through the hidden Markov model: the first ``points`` pings of a vehicle, matched twice at least."""
    m = matching.match(trips.prefix(_pings(s, d), points), adapters.edges(s), sigma=20.0, beta=30.0)
    return speeds.at_least(files.spill(m))


@query
def phase_a(s, d):
    obs = speeds.observations(speeds.matched_pairs(_phase_a(s, d)), adapters.edges(s))
    return r6(speeds.aggregate(obs), "speed")


@query
def phase_b(s, d):
    return r6(speeds.complete(_stored_speeds(s, d), adapters.edges(s)), "speed")


@query
def vehicle_matching(s, d):
    p = features.vehicle_pairs(_phase_a(s, d, C.MAX_POINTS_VEHICLE), adapters.edges(s))
    return r6(features.vehicle_stats(p), "v_mean_speed_ms", "v_median_speed_ms", "v_p20_speed_ms", "v_p80_speed_ms", "v_total_km")


@query
def training_rows(s, d):
    return r6(trips.training_rows(_pings(s, d)).select("vehicle_id", "grp", F.coalesce("idx", F.lit(-1)).alias("idx"), "source_time", "duration_min"), "duration_min")


@query
def seeded_sample(s, d):
    return trips.hashed_sample(_pings(s, d).where("seq = 1").select("vehicle_id", "ts"), "vehicle_id", 20)


@query
def matched_pairs(s, d):
    p = speeds.matched_pairs(_matched(s, d))
    return p.select("vehicle_id", "seq", "u", "v", "k", "n_u", "n_v", "n_k")


@query
def capped_speeds(s, d):
    o = _obs(s, d)
    return o.groupBy("u", "v", "k").agg(F.count("*").alias("n"), F.round(F.max("speed"), 6).alias("top_speed"))


@query
def edge_bin_speed(s, d):
    return r6(_speeds(s, d), "speed")


@query
def edge_bin_speed_nocap(s, d):
    return r6(speeds.aggregate(_obs(s, d, False)), "speed")


@query
def bin_summary(s, d):
    return speeds.bin_summary(_speeds(s, d))


@query
def tod_median(s, d):
    return r6(speeds.time_of_day(_speeds(s, d)), "tod_speed")


@query
def propagate_hop(s, d):
    e = adapters.edges(s)
    return r6(speeds.propagate_hop(_stored_speeds(s, d).withColumn("observed", F.lit(True)), speeds.neighbours(e)), "speed")


@query
def propagate(s, d):
    return r6(speeds.propagate(_speeds(s, d), adapters.edges(s), hops=2), "speed")


@query
def default_fill(s, d):
    e = adapters.edges(s)
    known = _stored_speeds(s, d).select(*speeds.KEY, "speed", F.lit("observed").alias("origin"))
    return r6(speeds.default_fill(known, e), "speed")


@query
def merge_speeds(s, d):
    return r6(speeds.merge(_speeds(s, d), _obs(s, d, False)), "speed")


@query
def speed_lookup(s, d):
    t = _stored_speeds(s, d)
    wanted = t.select("u", "v", "k", F.when(F.pmod("u", F.lit(2)) == 0, F.col("date")).otherwise(F.lit("1999-01-01")).alias("date"), "bin").distinct()
    return r6(speeds.look_up(wanted, t), "speed")


@query
def edge_travel_time(s, d):
    e = adapters.edges(s).select("u", "v", "k", "highway", "length_m")
    t = _speeds(s, d).select("u", "v", "k", "date", "bin", "speed")
    return r6(speeds.travel_time(e.join(t, ["u", "v", "k"], "left")).select("u", "v", "k", F.coalesce("date", F.lit("")).alias("date"), F.coalesce("bin", F.lit(-1)).alias("bin"), "tt"), "tt")


@query
def calibrate(s, d):
    e = adapters.edges(s)
    m = speeds.matched_pairs(_matched(s, d)).select(F.col("v").alias("src"), F.col("n_u").alias("dst"))
    dist = m.join(network.distances(m, e), ["src", "dst"], "left")
    return r6(matching.calibrate(_cands(s, d), dist), "sigma_z", "beta", "sigma_z_raw", "beta_raw", "candidate_median_m", "candidate_p90_m", "pair_median", digits=4)


@query
def coverage_report(s, d):
    return r6(speeds.coverage(_obs(s, d), adapters.edges(s)), "pct_covered", "median_obs_per_key")


def _vpairs(s, d):
    return features.vehicle_pairs(_matched(s, d), adapters.edges(s))


@query
def vehicle_stats(s, d):
    return r6(features.vehicle_stats(_vpairs(s, d)), "v_mean_speed_ms", "v_median_speed_ms", "v_p20_speed_ms", "v_p80_speed_ms", "v_total_km")


@query
def dominant_hour(s, d):
    return features.dominant_hour(_vpairs(s, d))


@query
def hour_entropy(s, d):
    return r6(features.hour_entropy(_vpairs(s, d)), "v_hour_entropy")


@query
def pct_highway(s, d):
    return r6(features.pct_highway(_vpairs(s, d)), "v_pct_highway", digits=9)


@query
def typical_trip(s, d):
    return r6(features.typical_trip(_pings(s, d)), "v_typical_trip_min")


@query
def hour_speed_pivot(s, d):
    return r6(features.hour_speeds(_vpairs(s, d)), *features.HOURS)


@query
def hour_speed_enrich(s, d):
    known = features.vehicle_stats(_vpairs(s, d)).select("vehicle_id", "v_median_speed_ms")
    return r6(features.enrich_hours(known, _pings(s, d)), "v_median_speed_ms", *features.HOURS)


@query
def vehicle_join(s, d):
    f = files.spill(features.vehicle_features(_matched(s, d), _pings(s, d), adapters.edges(s)))
    rows = trips.basic_features(_trips(s, d)).select("vehicle_id", "grp", "hour")
    return r6(features.join_vehicles(rows, f), *[c for c in features.VEHICLE if c != "v_hour_dominant"], "v_hour_speed_at_src")


def _weather(s, d):
    return features.fill_weather(adapters.weather(adapters.table(s, d, "events")))


@query
def weather_fill(s, d):
    return r6(_weather(s, d), "temp_c", "precip_mm", "wind_kph")


@query
def weather_join(s, d):
    rows = _trips(s, d).select("vehicle_id", "grp", "source_time")
    return r6(features.join_weather(rows, _weather(s, d)), "temp_c", "precip_mm", "wind_kph")


@query
def weather_hit_rate(s, d):
    return r6(features.weather_hit_rate(_trips(s, d), adapters.weather(adapters.table(s, d, "events"))), "hit_rate", digits=9)


@query
def hist_medians(s, d):
    m = features.hist_medians(_labelled(s, d))
    return r6(m.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("src_cluster", "dst_cluster", "hour")}), "median_min")


_HIST = ("hist_duration_min", "hist_duration_od", "hist_duration_hour")


@query
def hist_encode(s, d):
    t = _labelled(s, d)
    return r6(features.hist_encode(t.where("fold = 0"), t.where("fold <> 0")).select("vehicle_id", "grp", *_HIST), *_HIST)


@query
def oof_encode(s, d):
    return r6(features.oof_encode(_labelled(s, d)).select("vehicle_id", "grp", *_HIST), *_HIST)


@query
def route_cost(s, d):
    e = adapters.edges(s).withColumn("speed", F.lit(None).cast("double"))
    w = speeds.travel_time(e).select("u", "v", "tt")
    t = _routable(s, d).select("vehicle_id", "grp", "src", "dst")
    cost = network.distances(t, w, weight="tt")
    return r6(t.join(cost, ["src", "dst"], "left").select("vehicle_id", "grp", "src", "dst", F.col("dist").alias("seconds")), "seconds")


def _routable(s, d):
    t = trips.basic_features(_trips(s, d))
    n = adapters.nodes(s)
    t = network.nearest_node(t, n, "source_lat", "source_lon").withColumnRenamed("node_id", "src")
    return network.nearest_node(t, n, "dest_lat", "dest_lon").withColumnRenamed("node_id", "dst")


def _routes(s, d):
    t = speeds.with_bin(_routable(s, d), F.col("source_time"))
    table = _stored_speeds(s, d)
    found = routing.shortest(t, routing.edge_weights(t.select("date", "bin"), adapters.edges(s), table))
    return t, files.spill(found), table


@query
def route_edges(s, d):
    _, r, _ = _routes(s, d)
    return r6(routing.route_edges(r, adapters.edges(s), adapters.nodes(s)), "length_m", "bearing")


@query
def route_turns(s, d):
    _, r, _ = _routes(s, d)
    return network.route_turns(routing.route_edges(r, adapters.edges(s), adapters.nodes(s)), ["trip_id"])


@query
def rolling_eta(s, d):
    t, r, table = _routes(s, d)
    walked = routing.rolling(routing.route_edges(r, adapters.edges(s), adapters.nodes(s)), t, table)
    return r6(r.join(walked, "trip_id").select("trip_id", "snapshot_s", "rolling_s"), "snapshot_s", "rolling_s")


@query
def route_features(s, d):
    return routing.physics_features(trips.basic_features(_trips(s, d)), adapters.edges(s), adapters.nodes(s), _stored_speeds(s, d))


@query
def knn_eta(s, d):
    t = trips.basic_features(_trips(s, d))
    held = F.pmod("grp", F.lit(5)) == 0
    q = t.where(held).select("vehicle_id", F.col("trip_id").alias("query_id"), "source_lat", "source_lon", "dest_lat", "dest_lon", "hour")
    h = t.where(~held).select("vehicle_id", "trip_id", F.col("source_lat").alias("src_lat"), F.col("source_lon").alias("src_lon"), F.col("dest_lat").alias("dst_lat"), F.col("dest_lon").alias("dst_lon"), F.col("hour").alias("h_hour"), F.col("duration_min").alias("dur_min"))
    return r6(predict.knn(q, h).select("query_id", "knn_min", "n_neighbours"), "knn_min")


@query
def quantile_map(s, d):
    o = adapters.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000.0).alias("pred"))
    e = adapters.table(s, d, "events").select("value")
    return r6(predict.quantile_map(o, "pred", e, "value", "o_orderkey").select("o_orderkey", "mapped"), "mapped")


def _preds(s, d):
    t = trips.basic_features(_trips(s, d))
    km = F.col("haversine_km")
    phys = km * 1.3 / 11.2 / 0.06
    return t.select("vehicle_id", "grp", "is_weekend", "hour", "duration_min", km, (km * 1.3).alias("route_km"), phys.alias("physics_min"), (F.col("duration_min") * F.pmod("vehicle_id", F.lit(7)) / 5.0).alias("raw_pred"))


@query
def sanity_guard(s, d):
    p = _preds(s, d)
    g = predict.guard(F.col("raw_pred"), F.col("physics_min"), F.col("route_km"), F.col("haversine_km"))
    return r6(p.select("vehicle_id", "grp", "raw_pred", g.alias("guarded")), "raw_pred", "guarded")


@query
def guard_report(s, d):
    p = _preds(s, d)
    g = predict.guard(F.col("raw_pred"), F.col("physics_min"), F.col("route_km"), F.col("haversine_km"))
    return p.agg(F.count("*").alias("n_rows"), F.sum((F.abs(F.col("raw_pred") - g) > 0.5).cast("int")).cast("long").alias("n_adjusted"))


@query
def ensemble_blend(s, d):
    return r6(predict.blend(_preds(s, d), ["raw_pred", "physics_min"], truth="duration_min").select("vehicle_id", "grp", "blend"), "blend")


@query
def rmse_report(s, d):
    return r6(predict.rmse_report(_preds(s, d), "physics_min", "duration_min"), "rmse")


@query
def duration_percentiles(s, d):
    return r6(predict.percentiles(_trips(s, d), "duration_min"), *[f"p{q}" for q in (5, 10, 25, 50, 75, 90, 95)], "mean", "max")


CENTROIDS = [(37.71 + 0.02 * i, -122.49 + 0.02 * j) for i in range(4) for j in range(4)]


@query
def assign_cluster(s, d):
    t = predict.assign_cluster(_trips(s, d), "source_lat", "source_lon", CENTROIDS, "src_cluster")
    t = predict.assign_cluster(t, "dest_lat", "dest_lon", CENTROIDS, "dst_cluster")
    return t.select("vehicle_id", "grp", "src_cluster", "dst_cluster", F.concat_ws("_", F.col("src_cluster").cast("string"), F.col("dst_cluster").cast("string")).alias("od_pair"))


def _features(s, d):
    t = trips.basic_features(_trips(s, d))
    t = predict.assign_cluster(predict.assign_cluster(t, "source_lat", "source_lon", CENTROIDS, "src_cluster"), "dest_lat", "dest_lon", CENTROIDS, "dst_cluster")
    t = t.withColumn("od_pair", F.concat_ws("_", F.col("src_cluster").cast("string"), F.col("dst_cluster").cast("string"))).withColumn("fold", F.pmod("grp", F.lit(5)).cast("int"))
    t = routing.physics_features(t, adapters.edges(s), adapters.nodes(s), _stored_speeds(s, d))
    t = features.oof_encode(files.spill(t))
    t = features.join_vehicles(t, features.vehicle_features(_matched(s, d), _pings(s, d), adapters.edges(s)))
    return features.join_weather(t, _weather(s, d))


#: The model's features, in order.
FEATURES = (
    ["haversine_km", "manhattan_km", "bearing", "hour", "minute_of_day", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "src_cluster", "dst_cluster", "od_pair"]
    + ["physics_eta_min", "physics_eta_snapshot_min", "route_length_km", "route_n_edges", "route_n_turns", "route_detour_ratio"]
    + [f"route_pct_{b}" for b in C.BUCKETS]
    + ["live_src_speed_ms", "live_bottleneck_speed_ms", "live_speed_deficit_ratio", *_HIST, "vehicle_id", *features.VEHICLE, "v_hour_speed_at_src"]
    + ["temp_c", "precip_mm", "wind_kph", "weather_is_rain", "condition"]
)


@query
def feature_matrix(s, d):
    return _features(s, d).select("trip_id", *FEATURES, "duration_min")


@query
def eta_predict(s, d):
    f = _features(s, d)
    numeric = [c for c in FEATURES if c not in ("od_pair", "vehicle_id", "condition")]
    f = f.withColumn("label", predict.target(F.col("duration_min"), F.col("physics_eta_min"), "residual"))
    path = files.spill(f.select("trip_id", "fold", "duration_min", "label", *numeric))
    train, test = path.where("fold <> 0"), path.where("fold = 0")
    a = predict.stratified(train, test, numeric, "label", "gbt").withColumn("gbt", predict.invert(F.col("prediction"), F.col("physics_eta_min"), "residual")).drop("prediction")
    b = predict.fit_model(train, numeric, "label", "forest").transform(a).withColumn("forest", predict.invert(F.col("prediction"), F.col("physics_eta_min"), "residual"))
    out = predict.blend(b, ["gbt", "forest"], truth="duration_min")
    return out.select("trip_id", "duration_min", predict.guard(F.col("blend"), F.col("physics_eta_min"), F.col("route_length_km"), F.col("haversine_km")).alias("predicted_min"))


def _lines(s, d, first, last):
    p = _pings(s, d).where(F.col("vehicle_id").between(first, last))
    bad = F.when(F.pmod("seq", F.lit(17)) == 0, F.concat_ws(" ", F.col("lat").cast("string"), F.col("flag").cast("string"))).otherwise(F.concat_ws("  ", *[F.col(c).cast("string") for c in ("lat", "lon", "flag", "ts")], F.lit("extra")))
    value = F.when((F.pmod("vehicle_id", F.lit(9)) == 0) & (F.col("seq") == 5), F.lit("x 1 2 3")).otherwise(bad)
    return p.select(F.concat(F.lit("v"), F.col("vehicle_id").cast("string")).alias("vehicle_id"), F.col("seq").cast("int").alias("line_no"), value.alias("value"))


@query
def ping_scan(s, d):
    return r6(files.parse_lines(_lines(s, d, 0, 10**9)), "lat", "lon")


@query
def ping_union(s, d):
    a, b = files.parse_lines(_lines(s, d, 0, 60)), files.parse_lines(_lines(s, d, 61, 10**9))
    return r6(files.union_pings([a, b]), "lat", "lon")
