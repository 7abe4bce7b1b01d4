"""Time-dependent routing of trips over the network."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FALLBACK_SPEED_MS
from ..functions import clock, geo
from ..sources.files import spill
from . import network, speeds

#: Trips of one half hour are routed in this many tasks.
SALTS = 4


def edge_weights(bins: DataFrame, edges: DataFrame, speed_table: DataFrame) -> DataFrame:
    """``(date, bin, u, v, k, tt, length_m)``: travel times of all simple edges in each of ``bins(date, bin)``."""
    e = network.simple(edges).select("u", "v", "k", "highway", "length_m")
    w = speeds.travel_time(speeds.look_up(e.crossJoin(F.broadcast(bins.distinct())), speed_table))
    return w.select("date", "bin", "u", "v", "k", "tt", "length_m", "highway")


def shortest(trips: DataFrame, weights: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(trip_id, snapshot_s, dist_m, path)`` of ``trips(trip_id, src, dst, date, bin)``.

    ``snapshot_s`` is the fastest time with the speeds of the start's half hour
    and ``path`` its nodes; ``dist_m`` is the length of the shortest route.  All
    are null where there is no route.  Each half hour is solved once for each
    distinct start; edges without travel time are impassable.
    """
    t = trips.select("trip_id", "src", "dst", F.col("date").alias("t_date"), F.col("bin").alias("t_bin"), F.pmod(F.xxhash64("src"), F.lit(salts)).cast("int").alias("t_salt"))
    w = weights.select("date", "bin", "u", "v", "tt", "length_m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        fast, near = network.Network(right, "tt"), network.Network(right[right["tt"] > 0], "length_m")
        for src, g in left.groupby("src"):
            times, pred = fast.from_source(int(src))
            metres, _ = near.from_source(int(src))
            for trip, dst in zip(g["trip_id"], g["dst"], strict=True):
                dst = int(dst)
                if dst not in times:
                    out.append((trip, None, None, None))
                    continue
                path = [dst]
                while path[-1] != src:
                    path.append(pred[path[-1]])
                out.append((trip, times[dst], metres[dst], path[::-1]))
        return pd.DataFrame(out, columns=["trip_id", "snapshot_s", "dist_m", "path"])

    return t.groupBy("t_date", "t_bin", "t_salt").cogroup(w.groupBy("date", "bin", "salt")).applyInPandas(run, "trip_id string, snapshot_s double, dist_m double, path array<bigint>").where("trip_id IS NOT NULL")


def route_edges(routes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(trip_id, step, u, v, k, length_m, highway, bearing)``: the edges along each path."""
    p = routes.where("path IS NOT NULL").select("trip_id", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path")).alias("v"))).alias("step", "e")).select("trip_id", "step", "e.u", "e.v")
    e = network.simple(edges).select("u", "v", "k", "length_m", "highway")
    a, b = nodes.toDF("u", "alat", "alon"), nodes.toDF("v", "blat", "blon")
    return p.where("v IS NOT NULL").join(e, ["u", "v"]).join(a, "u").join(b, "v").select("trip_id", "step", "u", "v", "k", "length_m", "highway", geo.bearing_deg(*map(F.col, ("alat", "alon", "blat", "blon"))).alias("bearing"))


def rolling(route: DataFrame, trips: DataFrame, speed_table: DataFrame) -> DataFrame:
    """``(trip_id, rolling_s, steps)``: each edge costs what it costs in the half hour in which it is entered.

    A fold over the route in generated code: an edge brings its speeds as a map
    by half hour, and the elapsed seconds (truncated) pick the entry.  ``steps``
    holds the seconds spent on each edge.
    """
    exact = speed_table.groupBy("u", "v", "k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "date", F.col("bin").cast("string")), "speed"))).alias("exact"))  # one entry an active half hour
    daily = speeds.time_of_day(speed_table).groupBy("u", "v", "k").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("string"), "tod_speed"))).alias("daily"))
    r = route.join(exact, ["u", "v", "k"], "left").join(daily, ["u", "v", "k"], "left")
    empty = F.create_map().cast("map<string,double>")
    item = F.struct("step", "length_m", network.default_speed(F.col("highway")).alias("free"), F.coalesce("exact", empty).alias("exact"), F.coalesce("daily", empty).alias("daily"))
    walk = r.groupBy("trip_id").agg(F.collect_list(item).alias("walk"))
    walk = walk.withColumn("walk", F.expr("array_sort(walk, (a, b) -> a.step - b.step)")).join(trips.select("trip_id", "source_time"), "trip_id")

    def cost(acc: Column, x: Column) -> Column:
        now = F.col("source_time") + F.floor(acc["s"])
        key = F.concat_ws("/", clock.date_str(now), clock.tod_bin(now).cast("string"))
        seen = F.coalesce(x["exact"][key], x["daily"][clock.tod_bin(now).cast("string")])
        speed = F.when(seen > 0.1, seen).otherwise(x["free"])
        tt = F.when(F.coalesce(x["length_m"], F.lit(0.0)) <= 0, 0.0).otherwise(x["length_m"] / speed)
        return F.struct((acc["s"] + tt).alias("s"), F.concat(acc["tts"], F.array(tt)).alias("tts"))

    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("tts"))
    done = walk.select("trip_id", F.aggregate("walk", start, cost).alias("r"))
    return done.select("trip_id", F.col("r.s").alias("rolling_s"), F.col("r.tts").alias("steps"))


def physics_features(trips: DataFrame, edges: DataFrame, nodes: DataFrame, speed_table: DataFrame) -> DataFrame:
    """The 15 routing features of ``trips(trip_id, source_lat, source_lon, dest_lat, dest_lon, source_time, haversine_km)``.

    Unreachable trips fall back to the straight line at 11.2 m/s, all of it on
    ``other`` roads.
    """
    t = speeds.with_bin(trips, F.col("source_time"))
    t = network.nearest_node(t, nodes, "source_lat", "source_lon").withColumnRenamed("node_id", "src")
    t = network.nearest_node(t, nodes, "dest_lat", "dest_lon").withColumnRenamed("node_id", "dst")
    routes = spill(shortest(t, edge_weights(t.select("date", "bin"), edges, speed_table)))  # read three times below
    route = route_edges(routes, edges, nodes)
    walked = rolling(route, t, speed_table)
    timed = route.join(walked, "trip_id").withColumn("tt", F.element_at("steps", F.col("step") + 1))
    shares = network.route_features(timed, ["trip_id"])
    turns = network.route_turns(route, ["trip_id"]).select("trip_id", F.col("n_turns").alias("route_n_turns"))
    j = t.join(routes.select("trip_id", "snapshot_s", "dist_m"), "trip_id", "left").join(walked.select("trip_id", "rolling_s"), "trip_id", "left").join(shares, "trip_id", "left").join(turns, "trip_id", "left")
    straight = geo.haversine_m(*map(F.col, ("source_lat", "source_lon", "dest_lat", "dest_lon")))
    lost = F.col("snapshot_s").isNull()
    snap = F.coalesce("snapshot_s", straight / FALLBACK_SPEED_MS)
    km = F.coalesce("dist_m", straight) / 1000.0
    live = [F.when(lost, 0.0).otherwise(F.coalesce(c, F.lit(v))).alias(c) for c, v in (("live_src_speed_ms", FALLBACK_SPEED_MS), ("live_bottleneck_speed_ms", FALLBACK_SPEED_MS), ("live_speed_deficit_ratio", 1.0))]
    pct = [F.when(lost, 1.0 if b == "other" else 0.0).otherwise(F.coalesce(f"route_pct_{b}", F.lit(0.0))).alias(f"route_pct_{b}") for b in network.BUCKETS]
    return j.select(
        *trips.columns,
        (F.coalesce("rolling_s", snap) / 60.0).alias("physics_eta_min"),
        (snap / 60.0).alias("physics_eta_snapshot_min"),
        km.alias("route_length_km"),
        F.coalesce("route_n_edges", F.lit(0)).alias("route_n_edges"),
        F.coalesce("route_n_turns", F.lit(0)).alias("route_n_turns"),
        (km / F.greatest("haversine_km", F.lit(0.01))).alias("route_detour_ratio"),
        *pct,
        *live,
    )
