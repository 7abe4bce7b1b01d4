"""Road-network relations and shortest paths."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BUCKETS, CLASS_BUCKET, DEFAULT_SPEED_MS, FALLBACK_SPEED_MS, TURN_DEG
from ..functions import geo

#: Edges that routing broadcasts, at most: a network beyond it must be cut into regions first.
MAX_NETWORK_EDGES = 5_000_000
CELL_DEG = 0.01


def lookup(table: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def default_speed(highway: Column) -> Column:
    return lookup(DEFAULT_SPEED_MS, F.coalesce(highway, F.lit("unclassified")), FALLBACK_SPEED_MS)


def bucket(highway: Column) -> Column:
    return lookup(CLASS_BUCKET, F.coalesce(highway, F.lit("unclassified")), "other")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(u, v, k, nu, nv, nk)``: edges that share an end with another one."""
    e = edges.select("u", "v", "k")
    ends = e.select("u", "v", "k", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    other = ends.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("k").alias("nk"), "node")
    met = ends.join(other, "node").where("NOT (u = nu AND v = nv AND k = nk)")
    return met.select("u", "v", "k", "nu", "nv", "nk").distinct()


def simple(edges: DataFrame) -> DataFrame:
    """The shortest of parallel edges; a missing length counts as 1e9, the lowest key wins ties."""
    w = Window.partitionBy("u", "v").orderBy(F.coalesce("length_m", F.lit(1e9)), "k")
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def samples(edges: DataFrame, step_deg: float = 0.0005) -> DataFrame:
    """Equally spaced points of straight edges, ends included: ``max(2, int(length / step) + 1)`` of them."""
    a, b = F.col("geom")[0], F.element_at("geom", -1)
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    n = F.greatest(F.lit(2), (F.sqrt(dx * dx + dy * dy) / step_deg).cast("int") + 1)
    e = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    return e.select("u", "v", "k", "i", (a["lat"] + dy * t).alias("lat"), (a["lon"] + dx * t).alias("lon"))


def nearest_node(points: DataFrame, nodes: DataFrame, lat: str = "lat", lon: str = "lon", cell: float = CELL_DEG, rings: int = 1) -> DataFrame:
    """``points`` with ``node_id``, the nearest in degrees.

    An equality join on grid cells of ``cell`` degrees looks ``rings`` around the
    point; points further than that from any node (outside the network) are
    settled against all nodes.
    """
    px, py = F.floor(F.col(lon) / cell), F.floor(F.col(lat) / cell)
    keyed = points.withColumn("_id", F.struct(*points.columns))
    places = points.select(lat, lon).distinct()
    around = F.array(*[F.struct((px + dx).alias("cx"), (py + dy).alias("cy")) for dx in range(-rings, rings + 1) for dy in range(-rings, rings + 1)])
    near = places.select(lat, lon, F.explode(around).alias("c")).select(lat, lon, "c.*")
    grid = nodes.select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    d2 = (F.col(lat) - F.col("nlat")) * (F.col(lat) - F.col("nlat")) + (F.col(lon) - F.col("nlon")) * (F.col(lon) - F.col("nlon"))
    best = F.min(F.struct(d2.alias("d2"), F.col("node_id")))
    found = near.join(grid, ["cx", "cy"]).groupBy(lat, lon).agg(best.alias("b")).where(F.sqrt("b.d2") <= cell * rings)
    far = places.join(found, [lat, lon], "left_anti").join(nodes.select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon")), F.lit(True)).groupBy(lat, lon).agg(best.alias("b"))
    place = found.unionByName(far).select(lat, lon, F.col("b.node_id").alias("node_id"))
    return keyed.drop("_id").join(place, [lat, lon], "left")


class Network:
    """A compact adjacency for shortest paths inside tasks."""

    def __init__(self, edges: pd.DataFrame, weight: str):
        e = edges[edges[weight] > 0].sort_values(["u", "v", weight]).drop_duplicates(["u", "v"])
        self.ids = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()])) if len(e) else np.empty(0, np.int64)
        self.index = {int(n): i for i, n in enumerate(self.ids)}
        self.out: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for u, v, w in zip(e["u"], e["v"], e[weight], strict=True):
            self.out[self.index[int(u)]].append((self.index[int(v)], float(w)))

    def from_source(self, source: int, cutoff: float = float("inf"), targets=None) -> tuple[dict[int, float], dict[int, int]]:
        """Distances and predecessors by node id; the lower predecessor id wins ties; empty for an unknown source.

        With ``targets`` the search ends when all of them are settled.
        """
        if source not in self.index:
            return {}, {}
        s = self.index[source]
        dist, pred, done = {s: 0.0}, {}, set()
        wanted = None if targets is None else {self.index[t] for t in targets if t in self.index}
        heap = [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if wanted is not None:
                wanted.discard(x)
                if not wanted:
                    break
            for y, w in self.out[x]:
                nd = d + w
                if nd <= cutoff and (y not in dist or nd < dist[y] or (nd == dist[y] and y not in done and x < pred.get(y, -1))):
                    dist[y], pred[y] = nd, x
                    heapq.heappush(heap, (nd, y))
        ids = self.ids
        return {int(ids[k]): d for k, d in dist.items()}, {int(ids[k]): int(ids[p]) for k, p in pred.items()}


def shared_edges(edges: DataFrame, *columns: str):
    """The network for tasks, broadcast after a check of its size."""
    n = edges.count()
    if n > MAX_NETWORK_EDGES:
        raise ValueError(f"{n} edges: cut the network into regions of at most {MAX_NETWORK_EDGES} before routing")
    return edges.sparkSession.sparkContext.broadcast(edges.select(*columns).toPandas())


def sssp(sources: DataFrame, edges: DataFrame, weight: str = "length_m", cutoff: float = float("inf")) -> DataFrame:
    """``(src, dst, dist)`` from each distinct ``sources(src)`` to all nodes within ``cutoff``; unknown sources reach nothing."""
    shared = shared_edges(edges, "u", "v", weight)

    def run(parts):
        net = Network(shared.value, weight)
        for pdf in parts:
            for s in pdf["src"]:
                d, _ = net.from_source(int(s), cutoff)
                if d:
                    yield pd.DataFrame({"src": np.int64(s), "dst": np.fromiter(d.keys(), np.int64), "dist": np.fromiter(d.values(), float)})

    return sources.select("src").distinct().mapInPandas(run, "src long, dst long, dist double")


def distances(pairs: DataFrame, edges: DataFrame, weight: str = "length_m", cutoff: float = float("inf")) -> DataFrame:
    """``(src, dst, dist)`` of the distinct ``pairs(src, dst)`` within ``cutoff`` of each other.

    Each source is solved once and only until all its destinations are settled.
    """
    shared = shared_edges(edges, "u", "v", weight)

    def run(parts):
        net = Network(shared.value, weight)
        for pdf in parts:
            for s, ts in zip(pdf["src"], pdf["dsts"], strict=True):
                d, _ = net.from_source(int(s), cutoff, set(map(int, ts)))
                found = [(int(t), d[int(t)]) for t in ts if int(t) in d]
                if found:
                    yield pd.DataFrame({"src": np.int64(s), "dst": np.array([t for t, _ in found], np.int64), "dist": [x for _, x in found]})

    wanted = pairs.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.collect_set("dst").alias("dsts"))  # bounded by the nodes
    return wanted.mapInPandas(run, "src long, dst long, dist double")


def route_turns(route: DataFrame, keys: list[str]) -> DataFrame:
    """Turns over 30 degrees between consecutive edges of ``route(keys, step, bearing)``."""
    w = Window.partitionBy(*keys).orderBy("step")
    turn = (geo.bearing_delta(F.col("bearing"), F.lag("bearing").over(w)) > TURN_DEG).cast("int")
    return route.withColumn("_t", F.coalesce(turn, F.lit(0))).groupBy(*keys).agg(F.sum("_t").cast("int").alias("n_turns"), F.count("*").cast("int").alias("n_edges"))


def route_features(route: DataFrame, keys: list[str]) -> DataFrame:
    """Class shares and live-speed features of ``route(keys, step, highway, length_m, tt)``."""
    speed = F.when((F.col("length_m") > 0) & (F.col("tt") > 0), F.col("length_m") / F.col("tt"))
    r = route.withColumn("speed", speed).withColumn("free", F.when(F.col("speed").isNotNull(), default_speed(F.col("highway")))).withColumn("b", bucket(F.col("highway")))
    w = Window.partitionBy(*keys).orderBy(F.col("speed").isNull(), "step")
    r = r.withColumn("nth", F.row_number().over(w))
    n = F.count("*")
    share = [(F.sum((F.col("b") == x).cast("double")) / n).alias(f"route_pct_{x}") for x in BUCKETS]
    first = F.percentile(F.when(F.col("nth") <= 3, F.col("speed")), 0.5)
    return r.groupBy(*keys).agg(
        n.cast("int").alias("route_n_edges"),
        *share,
        F.coalesce(first, F.lit(FALLBACK_SPEED_MS)).alias("live_src_speed_ms"),
        F.coalesce(F.min("speed"), F.lit(FALLBACK_SPEED_MS)).alias("live_bottleneck_speed_ms"),
        F.coalesce(F.sum("speed") / F.sum("free"), F.lit(1.0)).alias("live_speed_deficit_ratio"),
    )
