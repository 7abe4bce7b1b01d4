"""Hidden-Markov map matching: dedup, candidates, lattice, decoding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BEARING_MIN_M, BEARING_SIGMA_DEG, BETA, DEDUP_M, EARTH_RADIUS_M, PATH_BREAK, RADIUS_MAX_M, RADIUS_MIN_M, RADIUS_SCALE, SIGMA_Z, TINY
from ..functions import geo
from ..sources.files import spill
from . import network

LOG_TINY = math.log(TINY)


def _kept(lat: np.ndarray, lon: np.ndarray, threshold: float) -> np.ndarray:
    """Fold over one trajectory: a point is kept when it is further than ``threshold`` metres from the last kept one."""
    out = np.zeros(len(lat), bool)
    la, lo = np.radians(lat), np.radians(lon)
    last = -1
    for i in range(len(lat)):
        if last >= 0:
            a = math.sin((la[i] - la[last]) / 2) ** 2 + math.cos(la[last]) * math.cos(la[i]) * math.sin((lo[i] - lo[last]) / 2) ** 2
            if 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a))) <= threshold:
                continue
        out[i] = True
        last = i
    return out


def dedup_fold(pings: DataFrame, threshold: float = DEDUP_M) -> DataFrame:
    """Pings that moved on from the last kept one; each depends on the fold's state, so a trajectory is folded in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        return pdf[_kept(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), threshold)]

    p = pings.select("vehicle_id", "seq", "lat", "lon", "flag", "ts")
    return p.groupBy("vehicle_id").applyInPandas(run, p.schema)


def adaptive_radius(kept: DataFrame, sigma: float = SIGMA_Z) -> DataFrame:
    """Adds ``radius``: wider after a longer silence since the previous kept ping, and ``step`` from 0."""
    w = Window.partitionBy("vehicle_id").orderBy("ts", "seq")
    dt = F.abs(F.col("ts") - F.lag("ts").over(w))
    r = F.least(F.lit(RADIUS_MAX_M), F.greatest(F.lit(RADIUS_MIN_M), 2 * sigma + RADIUS_SCALE * F.greatest(F.lit(1).cast("long"), dt)))
    return kept.withColumn("radius", F.when(dt.isNull(), RADIUS_MIN_M).otherwise(r)).withColumn("step", (F.row_number().over(w) - 1).cast("int"))


def _pieces(edges: DataFrame, pad: float, cell: float) -> DataFrame:
    """Straight pieces of the segments with plain columns, one row for each grid cell that a piece's padded box touches."""
    n = F.size("geom") - 1
    lead = [geo.bearing_deg(F.col("geom")[0]["lat"], F.col("geom")[0]["lon"], F.element_at("geom", -1)["lat"], F.element_at("geom", -1)["lon"]).alias("along")]
    p = edges.select("u", "v", "k", *lead, F.posexplode(F.arrays_zip(F.slice("geom", 1, n).alias("a"), F.slice("geom", 2, n).alias("b"))).alias("piece", "ab"))
    p = p.select("u", "v", "k", "along", "piece", *[F.col(f"ab.{e}.{x}").alias(f"{e}{x}") for e in "ab" for x in ("lat", "lon")])
    box = [(f(f"a{x}", f"b{x}") + sign * pad).alias(n) for n, f, x, sign in (("_s", F.least, "lat", -1), ("_n", F.greatest, "lat", 1), ("_w", F.least, "lon", -1), ("_e", F.greatest, "lon", 1))]
    span = [F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)) for lo, hi in (("_w", "_e"), ("_s", "_n"))]
    return p.select("*", *box).withColumn("cx", F.explode(span[0])).withColumn("cy", F.explode(span[1]))


def candidates(pings: DataFrame, edges: DataFrame, radius: Column | float = RADIUS_MIN_M, max_radius: float = RADIUS_MAX_M) -> DataFrame:
    """Segments whose projection is within ``radius`` of each ping.

    A range join as an equality join: each straight piece of a segment is listed
    in every grid cell its padded box touches (cells are as wide as the padding),
    so a ping meets a piece once, in its own cell.  Of a segment's pieces the one
    nearest in degrees counts; the padding is wide enough that it is among those
    met.  The pairs are dealt by ping once, for the choice of the piece and for
    the ranks alike.  Adds ``u, v, k, along, proj_lat, proj_lon, dist_m, rank``
    (by distance, then key); ``along`` is the bearing from a segment's start to its end.
    """
    pad = max_radius / 111_000.0 / 0.7  # up to 45 degrees of latitude
    p = pings.withColumn("cx", F.floor(F.col("lon") / pad)).withColumn("cy", F.floor(F.col("lat") / pad))
    j = p.join(_pieces(edges, pad, pad), ["cx", "cy"]).where("lat BETWEEN _s AND _n AND lon BETWEEN _w AND _e")
    dx, dy = F.col("blon") - F.col("alon"), F.col("blat") - F.col("alat")
    d2 = dx * dx + dy * dy
    t = F.when(d2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("lon") - F.col("alon")) * dx + (F.col("lat") - F.col("alat")) * dy) / d2))).otherwise(F.lit(0.0))
    j = j.select(*pings.columns, "u", "v", "k", "along", "piece", (F.col("alon") + t * dx).alias("x"), (F.col("alat") + t * dy).alias("y"))
    off = (F.col("lon") - F.col("x")) * (F.col("lon") - F.col("x")) + (F.col("lat") - F.col("y")) * (F.col("lat") - F.col("y"))
    best = F.min(F.struct(off.alias("d2"), "piece", F.col("y").alias("lat"), F.col("x").alias("lon"))).alias("p")
    kept = [c for c in pings.columns if c not in ("vehicle_id", "seq")]
    j = j.repartition("vehicle_id", "seq").groupBy("vehicle_id", "seq", "u", "v", "k").agg(best, F.first("along").alias("along"), *[F.first(c).alias(c) for c in kept])
    j = j.withColumn("dist_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")))
    r = F.lit(float(radius)) if isinstance(radius, int | float) else radius
    j = j.where(F.col("dist_m") <= r).withColumn("proj_lat", F.col("p.lat")).withColumn("proj_lon", F.col("p.lon"))
    w = Window.partitionBy("vehicle_id", "seq").orderBy("dist_m", "u", "v", "k")
    return j.withColumn("rank", F.row_number().over(w)).drop("p")


def nearest_match(pings: DataFrame, edges: DataFrame, radius: float = RADIUS_MIN_M) -> DataFrame:
    """Every raw ping with its nearest segment (null where none is in reach): the matcher without the hidden Markov model."""
    best = candidates(pings, edges, radius, radius).where("rank = 1").select("vehicle_id", "seq", "u", "v", "k", "proj_lat", "proj_lon")
    return pings.join(best, ["vehicle_id", "seq"], "left")


def log_emission(dist: Column, sigma: float = SIGMA_Z) -> Column:
    """Logarithm of the normal density of a distance."""
    return -0.5 * (dist / sigma) * (dist / sigma) - math.log(sigma * math.sqrt(2 * math.pi))


def log_bearing(delta: Column) -> Column:
    return -(delta * delta) / (2 * BEARING_SIGMA_DEG**2)


def log_transition(dist: Column, beta: float = BETA) -> Column:
    """Logarithm of the exponential density of a route distance."""
    return -dist / beta - math.log(beta)


def emission(cands: DataFrame, sigma: float = SIGMA_Z, use_bearing: bool = True) -> DataFrame:
    """``(vehicle_id, seq, step, rank, logp)`` of candidates, floored; ``step`` counts pings that have candidates.

    The heading factor compares a straight segment's bearing with that from the
    previous ping with candidates, where that is at least 5 m away.
    """
    steps = cands.select("vehicle_id", "seq", "ts", "lat", "lon").distinct()
    w = Window.partitionBy("vehicle_id").orderBy("ts", "seq")
    prev = [F.lag(c).over(w) for c in ("lat", "lon")]
    far = geo.haversine_m(*prev, F.col("lat"), F.col("lon")) >= BEARING_MIN_M
    steps = steps.select("vehicle_id", "seq", (F.row_number().over(w) - 1).cast("int").alias("step"), F.when(far, geo.bearing_deg(*prev, F.col("lat"), F.col("lon"))).alias("heading"))
    e = cands.drop("step").join(steps, ["vehicle_id", "seq"])
    logp = log_emission(F.col("dist_m"), sigma)
    if use_bearing:
        logp = logp + F.coalesce(log_bearing(geo.bearing_delta(F.col("heading"), F.col("along"))), F.lit(0.0))
    return e.withColumn("logp", F.greatest(logp, F.lit(LOG_TINY)))


def transitions(emitted: DataFrame, edges: DataFrame, beta: float = BETA) -> DataFrame:
    """``(vehicle_id, step, i, j, dist, logp)`` between the candidates of neighbouring steps.

    ``dist`` is the route distance from candidate i's far end to candidate j's
    near end, null where there is no route; each distinct source is solved once,
    as far as a transition can score above the floor.
    """
    e = emitted.select("vehicle_id", "step", "rank", "u", "v")
    a = e.select("vehicle_id", (F.col("step") + 1).alias("step"), F.col("rank").alias("i"), F.col("v").alias("src"))
    b = e.select("vehicle_id", "step", F.col("rank").alias("j"), F.col("u").alias("dst"))
    pairs = a.join(b, ["vehicle_id", "step"])
    cutoff = beta * (-LOG_TINY - math.log(beta)) + 1.0
    dist = network.distances(pairs.select("src", "dst"), edges, cutoff=max(cutoff, 0.0))
    t = pairs.join(dist, ["src", "dst"], "left")
    return t.select("vehicle_id", "step", "i", "j", "dist", F.greatest(F.coalesce(log_transition(F.col("dist"), beta), F.lit(LOG_TINY)), F.lit(LOG_TINY)).alias("logp"))


def path_breaks(trans: DataFrame, threshold: float = PATH_BREAK) -> DataFrame:
    """``(vehicle_id, step, breaks, segment_id)``: a step starts a new segment where no transition into it reaches ``threshold``."""
    best = trans.groupBy("vehicle_id", "step").agg(F.max("logp").alias("best"))
    w = Window.partitionBy("vehicle_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    breaks = (F.col("best") < math.log(threshold)).cast("int")
    return best.withColumn("breaks", breaks).withColumn("segment_id", F.sum("breaks").over(w).cast("int"))


def viterbi(emit: list[np.ndarray], trans: list[np.ndarray]) -> list[int]:
    """The best path through a lattice of log scores; the lowest index wins ties."""
    score, back = np.asarray(emit[0], float), []
    for e, t in zip(emit[1:], trans, strict=True):
        total = score[:, None] + t
        k = total.argmax(axis=0)
        back.append(k)
        score = total[k, np.arange(len(e))] + e
    path = [int(score.argmax())]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    return path[::-1]


def decode(emitted: DataFrame, trans: DataFrame, breaks: DataFrame) -> DataFrame:
    """``(vehicle_id, seq, segment_id, rank)``: the chosen candidate of each step, decoded segment by segment."""
    lattice = emitted.select("vehicle_id", "seq", "step", "rank", "logp").join(breaks.select("vehicle_id", "step", "segment_id"), ["vehicle_id", "step"], "left")
    lattice = lattice.withColumn("segment_id", F.coalesce("segment_id", F.lit(0)))
    left = lattice.select("vehicle_id", "segment_id", "seq", "step", F.col("rank").alias("j"), F.lit(None).cast("int").alias("i"), "logp")
    right = trans.join(breaks.select("vehicle_id", "step", "segment_id", "breaks"), ["vehicle_id", "step"]).where("breaks = 0")
    right = right.select("vehicle_id", "segment_id", F.lit(None).cast("long").alias("seq"), "step", "j", "i", "logp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e, t = pdf[pdf["i"].isna()], pdf[pdf["i"].notna()]
        steps = np.sort(e["step"].unique())
        by_step = {s: g.sort_values("j") for s, g in e.groupby("step")}
        pairs = dict(tuple(t.groupby("step")))
        emit = [by_step[s]["logp"].to_numpy() for s in steps]
        moves = []
        for a, b in zip(steps, steps[1:], strict=False):
            m = np.full((len(by_step[a]), len(by_step[b])), LOG_TINY)
            p = pairs.get(b)
            if p is not None:
                m[p["i"].to_numpy(int) - 1, p["j"].to_numpy(int) - 1] = p["logp"].to_numpy()
            moves.append(m)
        path = viterbi(emit, moves)
        first = [by_step[s].iloc[0] for s in steps]
        return pd.DataFrame({"vehicle_id": pdf["vehicle_id"].iloc[0], "seq": [int(f["seq"]) for f in first], "segment_id": pdf["segment_id"].iloc[0], "rank": [p + 1 for p in path]})

    return left.unionByName(right).groupBy("vehicle_id", "segment_id").applyInPandas(run, "vehicle_id long, seq long, segment_id int, rank int")


def match(pings: DataFrame, edges: DataFrame, sigma: float = SIGMA_Z, beta: float = BETA, dedup_m: float = DEDUP_M, use_bearing: bool = True, detect_breaks: bool = True) -> DataFrame:
    """Map matching aligned to the raw pings: ``u, v, k, proj_lat, proj_lon, segment_id``, null for dropped pings.

    Vehicles with fewer than two pings or two steps are unmatched.
    """
    n = F.count("*").over(Window.partitionBy("vehicle_id"))
    kept = adaptive_radius(dedup_fold(pings.withColumn("_n", n).where("_n >= 2").drop("_n"), dedup_m), sigma)
    cands = candidates(kept, edges, F.col("radius"))
    e = emission(cands, sigma, use_bearing)
    two = F.max("step").over(Window.partitionBy("vehicle_id")) >= 1
    e = spill(e.withColumn("_two", two).where("_two").drop("_two"))  # read four times below
    t = spill(transitions(e, edges, beta))
    breaks = path_breaks(t, PATH_BREAK if detect_breaks else 0.5 * TINY)
    chosen = decode(e, t, breaks)
    best = e.join(chosen, ["vehicle_id", "seq", "rank"]).select("vehicle_id", "seq", "u", "v", "k", "proj_lat", "proj_lon", "segment_id")
    return pings.join(best, ["vehicle_id", "seq"], "left")


def calibrate(cands: DataFrame, dists: DataFrame) -> DataFrame:
    """One row of parameters from the nearest-candidate distances and finite route distances ``dists(dist)``."""
    s = cands.where("rank = 1").agg(F.percentile("dist_m", 0.5).alias("med"), F.percentile("dist_m", 0.9).alias("p90"), F.count("*").alias("n_samples_candidates"))
    b = dists.where("dist IS NOT NULL").agg(F.avg("dist").alias("beta_raw"), F.percentile("dist", 0.5).alias("pair_median"), F.count("*").alias("n_samples_pairs"))
    c = s.crossJoin(b).withColumn("sigma_z_raw", F.col("med") / 0.6745)
    return c.select(
        F.least(F.lit(40.0), F.greatest(F.lit(3.0), "sigma_z_raw")).alias("sigma_z"),
        F.least(F.lit(30.0), F.greatest(F.lit(1.0), "beta_raw")).alias("beta"),
        "sigma_z_raw",
        "beta_raw",
        F.col("med").alias("candidate_median_m"),
        F.col("p90").alias("candidate_p90_m"),
        "pair_median",
        "n_samples_candidates",
        "n_samples_pairs",
    )
