"""Prediction: nearest trips, target transforms, guards, blending, calibration and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import KNN_HOURS, KNN_K, KNN_KPH
from ..functions import clock, geo


def knn(queries: DataFrame, history: DataFrame, k: int = KNN_K, hours: int = KNN_HOURS) -> DataFrame:
    """``queries`` with ``knn_min``: the median duration of the vehicle's ``k`` nearest trips within ``hours`` of the day (circular).

    Without any, the straight distance at 12 km/h, at least half a minute; all clipped to 0.5..240.
    ``history(vehicle_id, trip_id, src_lat, src_lon, dst_lat, dst_lon, h_hour, dur_min)``.
    """
    q = queries.join(history, "vehicle_id", "left")
    near = clock.circular_hours(F.col("hour"), F.col("h_hour")) <= hours
    d = geo.haversine_m(*map(F.col, ("src_lat", "src_lon", "source_lat", "source_lon"))) + geo.haversine_m(*map(F.col, ("dst_lat", "dst_lon", "dest_lat", "dest_lon")))
    w = Window.partitionBy("query_id").orderBy("score", "trip_id")
    hits = q.where(near).withColumn("score", d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    est = hits.groupBy("query_id").agg(F.percentile("dur_min", 0.5).alias("_knn"), F.count("*").cast("int").alias("n_neighbours"))
    straight = geo.haversine_m(*map(F.col, ("source_lat", "source_lon", "dest_lat", "dest_lon"))) / 1000.0
    out = queries.join(est, "query_id", "left")
    value = F.coalesce("_knn", F.greatest(F.lit(0.5), straight / KNN_KPH * 60.0))
    return out.select(*queries.columns, F.least(F.lit(240.0), F.greatest(F.lit(0.5), value)).alias("knn_min"), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def target(duration: Column, physics: Column, mode: str) -> Column:
    """The value a model is trained on: ``residual``, ``log`` or ``raw``."""
    if mode == "residual":
        return duration - physics
    if mode == "log":
        return F.log1p(duration)
    if mode == "raw":
        return duration
    raise ValueError(f"unknown target mode {mode!r}")


def invert(value: Column, physics: Column, mode: str) -> Column:
    if mode == "residual":
        return value + physics
    if mode == "log":
        return F.expm1(value)
    if mode == "raw":
        return value
    raise ValueError(f"unknown target mode {mode!r}")


def guard(pred: Column, physics_min: Column, route_km: Column, straight_km: Column) -> Column:
    """Predictions held to possible speeds (0.7 to 40 m/s), pulled to the physics estimate where under a third of it, and clipped to 0.5..240."""
    metres = F.greatest(route_km, straight_km, F.lit(0.05)) * 1000.0
    p = F.least(F.greatest(pred, metres / 40.0 / 60.0), metres / 0.7 / 60.0)
    phys = F.least(F.lit(120.0), F.greatest(F.lit(0.5), physics_min))
    off = (p / phys < 1.0 / 3.0) | F.isnan(p / phys) | (p / phys).isNull()
    p = F.when(off, 0.4 * p + 0.6 * phys).otherwise(p)
    return F.least(F.lit(240.0), F.greatest(F.lit(0.5), p))


def blend(df: DataFrame, columns: Sequence[str], rmse: Sequence[float] | None = None, truth: str | None = None) -> DataFrame:
    """``blend``: the columns' mean weighted by inverse RMSE, given or measured against ``truth``."""
    if rmse is not None:
        w = [F.lit(1.0 / max(r, 1e-9)) for r in rmse]
        return df.withColumn("blend", sum(x * F.col(c) for x, c in zip(w, columns, strict=True)) / sum(w))
    m = df.agg(*[(1.0 / F.greatest(F.lit(1e-9), F.sqrt(F.avg(F.pow(F.col(c) - F.col(truth), F.lit(2.0)))))).alias(f"_w{k}") for k, c in enumerate(columns)])
    j = df.crossJoin(F.broadcast(m))
    w = [F.col(f"_w{k}") for k in range(len(columns))]
    return j.withColumn("blend", sum(x * F.col(c) for x, c in zip(w, columns, strict=True)) / sum(w)).select(*df.columns, "blend")


def rmse_report(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """RMSE of all rows, weekdays and weekends."""
    e = df.select("is_weekend", F.pow(F.col(pred) - F.col(truth), F.lit(2.0)).alias("e"))
    g = e.rollup("is_weekend").agg(F.sqrt(F.avg("e")).alias("rmse"), F.count("*").alias("n"), F.grouping("is_weekend").alias("g"))
    name = F.when(F.col("g") == 1, "all").when(F.col("is_weekend") == 1, "weekend").otherwise("weekday")
    return g.select(name.alias("stratum"), "rmse", "n")


def quantile_map(df: DataFrame, column: str, target_df: DataFrame, target_column: str, order: str, lo: float = 0.5, hi: float = 120.0) -> DataFrame:
    """``mapped``: each value's average-rank quantile looked up in the sorted target.

    Ranks come from counts of distinct values, so that only distinct values, not
    rows, meet in an ordered window.
    """
    c = df.groupBy(column).agg(F.count("*").alias("_c"))
    w = Window.orderBy(column)
    below = F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = df.agg(F.count("*").alias("_n"))
    m = target_df.agg(F.count("*").alias("_m"))
    ranked = c.withColumn("_rank", below + (F.col("_c") + 1) / 2.0).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(m))
    at = F.bround(F.col("_rank") / F.col("_n") * (F.col("_m") - 1)).cast("long")
    ranked = ranked.select(column, F.least(F.col("_m") - 1, F.greatest(F.lit(0), at)).alias("_at"))
    t = target_df.groupBy(target_column).agg(F.count("*").alias("_c"))
    t = t.withColumn("_upto", F.sum("_c").over(Window.orderBy(target_column)))
    t = t.select(F.col(target_column).alias("_value"), F.explode(F.sequence(F.col("_upto") - F.col("_c"), F.col("_upto") - 1)).alias("_at"))
    look = ranked.join(t.select("_at", "_value"), "_at").select(column, F.least(F.lit(hi), F.greatest(F.lit(lo), "_value")).alias("mapped"))
    return df.join(look, column).select(*df.columns, "mapped")


def percentiles(df: DataFrame, column: str) -> DataFrame:
    qs = (5, 10, 25, 50, 75, 90, 95)
    p = F.percentile(column, F.array(*[F.lit(q / 100.0) for q in qs]))
    d = df.agg(p.alias("p"), F.avg(column).alias("mean"), F.max(column).alias("max"), F.count("*").alias("n"))
    return d.select(*[F.col("p")[k].alias(f"p{q}") for k, q in enumerate(qs)], "mean", "max", "n")


def assign_cluster(points: DataFrame, lat: str, lon: str, centroids: Sequence[tuple[float, float]], name: str) -> DataFrame:
    """The index of the nearest of fixed ``centroids`` (degrees); the lowest wins ties."""
    d = [F.struct(((F.col(lat) - a) * (F.col(lat) - a) + (F.col(lon) - b) * (F.col(lon) - b)).alias("d"), F.lit(k).alias("k")) for k, (a, b) in enumerate(centroids)]
    return points.withColumn(name, F.array_min(F.array(*d))["k"])


def fit_centroids(points: DataFrame, lat: str, lon: str, k: int = 80, seed: int = 42) -> list[tuple[float, float]]:
    """K-means centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=[lat, lon], outputCol="_x").transform(points.select(lat, lon))
    return [(float(c[0]), float(c[1])) for c in KMeans(k=k, seed=seed, featuresCol="_x", maxIter=20).fit(x).clusterCenters()]


def fit_model(train: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", rounds: int = 20, seed: int = 42):
    """A boosted or bagged tree ensemble; ``transform`` of the result adds ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    x = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    if kind == "gbt":
        model = GBTRegressor(featuresCol="_x", labelCol=label, maxDepth=5, maxIter=rounds, stepSize=0.1, subsamplingRate=0.85, seed=seed)
    else:
        model = RandomForestRegressor(featuresCol="_x", labelCol=label, maxDepth=8, numTrees=rounds, seed=seed)
    return Pipeline(stages=[x, model]).fit(train)


def stratified(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", min_rows: int = 1000, rounds: int = 20) -> DataFrame:
    """Predictions of weekday and weekend models, or of a single one where a stratum has fewer than ``min_rows``."""
    n = {r[0]: r[1] for r in train.groupBy("is_weekend").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < min_rows:
        return fit_model(train, features, label, kind, rounds).transform(test).drop("_x")
    parts = [fit_model(train.where(F.col("is_weekend") == s), features, label, kind, rounds).transform(test.where(F.col("is_weekend") == s)).drop("_x") for s in (0, 1)]
    return parts[0].unionByName(parts[1])
