"""Operators on small frames, with their traps."""

import heapq
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadflow.operators import features, matching, network, predict, routing, speeds, trips
from roadflow.sources import adapters, files

PING = "vehicle_id long, seq long, lat double, lon double, flag int, ts long"


def pings(spark, flags, gaps=None, vehicle=1):
    ts = list(itertools.accumulate(gaps or [60] * len(flags)))
    return spark.createDataFrame([(vehicle, k + 1, 37.7 + 0.001 * k, -122.5, f, t) for k, (f, t) in enumerate(zip(flags, ts, strict=True))], PING)


def test_flag_trips_need_four_points_and_close_at_the_end(spark):
    t = trips.segments(pings(spark, [1, 1, 1, 0, 1, 1, 2, 1, 0, 0, 1, 1, 1, 1])).orderBy("first_seq").collect()
    assert [(r.first_seq, r.last_seq, r.n_points) for r in t] == [(5, 8, 4), (11, 14, 4)]


def test_gap_trips_split_after_more_than_300_seconds(spark):
    rows = trips.segments(pings(spark, [0] * 9, [0, 100, 100, 300, 100, 301, 100, 100, 100])).orderBy("first_seq").collect()
    assert [(r.first_seq, r.last_seq) for r in rows] == [(1, 5), (6, 9)]


@pytest.mark.parametrize("seconds, kept", [(59, False), (60, True), (7200, True), (7201, False)])
def test_trip_band(spark, seconds, kept):
    assert (trips.segments(pings(spark, [1] * 4, [0, 1, 1, seconds - 2])).count() == 1) == kept


def test_dedup_fold_looks_at_the_last_kept_point(spark):
    metres = [1, 5, 20, 25, 40]
    p = spark.createDataFrame([(1, k, 37.7 + m / 111194.9, -122.5, 1, k) for k, m in enumerate(metres)], PING)
    assert [metres[r.seq] for r in matching.dedup_fold(p).orderBy("seq").collect()] == [1, 20, 40]


def test_weighted_median_is_duplication(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 1), (5.0, 1), (9.0, 1)], "x double, w int")
    r = df.agg(F.expr("percentile(x, 0.5, w)").alias("a"), F.percentile("x", 0.5).alias("b"), F.percentile("x", 0.2).alias("c"), F.percentile("x", 0.8).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (2.0, 3.5, pytest.approx(1.6), pytest.approx(6.6))


def test_a_dropped_ping_blocks_its_pair(spark):
    m = spark.createDataFrame([(1, 1, 0, 1, 0), (1, 2, None, None, None), (1, 3, 1, 2, 0), (1, 4, 2, 3, 0)], "vehicle_id long, seq long, u long, v long, k int")
    m = m.selectExpr("*", "0.0D AS proj_lat", "0.0D AS proj_lon", "seq * 60 AS ts", "1 AS flag")
    assert [r.seq for r in speeds.matched_pairs(m).collect()] == [3]


def line(spark):
    return spark.createDataFrame([(k, k + 1, 0, "residential", 100.0) for k in range(4)], "u long, v long, k int, highway string, length_m double")


def test_propagation_reaches_one_edge_a_hop_and_keeps_the_value(spark):
    seen = spark.createDataFrame([(0, 1, 0, "2008-06-07", 3, 7.5)], "u long, v long, k int, date string, bin int, speed double")
    for hops in (1, 2, 3):
        out = speeds.propagate(seen, line(spark), hops).collect()
        assert {r.u for r in out} == set(range(hops + 1)) and all(r.speed == pytest.approx(7.5) for r in out)
    full = speeds.default_fill(speeds.propagate(seen, line(spark), 1), line(spark)).collect()
    assert sorted((r.u, r.origin) for r in full) == [(0, "observed"), (1, "propagated"), (2, "default"), (3, "default")]


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 4, rng.integers(1, 5))
        emit = [rng.integers(-3, 1, n).astype(float) for n in sizes]
        trans = [rng.integers(-3, 1, (a, b)).astype(float) for a, b in itertools.pairwise(sizes)]

        def total(p, emit=emit, trans=trans):
            return sum(e[i] for e, i in zip(emit, p, strict=True)) + sum(t[i, j] for t, (i, j) in zip(trans, itertools.pairwise(p), strict=True))

        best = max(total(p) for p in itertools.product(*map(range, sizes)))
        assert total(matching.viterbi(emit, trans)) == best
    assert matching.viterbi([np.zeros(2), np.zeros(2)], [np.zeros((2, 2))]) == [0, 0]


def test_break_at_nine_in_a_billion(spark):
    t = spark.createDataFrame([(1, 1, -1.0), (1, 2, float(np.log(9e-9))), (1, 3, -2.0)], "vehicle_id long, step int, logp double")
    assert [(r.breaks, r.segment_id) for r in matching.path_breaks(t).orderBy("step").collect()] == [(0, 0), (1, 1), (0, 1)]


def test_matcher_finds_the_street_driven_on(spark):
    e = adapters.edges(spark)
    p = spark.createDataFrame([(1, k + 1, 37.7 + 0.00002, -122.5 + 0.0012 * k, 1, 60 * k) for k in range(8)], PING)
    m = matching.match(p, e, sigma=10.0, beta=30.0).orderBy("seq").collect()
    # both directions of the street are equally near; the transition term decides between them
    assert all(r.u < 16 and r.v < 16 and min(r.u, r.v) == int(0.0012 * k / 0.005 + 1e-9) for k, r in enumerate(m)), m


def test_sssp_is_dijkstra(spark):
    e = adapters.edges(spark).drop("geom")
    got = {(r.src, r.dst): r.dist for r in network.sssp(spark.createDataFrame([(0,), (37,), (999,)], "src long"), e).collect()}
    out = {}
    for r in e.collect():
        out.setdefault(r.u, []).append((r.v, r.length_m))
    for s in (0, 37):
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for y, w in out[x]:
                if d + w < dist.get(y, 1e18):
                    dist[y] = d + w
                    heapq.heappush(heap, (d + w, y))
        assert all(got[s, y] == pytest.approx(d) for y, d in dist.items())
    assert not any(s == 999 for s, _ in got)


def test_parallel_edges_keep_the_shortest_and_weightless_ones_are_impassable():
    net = network.Network(pd.DataFrame({"u": [1, 1, 2, 1], "v": [2, 2, 3, 3], "w": [5.0, 3.0, 1.0, 0.0]}), "w")
    assert net.from_source(1)[0] == {1: 0.0, 2: 3.0, 3: 4.0}


def test_unreachable_trips_fall_back_to_the_straight_line(spark):
    nodes = spark.createDataFrame([(0, 37.70, -122.50), (1, 37.71, -122.50), (2, 37.74, -122.50)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 0, "motorway", 1112.0)], "u long, v long, k int, highway string, length_m double")
    none = spark.createDataFrame([], "u long, v long, k int, date string, bin int, speed double")
    t = spark.createDataFrame([("a", 37.70, -122.50, 37.71, -122.50, 1212796800), ("b", 37.70, -122.50, 37.74, -122.50, 1212796800), ("c", 37.70, -122.50, 37.70, -122.50, 1212796800)], "trip_id string, source_lat double, source_lon double, dest_lat double, dest_lon double, source_time long")
    rows = {r.trip_id: r for r in routing.physics_features(t.withColumn("haversine_km", F.lit(1.0)), edges, nodes, none).collect()}
    assert rows["a"].physics_eta_min == pytest.approx(1112.0 / 29.1 / 60) and rows["a"].route_pct_motorway == 1.0
    assert rows["b"].route_pct_other == 1.0 and rows["b"].route_n_edges == 0 and rows["b"].physics_eta_min == pytest.approx(4447.8 / 11.2 / 60, rel=1e-3)
    assert rows["c"].physics_eta_min == 0 and rows["c"].live_src_speed_ms == 11.2


def test_rolling_weather_fill(spark):
    w = spark.createDataFrame([(0, 1.0), (3600, None), (7200, 3.0)], "timestamp_hour long, temp_c double")
    w = w.selectExpr("*", "CAST(NULL AS DOUBLE) AS precip_mm", "temp_c AS wind_kph", "CAST(NULL AS STRING) AS condition")
    out = features.fill_weather(w).orderBy("timestamp_hour").collect()
    assert [r.temp_c for r in out] == [1.0, 1.0, 3.0] and {r.condition for r in out} == {"0"} and {r.precip_mm for r in out} == {0.0}


def test_out_of_fold_values_ignore_the_own_label(spark):
    cols = "id long, src_cluster int, dst_cluster int, hour int, fold int, duration_min double"
    rows = [(k, 0, k % 2, 5, k % 5, float(k)) for k in range(20)]
    a = {r.id: r.hist_duration_min for r in features.oof_encode(spark.createDataFrame(rows, cols)).collect()}
    rows[3] = (*rows[3][:5], 999.0)
    b = {r.id: r.hist_duration_min for r in features.oof_encode(spark.createDataFrame(rows, cols)).collect()}
    assert a[3] == b[3] and a != b


def test_quantile_map_is_monotone_and_averages_ties(spark):
    df = spark.createDataFrame([(k, float(k // 3)) for k in range(30)], "id long, x double")
    t = spark.createDataFrame([(float(k + 1),) for k in range(50)], "y double")
    got = [r.mapped for r in predict.quantile_map(df, "x", t, "y", "id").orderBy("id").collect()]
    assert got == sorted(got) and len(set(got[:3])) == 1


def test_text_scan(spark):
    rows = [("a", 0, "37.7 -122.4 1 200"), ("a", 1, "short line"), ("a", 2, " 37.8   -122.4 0 100 extra"), ("b", 0, "x 1 2 3"), ("b", 1, "1 2 3 4")]
    out = files.parse_lines(spark.createDataFrame(rows, "vehicle_id string, line_no int, value string")).orderBy("seq").collect()
    assert [(r.vehicle_id, r.seq, r.ts) for r in out] == [("a", 1, 100), ("a", 2, 200)]


def test_files(spark, tmp_path):
    (tmp_path / "abc.txt").write_text("37.7 -122.4 1 200\n37.8 -122.4 0 100\n")
    assert [(r.vehicle_id, r.ts) for r in files.read_trajectories(spark, str(tmp_path)).orderBy("seq").collect()] == [("abc", 100), ("abc", 200)]
    (tmp_path / "q.csv").write_text("id,vehicle_id,source_lat,source_lon,dest_lat,dest_lon,source_time\n1,abc.txt,1,2,3,4,6/8/08 21:35\n")
    q = files.read_queries(spark, str(tmp_path / "q.csv")).first()
    assert (q.vehicle_id, q.source_time) == ("abc", 1212960900)


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        """<?xml version='1.0' encoding='utf-8'?><graphml><key id="d1" for="node" attr.name="y" attr.type="string"/><key id="d2" for="node" attr.name="x" attr.type="string"/>
<key id="d3" for="edge" attr.name="highway" attr.type="string"/><key id="d4" for="edge" attr.name="length" attr.type="string"/><key id="d5" for="edge" attr.name="geometry" attr.type="string"/>
<graph edgedefault="directed"><node id="1"><data key="d1">37.7</data><data key="d2">-122.5</data></node><node id="2"><data key="d1">37.8</data><data key="d2">-122.4</data></node>
<edge source="1" target="2" id="0"><data key="d3">['primary', 'trunk']</data><data key="d4">12.5</data><data key="d5">LINESTRING (-122.5 37.7, -122.45 37.7, -122.4 37.8)</data></edge>
<edge source="2" target="1" id="0"><data key="d3"></data><data key="d4">3</data></edge></graph></graphml>"""
    )
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.node_id, r.lat, r.lon) for r in nodes.collect()} == {(1, 37.7, -122.5), (2, 37.8, -122.4)}
    e = {r.u: r for r in edges.collect()}
    assert e[1].highway == "primary" and len(e[1].geom) == 3 and e[1].length_m == 12.5
    assert e[2].highway == "unclassified" and [g.lat for g in e[2].geom] == [37.8, 37.7]


def test_48_features():
    from roadflow.plans.catalog import FEATURES

    assert len(FEATURES) == len(set(FEATURES)) == 48
