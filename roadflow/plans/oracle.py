"""DuckDB twins of the registered queries.

``_CTES`` holds shared views; a query names the ones it needs and ``_sql`` puts
them, with what they build on, before it.
"""

from __future__ import annotations

from .. import constants as C

_HAV = "(12742000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))"
_BEAR = "(((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return _HAV.format(a=a, b=b, c=c, d=d)


def bear(a: str, b: str, c: str, d: str) -> str:
    return _BEAR.format(a=a, b=b, c=c, d=d)


def _case(column: str, table: dict, default) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"

    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def default_ms(column: str) -> str:
    return _case(column, C.DEFAULT_SPEED_MS, C.FALLBACK_SPEED_MS)


def cap_ms(column: str) -> str:
    return _case(column, C.SPEED_CAP_MS, C.DEFAULT_CAP_MS)


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0::DOUBLE"


_DATE = "strftime(make_timestamp(({0}) * 1000000), '%Y-%m-%d')"
_BIN = "((({0}) % 86400) // 1800)::INT"
_HOUR = "((({0}) % 86400) // 3600)::INT"
_CENTROIDS = [(37.71 + 0.02 * i, -122.49 + 0.02 * j) for i in range(4) for j in range(4)]

_CTES = {
    "ev": "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
    "pings": """SELECT user_id AS vehicle_id, rn AS seq,
  37.70::DOUBLE + 0.005::DOUBLE * ((user_id * 5 + rn // 16) % 16)::DOUBLE + ((event_id * 7919) % 401 - 200)::DOUBLE * 1e-6::DOUBLE AS lat,
  -122.50::DOUBLE + 0.005::DOUBLE * ((user_id * 3 + rn) % 16)::DOUBLE + ((event_id * 104729) % 401 - 200)::DOUBLE * 1e-6::DOUBLE AS lon,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 ELSE 0 END AS flag,
  (1212796800 + (user_id % 7) * 10800 + rn * 75 + (event_id * 31) % 60)::BIGINT AS ts FROM ev""",
    "nxt": """SELECT *, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon, lead(ts) OVER w AS n_ts, lead(flag) OVER w AS n_flag
  FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq)""",
    "raw_pairs": f"""SELECT * FROM (SELECT *, dist_m / dt_s AS speed_ms FROM (SELECT *, {hav("lat", "lon", "n_lat", "n_lon")} AS dist_m, abs(n_ts - ts) AS dt_s FROM nxt WHERE n_ts IS NOT NULL)
  WHERE dt_s <> 0 AND dist_m <> 0) WHERE speed_ms <= 50""",
    "flagged": """SELECT * FROM (SELECT *, max(CASE WHEN flag = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, grp ORDER BY ts, seq) AS inside
  FROM (SELECT *, (sum(CASE WHEN flag = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS grp FROM pings)) WHERE inside = 1 AND flag <> 0""",
    "runs": """SELECT vehicle_id, grp, count(*) AS n_points, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(lat, seq) AS source_lat, arg_min(lon, seq) AS source_lon, min(ts) AS source_time,
  arg_max(lat, seq) AS dest_lat, arg_max(lon, seq) AS dest_lon, (max(ts) - min(ts)) / 60.0::DOUBLE AS duration_min FROM flagged GROUP BY vehicle_id, grp""",
    "trips": "SELECT *, vehicle_id || '_' || grp AS trip_id FROM runs WHERE n_points >= 4 AND duration_min BETWEEN 1.0 AND 120.0",
    "basic": f"""SELECT *, {hav("source_lat", "source_lon", "dest_lat", "dest_lon")} / 1000.0::DOUBLE AS haversine_km,
  111.0::DOUBLE * (abs(dest_lat - source_lat) + abs(dest_lon - source_lon) * cos(radians(source_lat))) AS manhattan_km,
  {bear("source_lat", "source_lon", "dest_lat", "dest_lon")} AS bearing, {_HOUR.format("source_time")} AS hour, ((source_time % 86400) // 60)::INT AS minute_of_day,
  ((source_time // 86400 + 3) % 7)::INT AS day_of_week, CASE WHEN (source_time // 86400 + 3) % 7 >= 5 THEN 1 ELSE 0 END AS is_weekend FROM trips""",
    "labelled": """SELECT *, (least(3, greatest(0, floor((source_lat - 37.7::DOUBLE) / 0.02::DOUBLE))) * 4 + least(3, greatest(0, floor((source_lon + 122.5::DOUBLE) / 0.02::DOUBLE))))::INT AS src_cluster,
  (least(3, greatest(0, floor((dest_lat - 37.7::DOUBLE) / 0.02::DOUBLE))) * 4 + least(3, greatest(0, floor((dest_lon + 122.5::DOUBLE) / 0.02::DOUBLE))))::INT AS dst_cluster, (grp % 5)::INT AS fold FROM basic""",
    "nodes": "SELECT i AS node_id, i % 16 AS x, i // 16 AS y, 37.70::DOUBLE + 0.005::DOUBLE * (i // 16)::DOUBLE AS lat, -122.50::DOUBLE + 0.005::DOUBLE * (i % 16)::DOUBLE AS lon FROM range(256) t(i)",
    "edges": f"""SELECT a.node_id AS u, b.node_id AS v, 0 AS k, (['motorway', 'primary', 'secondary_link', 'residential', 'tertiary'])[(CASE WHEN a.x = b.x THEN a.x ELSE a.y END) % 5 + 1] AS highway,
  {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS length_m, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon
  FROM nodes a JOIN nodes b ON abs(a.x - b.x) + abs(a.y - b.y) = 1""",
    "projected": """SELECT *, alon + t * (blon - alon) AS proj_lon, alat + t * (blat - alat) AS proj_lat FROM (
  SELECT p.*, e.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((p.lon - alon) * (blon - alon) + (p.lat - alat) * (blat - alat)) / ((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat)))) AS t
  FROM pings p JOIN edges e ON p.lat BETWEEN least(alat, blat) - 0.004 AND greatest(alat, blat) + 0.004 AND p.lon BETWEEN least(alon, blon) - 0.005 AND greatest(alon, blon) + 0.005)""",
    "cands": f"""SELECT *, (row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY dist_m, u, v, k))::INT AS rank FROM (SELECT *, {hav("lat", "lon", "proj_lat", "proj_lon")} AS dist_m FROM projected) WHERE dist_m <= 200""",
    "matched": "SELECT p.*, c.u, c.v, c.k, c.proj_lat, c.proj_lon FROM pings p LEFT JOIN cands c ON p.vehicle_id = c.vehicle_id AND p.seq = c.seq AND c.rank = 1",
    "mpairs": """SELECT * FROM (SELECT *, lead(u) OVER w AS n_u, lead(v) OVER w AS n_v, lead(k) OVER w AS n_k, lead(proj_lat) OVER w AS n_lat, lead(proj_lon) OVER w AS n_lon, lead(ts) OVER w AS n_ts, lead(flag) OVER w AS n_flag
  FROM matched WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq)) WHERE u IS NOT NULL AND n_u IS NOT NULL""",
    "mvalid": f"""SELECT * FROM (SELECT *, dist_m / dt_s AS speed_ms FROM (SELECT *, {hav("proj_lat", "proj_lon", "n_lat", "n_lon")} AS dist_m, abs(n_ts - ts) AS dt_s FROM mpairs) WHERE dt_s <> 0 AND dist_m <> 0) WHERE speed_ms <= 50""",
    "mcapped": f"""SELECT m.* FROM mvalid m JOIN edges a ON m.u = a.u AND m.v = a.v JOIN edges b ON m.n_u = b.u AND m.n_v = b.v WHERE m.speed_ms <= greatest({cap_ms("a.highway")}, {cap_ms("b.highway")})""",
}


def _observations(src: str) -> str:
    t = "(ts + n_ts) // 2"
    body = f"{_DATE.format(t)} AS date, {_BIN.format(t)} AS bin, speed_ms AS speed, CASE WHEN flag = 1 AND n_flag = 1 THEN 2 ELSE 1 END AS weight FROM {src}"
    return f"SELECT u, v, k, {body} UNION ALL SELECT n_u, n_v, n_k, {body} WHERE NOT (u = n_u AND v = n_v AND k = n_k)"


_CTES |= {
    "obs": _observations("mcapped"),
    "obs_nocap": _observations("mvalid"),
    "speeds": "SELECT u, v, k, date, bin, median(speed) AS speed, count(*) AS n_obs FROM (SELECT *, unnest(range(weight)) FROM obs) GROUP BY ALL",
    "tod": "SELECT u, v, k, bin, median(speed) AS tod_speed FROM speeds GROUP BY ALL",
    "adj": """SELECT DISTINCT a.u, a.v, a.k, b.u AS nu, b.v AS nv, b.k AS nk FROM edges a JOIN edges b ON (a.u = b.u OR a.u = b.v OR a.v = b.u OR a.v = b.v) AND NOT (a.u = b.u AND a.v = b.v AND a.k = b.k)""",
    "near": """SELECT j.*, (CASE WHEN a.highway = b.highway THEN 1.0 WHEN replace(a.highway, '_link', '') = replace(b.highway, '_link', '') THEN 0.5 ELSE 0.2 END)::DOUBLE * exp(-abs(a.length_m - b.length_m) / greatest(a.length_m, b.length_m)) AS w
  FROM adj j JOIN edges a ON j.u = a.u AND j.v = a.v JOIN edges b ON j.nu = b.u AND j.nv = b.v""",
    "hop1": """SELECT n.u, n.v, n.k, s.date, s.bin, sum(n.w * 1.5::DOUBLE * s.speed) / sum(n.w * 1.5::DOUBLE) AS speed FROM near n JOIN speeds s ON n.nu = s.u AND n.nv = s.v AND n.nk = s.k
  WHERE NOT EXISTS (SELECT 1 FROM speeds x WHERE x.u = n.u AND x.v = n.v AND x.k = n.k AND x.date = s.date AND x.bin = s.bin) GROUP BY ALL""",
    "known1": "SELECT u, v, k, date, bin, speed, 1.5::DOUBLE AS boost FROM speeds UNION ALL SELECT u, v, k, date, bin, speed, 1.0::DOUBLE FROM hop1",
    "hop2": """SELECT n.u, n.v, n.k, s.date, s.bin, sum(n.w * s.boost * s.speed) / sum(n.w * s.boost) AS speed FROM near n JOIN known1 s ON n.nu = s.u AND n.nv = s.v AND n.nk = s.k
  WHERE NOT EXISTS (SELECT 1 FROM known1 x WHERE x.u = n.u AND x.v = n.v AND x.k = n.k AND x.date = s.date AND x.bin = s.bin) GROUP BY ALL""",
    "known2": "SELECT * FROM known1 UNION ALL SELECT u, v, k, date, bin, speed, 1.0::DOUBLE FROM hop2",
    "hop3": """SELECT n.u, n.v, n.k, s.date, s.bin, sum(n.w * s.boost * s.speed) / sum(n.w * s.boost) AS speed FROM near n JOIN known2 s ON n.nu = s.u AND n.nv = s.v AND n.nk = s.k
  WHERE NOT EXISTS (SELECT 1 FROM known2 x WHERE x.u = n.u AND x.v = n.v AND x.k = n.k AND x.date = s.date AND x.bin = s.bin) GROUP BY ALL""",
    "known3": "SELECT * FROM known2 UNION ALL SELECT u, v, k, date, bin, speed, 1.0::DOUBLE FROM hop3",
    "vpairs": f"SELECT m.*, e.highway, {_HOUR.format('m.ts')} AS hour FROM mvalid m LEFT JOIN edges e ON m.n_u = e.u AND m.n_v = e.v",
    "vstats": """SELECT vehicle_id, avg(speed_ms) AS v_mean_speed_ms, median(speed_ms) AS v_median_speed_ms, quantile_cont(speed_ms, 0.2) AS v_p20_speed_ms, quantile_cont(speed_ms, 0.8) AS v_p80_speed_ms, sum(dist_m) / 1000.0::DOUBLE AS v_total_km, count(*) AS n_pairs
  FROM vpairs GROUP BY vehicle_id HAVING count(*) >= 2""",
    "weather_raw": """SELECT 1212796800 + hk * 3600 AS timestamp_hour, CASE WHEN hk % 11 <> 0 THEN lo / 10.0::DOUBLE END AS temp_c, (n % 5)::DOUBLE / 10.0::DOUBLE AS precip_mm, CASE WHEN hk % 11 <> 0 THEN hi / 20.0::DOUBLE END AS wind_kph, (n % 27)::VARCHAR AS condition
  FROM (SELECT (epoch_us(ts) // 3600000000 - 473352)::BIGINT AS hk, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1)""",
    "weather": """SELECT timestamp_hour, coalesce(t, median(t) OVER ()) AS temp_c, precip_mm, coalesce(w, median(w) OVER ()) AS wind_kph, coalesce(condition, '0') AS condition FROM (
  SELECT *, coalesce(temp_c, median(temp_c) OVER o) AS t, coalesce(wind_kph, median(wind_kph) OVER o) AS w FROM weather_raw WINDOW o AS (ORDER BY timestamp_hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    "preds": """SELECT vehicle_id, grp, is_weekend, duration_min, haversine_km, haversine_km * 1.3::DOUBLE AS route_km, haversine_km * 1.3::DOUBLE / 11.2::DOUBLE / 0.06::DOUBLE AS physics_min, duration_min * (vehicle_id % 7) / 5.0::DOUBLE AS raw_pred FROM basic""",
    "guarded": """SELECT *, least(240.0::DOUBLE, greatest(0.5::DOUBLE, CASE WHEN p / phys < 1.0::DOUBLE / 3.0::DOUBLE THEN 0.4::DOUBLE * p + 0.6::DOUBLE * phys ELSE p END)) AS guarded FROM (
  SELECT *, least(greatest(raw_pred, m / 40.0::DOUBLE / 60.0::DOUBLE), m / 0.7::DOUBLE / 60.0::DOUBLE) AS p, least(120.0::DOUBLE, greatest(0.5::DOUBLE, physics_min)) AS phys FROM (
  SELECT *, greatest(route_km, haversine_km, 0.05::DOUBLE) * 1000.0::DOUBLE AS m FROM preds))""",
    "near_nodes": "SELECT lat, lon, arg_min(node_id, (d2, node_id)) AS node_id FROM (SELECT p.lat, p.lon, n.node_id, (p.lat - n.lat) * (p.lat - n.lat) + (p.lon - n.lon) * (p.lon - n.lon) AS d2 FROM (SELECT DISTINCT lat, lon FROM pings) p, nodes n) GROUP BY lat, lon",
    "emitted": f"""SELECT c.*, s.step, greatest(-0.5::DOUBLE * (dist_m / SIGMA) * (dist_m / SIGMA) - ln(SIGMA * sqrt(2 * pi())) + coalesce(-(power(least(abs(heading - along), 360 - abs(heading - along)), 2)) / 4050.0::DOUBLE, 0.0::DOUBLE), ln(1e-50::DOUBLE)) AS logp
  FROM (SELECT *, {bear("alat", "alon", "blat", "blon")} AS along FROM cands) c JOIN (
  SELECT vehicle_id, seq, (row_number() OVER w - 1)::INT AS step, CASE WHEN {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} >= 5 THEN {bear("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} END AS heading
  FROM (SELECT DISTINCT vehicle_id, seq, ts, lat, lon FROM cands) WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq)) s ON c.vehicle_id = s.vehicle_id AND c.seq = s.seq""",
    "hops": "SELECT u AS src, u AS v, 0 AS h, 0.0::DOUBLE AS d FROM (SELECT DISTINCT u FROM edges) UNION ALL SELECT r.src, e.v, r.h + 1, min(r.d + e.length_m) FROM hops r JOIN edges e ON r.v = e.u WHERE r.h < 30 GROUP BY r.src, e.v, r.h",
    "dist": "SELECT src, v AS dst, min(d) AS dist FROM hops GROUP BY src, v",
    "steps": "SELECT vehicle_id, seq, u, v, rank, (dense_rank() OVER (PARTITION BY vehicle_id ORDER BY ts, seq) - 1)::INT AS step FROM cands",
    "trans": """SELECT a.vehicle_id, b.step, a.rank AS i, b.rank AS j, greatest(CASE WHEN d.dist <= 30.0::DOUBLE * (-ln(1e-50::DOUBLE) - ln(30.0::DOUBLE)) + 1 THEN -d.dist / 30.0::DOUBLE - ln(30.0::DOUBLE) ELSE ln(1e-50::DOUBLE) END, ln(1e-50::DOUBLE)) AS logp
  FROM steps a JOIN steps b ON a.vehicle_id = b.vehicle_id AND b.step = a.step + 1 LEFT JOIN dist d ON a.v = d.src AND b.u = d.dst""",
}
_CTES |= {
    "brk": """SELECT *, (sum(b) OVER (PARTITION BY vehicle_id ORDER BY step ROWS UNBOUNDED PRECEDING))::INT AS segment_id
  FROM (SELECT vehicle_id, step, CASE WHEN max(logp) < ln(1e-8::DOUBLE) THEN 1 ELSE 0 END AS b FROM trans GROUP BY vehicle_id, step)""",
    "lattice": "SELECT e.vehicle_id, e.seq, e.step, e.rank, e.u, e.v, e.k, e.proj_lat, e.proj_lon, e.logp, coalesce(b.b, 1) AS starts, coalesce(b.segment_id, 0) AS segment_id FROM emitted e LEFT JOIN brk b ON e.vehicle_id = b.vehicle_id AND e.step = b.step",
    "vit": """SELECT vehicle_id, step, rank, logp AS score, NULL::INT AS prev FROM lattice WHERE starts = 1 UNION ALL
  SELECT t.vehicle_id, t.step, t.j, max(r.score + t.logp) + any_value(l.logp), arg_max(t.i, (r.score + t.logp, -t.i)) FROM vit r JOIN trans t ON r.vehicle_id = t.vehicle_id AND t.step = r.step + 1 AND t.i = r.rank
  JOIN lattice l ON l.vehicle_id = t.vehicle_id AND l.step = t.step AND l.rank = t.j AND l.starts = 0 GROUP BY t.vehicle_id, t.step, t.j""",
    "back": """SELECT vehicle_id, step, rank, prev FROM (SELECT v.*, row_number() OVER (PARTITION BY v.vehicle_id, l.segment_id ORDER BY v.step DESC, v.score DESC, v.rank) AS r FROM vit v JOIN lattice l ON v.vehicle_id = l.vehicle_id AND v.step = l.step AND v.rank = l.rank) WHERE r = 1
  UNION ALL SELECT v.vehicle_id, v.step, v.rank, v.prev FROM back b JOIN vit v ON b.vehicle_id = v.vehicle_id AND v.step = b.step - 1 AND v.rank = b.prev WHERE b.prev IS NOT NULL""",
    "hmm": """SELECT p.*, l.u, l.v, l.k, l.proj_lat, l.proj_lon, l.segment_id FROM pings p LEFT JOIN
  (SELECT x.* FROM back b JOIN lattice x ON b.vehicle_id = x.vehicle_id AND b.step = x.step AND b.rank = x.rank WHERE b.vehicle_id IN (SELECT vehicle_id FROM lattice WHERE step >= 1)) l ON p.vehicle_id = l.vehicle_id AND p.seq = l.seq""",
}
_NEEDS = {name: [n for n in _CTES if n != name and any(f"{kw} {n}" in body.replace("\n", " ").replace("(", " ( ") for kw in ("FROM", "JOIN", "from", "join"))] for name, body in _CTES.items()}
_EXTRA = {"near_nodes": ["nodes"], "emitted": ["cands"], "hop1": ["near", "speeds"], "hop2": ["near", "known1"], "known2": ["hop2"], "hop3": ["near", "known2"], "known3": ["hop3"]}


def _hmm(sql: str) -> str:
    """The same with candidates within the radius that adapts to the time since the last ping (no ping of the adapter is within 8 m of the one before)."""
    dt = "abs(ts - lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, seq))"
    radius = f"CASE WHEN {dt} IS NULL THEN 200.0::DOUBLE ELSE least(350.0::DOUBLE, greatest(200.0::DOUBLE, 2 * 20.0::DOUBLE + 10.0::DOUBLE * greatest(1, {dt}))) END"
    return sql.replace("FROM pings p JOIN edges e ON", f"FROM (SELECT *, {radius} AS radius FROM pings) p JOIN edges e ON").replace("dist_m <= 200)", "dist_m <= radius)").replace("WHERE dist_m <= 200", "WHERE dist_m <= radius")


def _through_hmm(body: str, *names: str) -> str:
    """A query over matches from the hidden Markov model, of vehicles with two at least."""
    plain = _CTES["matched"]
    _CTES["matched"], _NEEDS["matched"] = "SELECT * FROM hmm QUALIFY count(u) OVER (PARTITION BY vehicle_id) >= 2", ["hmm"]
    try:
        return _hmm(_sql(body, *names, sigma=20.0))
    finally:
        _CTES["matched"], _NEEDS["matched"] = plain, ["pings", "cands"]


def _sql(body: str, *names: str, sigma: float = C.SIGMA_Z) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for m in [*_NEEDS[n], *_EXTRA.get(n, [])]:
            add(m)
        order.append(n)

    for n in names:
        add(n)
    views = ",\n".join(f"{n} AS ({_CTES[n]})" for n in order)
    return ("WITH RECURSIVE " if {"hops", "vit"} & set(order) else "WITH ") + views.replace("SIGMA", f"{sigma}::DOUBLE") + "\n" + body


_HOURS = ", ".join(r(f"coalesce(median(speed_ms) FILTER (hour = {h}), median(speed_ms))") + f" AS v_hour_speed_h{h:02d}" for h in range(24))
_CLUSTER = "(list_position(LIST, list_min(LIST)) - 1)::INT"


def _cluster(lat: str, lon: str) -> str:
    d = "[" + ", ".join(f"({lat} - {a!r}::DOUBLE) * ({lat} - {a!r}::DOUBLE) + ({lon} - ({b!r}::DOUBLE)) * ({lon} - ({b!r}::DOUBLE))" for a, b in _CENTROIDS) + "]"
    return _CLUSTER.replace("LIST", d)


_ENRICHED = ", ".join(f"round(coalesce(h{h}, hall, v_median_speed_ms, 10.0::DOUBLE), 6) + 0.0::DOUBLE AS v_hour_speed_h{h:02d}" for h in range(24))
_LINES = """SELECT 'v' || vehicle_id AS vehicle_id, seq AS line_no, lat, lon, flag, ts FROM pings p WHERE seq % 17 <> 0 AND NOT (vehicle_id % 9 = 0 AND EXISTS (SELECT 1 FROM pings q WHERE q.vehicle_id = p.vehicle_id AND q.seq = 5))"""
_SCAN = f"SELECT vehicle_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, line_no) AS seq, {r('lat')} AS lat, {r('lon')} AS lon, flag, ts FROM ({_LINES})"
_PCT = ", ".join(f"{r(f'quantile_cont(duration_min, {q / 100})')} AS p{q}" for q in (5, 10, 25, 50, 75, 90, 95))
_H = "coalesce(a.m, b.m, c.m, (SELECT median(duration_min) FROM BASE))", "coalesce(b.m, c.m, (SELECT median(duration_min) FROM BASE))", "coalesce(c.m, (SELECT median(duration_min) FROM BASE))"


def _hist(base: str, fold: str) -> str:
    cols = ", ".join(f"{r(x.replace('BASE', base))} AS {n}" for x, n in zip(_H, ("hist_duration_min", "hist_duration_od", "hist_duration_hour"), strict=True))
    return cols


SQL: dict[str, str] = {
    "pair_speeds": _sql(f"SELECT vehicle_id, seq, {r('dist_m')} AS dist_m, dt_s, {r('speed_ms')} AS speed_ms FROM raw_pairs", "raw_pairs"),
    "bin_speed": _sql(
        f"SELECT date, bin, {r('median(speed_ms)')} AS median_speed, count(*) AS n_obs FROM (SELECT *, unnest(range(CASE WHEN flag = 1 AND n_flag = 1 THEN 2 ELSE 1 END)) FROM (SELECT *, {_DATE.format('(ts + n_ts) // 2')} AS date, {_BIN.format('(ts + n_ts) // 2')} AS bin FROM raw_pairs)) GROUP BY date, bin",
        "raw_pairs",
    ),
    "geo_scalars": _sql(
        f"SELECT vehicle_id, seq, {r(hav('lat', 'lon', 'n_lat', 'n_lon'))} AS hav_m, {r('b')} AS bearing, {r('least(abs(b - 350), 360 - abs(b - 350))')} AS delta, {r('111.0::DOUBLE * (abs(n_lat - lat) + abs(n_lon - lon) * cos(radians(lat)))')} AS manhattan FROM (SELECT *, {bear('lat', 'lon', 'n_lat', 'n_lon')} AS b FROM nxt WHERE n_lat IS NOT NULL)",
        "nxt",
    ),
    "time_bins": _sql(f"SELECT vehicle_id, seq, {_DATE.format('ts')} AS date, {_BIN.format('ts')} AS bin, ts - ts % 3600 AS hour_ts, {_HOUR.format('ts')} AS hour, (isodow(make_timestamp(ts * 1000000)) - 1)::INT AS dow FROM pings", "pings"),
    "parse_query_time": _sql("SELECT vehicle_id, seq, ts - ts % 60 AS parsed_ts FROM pings", "pings"),
    "class_bucket": _sql(f"SELECT u, v, k, highway, {_case('highway', C.CLASS_BUCKET, 'other')} AS bucket, {r(default_ms('highway'))} AS default_ms, {r(cap_ms('highway'))} AS cap_ms FROM edges", "edges"),
    "ping_prefix": _sql("SELECT vehicle_id, seq, ts, flag FROM (SELECT *, count(*) OVER (PARTITION BY vehicle_id) AS n, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, seq) AS r FROM pings) WHERE n >= 4 AND r <= 50", "pings"),
    "trip_segments": _sql("SELECT vehicle_id, first_seq, last_seq, n_points, source_time, " + ", ".join(f"{r(c)} AS {c}" for c in ("source_lat", "source_lon", "dest_lat", "dest_lon", "duration_min")) + " FROM trips", "trips"),
    "gap_trips": _sql(
        f"SELECT vehicle_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_points, {r('(max(ts) - min(ts)) / 60.0::DOUBLE')} AS duration_min FROM (SELECT *, sum(late) OVER (PARTITION BY vehicle_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, seq) > 80 THEN 1 ELSE 0 END AS late FROM pings)) GROUP BY vehicle_id, g HAVING count(*) >= 4",
        "pings",
    ),
    "prefix_samples": _sql(
        f"SELECT vehicle_id, grp, idx::INT AS idx, t0 AS source_time, {r('(ts - t0) / 60.0::DOUBLE')} AS duration_min FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, grp ORDER BY ((vehicle_id * 7919 + grp * 104729 + idx * 15485863 + 42) * 31) % 1000003, idx) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, grp ORDER BY ts, seq) - 1 AS idx, count(*) OVER (PARTITION BY vehicle_id, grp) AS n, min(ts) OVER (PARTITION BY vehicle_id, grp) AS t0, max(ts) OVER (PARTITION BY vehicle_id, grp) AS t1 FROM flagged) WHERE n >= 4 AND t1 - t0 BETWEEN 60 AND 7200 AND idx >= 2 AND idx <= n - 2) WHERE pick <= 5 AND ts - t0 >= 60",
        "flagged",
    ),
    "val_pairs": _sql(
        f""", p AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, seq) - 1 AS idx, count(*) OVER (PARTITION BY vehicle_id) AS n FROM pings),
ab AS (SELECT x.vehicle_id, x.idx AS a, y.idx AS b, x.ts AS source_time, y.ts AS dest_time, ((x.vehicle_id * 7919 + x.idx * 104729 + y.idx * 15485863 + 42) * 31) % 1000003 AS draw FROM p x JOIN p y ON x.vehicle_id = y.vehicle_id AND y.idx > x.idx AND y.ts - x.ts BETWEEN 60 AND 7200 AND {hav("x.lat", "x.lon", "y.lat", "y.lon")} >= 100 WHERE x.n >= 20 AND x.idx < x.n * 9 // 10)
SELECT vehicle_id, a::INT AS a, b::INT AS b, source_time, {r("(dest_time - source_time) / 60.0::DOUBLE")} AS duration_min FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY draw, a) AS q FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, a ORDER BY draw, b) AS r FROM ab) WHERE r = 1) WHERE q <= 8""",
        "pings",
    ).replace("\n, p AS", ", p AS"),
    "chrono_split": _sql("SELECT vehicle_id, grp, source_time, source_time > (SELECT max(source_time) FROM trips) - 43200 AS is_val FROM trips", "trips"),
    "basic_features": _sql(
        f"SELECT vehicle_id, grp, {r('haversine_km')} AS haversine_km, {r('manhattan_km')} AS manhattan_km, {r('bearing')} AS bearing, hour, minute_of_day, day_of_week, is_weekend, {r('sin(2 * pi() * minute_of_day / 1440.0::DOUBLE)')} AS hour_sin, {r('cos(2 * pi() * minute_of_day / 1440.0::DOUBLE)')} AS hour_cos FROM basic",
        "basic",
    ),
    "target_modes": _sql(
        f"SELECT vehicle_id, grp, {r('duration_min - phys')} AS t_residual, {r('ln(1 + duration_min)')} AS t_log, {r('duration_min')} AS t_raw, {r('duration_min')} AS i_residual, {r('duration_min')} AS i_log, {r('duration_min')} AS i_raw FROM (SELECT *, haversine_km / 11.2::DOUBLE / 0.06::DOUBLE AS phys FROM basic)",
        "basic",
    ),
    "nearest_node": _sql("SELECT p.vehicle_id, p.seq, n.node_id FROM pings p JOIN near_nodes n ON p.lat = n.lat AND p.lon = n.lon", "near_nodes", "pings"),
    "edge_adjacency": _sql("SELECT * FROM adj", "adj"),
    "simple_edges": _sql(
        f"SELECT u, v, k, {r('length_m')} AS length_m FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY coalesce(length_m, 1e9), k) AS r FROM (SELECT u, v, k, length_m FROM edges UNION ALL SELECT u, v, 1, CASE WHEN u % 2 = 0 THEN length_m * 0.5::DOUBLE END FROM edges WHERE u % 3 = 0)) WHERE r = 1",
        "edges",
    ),
    "edge_samples": _sql(
        f"SELECT u, v, k, i::INT AS i, {r('alat + (blat - alat) * (i / (n - 1)::DOUBLE)', 7)} AS lat, {r('alon + (blon - alon) * (i / (n - 1)::DOUBLE)', 7)} AS lon FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(2, trunc(sqrt((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat)) / 0.0005::DOUBLE)::INT + 1) AS n FROM edges))",
        "edges",
    ),
    "candidates": _sql(f"SELECT vehicle_id, seq, u, v, k, {r('dist_m')} AS dist_m, rank FROM cands", "cands"),
    "emission": _sql(f"SELECT vehicle_id, seq, step, u, v, k, {r('logp')} AS logp FROM emitted", "emitted", sigma=50.0),
    "sssp": _sql(f"SELECT src, dst, {r('dist')} AS dist FROM dist", "dist"),
    "transitions": _sql(f"SELECT vehicle_id, step, count(*) AS n, {r('max(logp)', 5)} AS best, {r('min(logp)', 5)} AS worst FROM trans GROUP BY vehicle_id, step", "trans"),
    "path_breaks": _sql("SELECT vehicle_id, step, b::INT AS breaks, (sum(b) OVER (PARTITION BY vehicle_id ORDER BY step ROWS UNBOUNDED PRECEDING))::INT AS segment_id FROM (SELECT vehicle_id, step, CASE WHEN max(logp) < ln(1e-8::DOUBLE) THEN 1 ELSE 0 END AS b FROM trans GROUP BY vehicle_id, step)", "trans"),
    "viterbi": _hmm(_sql("SELECT vehicle_id, seq, u, v, k, segment_id FROM hmm", "hmm", sigma=20.0)),
    "phase_a": _through_hmm(f"SELECT u, v, k, date, bin, {r('speed')} AS speed, n_obs FROM speeds", "speeds"),
    "vehicle_matching": _through_hmm("SELECT vehicle_id, " + ", ".join(f"{r(c)} AS {c}" for c in ("v_mean_speed_ms", "v_median_speed_ms", "v_p20_speed_ms", "v_p80_speed_ms", "v_total_km")) + ", n_pairs FROM vstats", "vstats"),
    "phase_b": _sql(
        f"""SELECT e.u, e.v, e.k, b.date, b.bin, {r('coalesce(s.speed, ' + default_ms('e.highway') + ')')} AS speed, CASE WHEN s.speed IS NULL THEN 'default' WHEN s.boost > 1 THEN 'observed' ELSE 'propagated' END AS origin
FROM edges e CROSS JOIN (SELECT DISTINCT date, bin FROM speeds) b LEFT JOIN known3 s ON e.u = s.u AND e.v = s.v AND e.k = s.k AND b.date = s.date AND b.bin = s.bin""",
        "known3",
    ),
    "training_rows": "SELECT vehicle_id, grp, -1 AS idx, source_time, duration_min FROM (TRIPS) UNION ALL SELECT vehicle_id, grp, idx, source_time, duration_min FROM (SAMPLES)",
    "seeded_sample": _sql("SELECT vehicle_id, ts FROM pings WHERE seq = 1 ORDER BY ((vehicle_id * 7919 + 42) * 31) % 1000003, vehicle_id LIMIT 20", "pings"),
    "matched_pairs": _sql("SELECT vehicle_id, seq, u, v, k, n_u, n_v, n_k FROM mpairs", "mpairs"),
    "capped_speeds": _sql("SELECT u, v, k, count(*) AS n, round(max(speed), 6) AS top_speed FROM obs GROUP BY u, v, k", "obs"),
    "edge_bin_speed": _sql(f"SELECT u, v, k, date, bin, {r('speed')} AS speed, n_obs FROM speeds", "speeds"),
    "edge_bin_speed_nocap": _sql(f"SELECT u, v, k, date, bin, {r('median(speed)')} AS speed, count(*) AS n_obs FROM (SELECT *, unnest(range(weight)) FROM obs_nocap) GROUP BY u, v, k, date, bin", "obs_nocap"),
    "bin_summary": _sql("SELECT count(DISTINCT (date, bin)) AS n_bins, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, count(DISTINCT (u, v, k)) AS n_segments FROM speeds", "speeds"),
    "tod_median": _sql(f"SELECT u, v, k, bin, {r('tod_speed')} AS tod_speed FROM tod", "tod"),
    "propagate_hop": _sql(f"SELECT u, v, k, date, bin, {r('speed')} AS speed FROM hop1", "hop1"),
    "propagate": _sql(f"SELECT u, v, k, date, bin, {r('speed')} AS speed, CASE WHEN boost > 1 THEN 'observed' ELSE 'propagated' END AS origin FROM known1 UNION ALL SELECT u, v, k, date, bin, {r('speed')}, 'propagated' FROM hop2", "hop2"),
    "default_fill": _sql(
        f"SELECT e.u, e.v, e.k, b.date, b.bin, {r('coalesce(s.speed, ' + default_ms('e.highway') + ')')} AS speed, CASE WHEN s.speed IS NULL THEN 'default' ELSE 'observed' END AS origin FROM edges e CROSS JOIN (SELECT DISTINCT date, bin FROM speeds) b LEFT JOIN speeds s ON e.u = s.u AND e.v = s.v AND e.k = s.k AND b.date = s.date AND b.bin = s.bin",
        "speeds",
    ),
    "merge_speeds": _sql(
        f"SELECT u, v, k, date, bin, {r('median(speed)')} AS speed FROM (SELECT u, v, k, date, bin, speed FROM speeds UNION ALL SELECT u, v, k, date, bin, speed FROM (SELECT *, unnest(range(weight)) FROM obs_nocap)) GROUP BY u, v, k, date, bin",
        "speeds",
        "obs_nocap",
    ),
    "speed_lookup": _sql(
        f"SELECT w.u, w.v, w.k, w.date, w.bin, {r('coalesce(s.speed, t.tod_speed)')} AS speed FROM (SELECT DISTINCT u, v, k, CASE WHEN u % 2 = 0 THEN date ELSE '1999-01-01' END AS date, bin FROM speeds) w LEFT JOIN speeds s ON w.u = s.u AND w.v = s.v AND w.k = s.k AND w.date = s.date AND w.bin = s.bin LEFT JOIN tod t ON w.u = t.u AND w.v = t.v AND w.k = t.k AND w.bin = t.bin",
        "speeds",
        "tod",
    ),
    "edge_travel_time": _sql(f"SELECT e.u, e.v, e.k, coalesce(s.date, '') AS date, coalesce(s.bin, -1) AS bin, {r('e.length_m / CASE WHEN s.speed > 0.1 THEN s.speed ELSE ' + default_ms('e.highway') + ' END')} AS tt FROM edges e LEFT JOIN speeds s ON e.u = s.u AND e.v = s.v AND e.k = s.k", "speeds"),
    "calibrate": _sql(
        f"""SELECT {r("least(40.0::DOUBLE, greatest(3.0::DOUBLE, med / 0.6745::DOUBLE))", 4)} AS sigma_z, {r("least(30.0::DOUBLE, greatest(1.0::DOUBLE, b))", 4)} AS beta, {r("med / 0.6745::DOUBLE", 4)} AS sigma_z_raw, {r("b", 4)} AS beta_raw, {r("med", 4)} AS candidate_median_m, {r("p90", 4)} AS candidate_p90_m, {r("bm", 4)} AS pair_median, n AS n_samples_candidates, bn AS n_samples_pairs
FROM (SELECT median(dist_m) AS med, quantile_cont(dist_m, 0.9) AS p90, count(*) AS n FROM cands WHERE rank = 1), (SELECT avg(dist) AS b, median(dist) AS bm, count(*) AS bn FROM mpairs m JOIN dist d ON m.v = d.src AND m.n_u = d.dst)""",
        "mpairs",
        "dist",
    ),
    "coverage_report": _sql(
        f"SELECT count(*) AS n_keys, sum(n)::BIGINT AS n_obs, count(DISTINCT (u, v, k)) AS n_edges_seen, {r('median(n)')} AS median_obs_per_key, (SELECT count(*) FROM edges) AS n_edges, {r('100.0::DOUBLE * count(DISTINCT (u, v, k)) / (SELECT count(*) FROM edges)')} AS pct_covered FROM (SELECT u, v, k, date, bin, sum(weight) AS n FROM obs GROUP BY ALL)",
        "obs",
    ),
    "vehicle_stats": _sql("SELECT vehicle_id, " + ", ".join(f"{r(c)} AS {c}" for c in ("v_mean_speed_ms", "v_median_speed_ms", "v_p20_speed_ms", "v_p80_speed_ms", "v_total_km")) + ", n_pairs FROM vstats", "vstats"),
    "dominant_hour": _sql("SELECT vehicle_id, hour AS v_hour_dominant FROM (SELECT vehicle_id, hour, row_number() OVER (PARTITION BY vehicle_id ORDER BY count(*) DESC, min(ts)) AS r FROM vpairs GROUP BY vehicle_id, hour) WHERE r = 1", "vpairs"),
    "hour_entropy": _sql(f"SELECT vehicle_id, {r('-sum(p * ln(p)) / ln(24)')} AS v_hour_entropy FROM (SELECT vehicle_id, count(*) / sum(count(*)) OVER (PARTITION BY vehicle_id) AS p FROM vpairs GROUP BY vehicle_id, hour) GROUP BY vehicle_id", "vpairs"),
    "pct_highway": _sql(f"SELECT vehicle_id, {r('avg(CASE WHEN regexp_matches(highway, ' + chr(39) + 'motorway|trunk' + chr(39) + ') THEN 1.0 ELSE 0.0 END)', 9)} AS v_pct_highway FROM vpairs GROUP BY vehicle_id", "vpairs"),
    "typical_trip": _sql(
        f"SELECT v.vehicle_id, v.n AS v_n_points, {r('coalesce(t.m, 10.0::DOUBLE)')} AS v_typical_trip_min, coalesce(t.n, 0) AS v_n_trips FROM (SELECT vehicle_id, count(*) AS n FROM pings GROUP BY 1) v LEFT JOIN (SELECT vehicle_id, median(duration_min) AS m, count(*) AS n FROM runs WHERE duration_min BETWEEN 1.0 AND 120.0 GROUP BY 1) t ON v.vehicle_id = t.vehicle_id",
        "runs",
    ),
    "hour_speed_pivot": _sql(f"SELECT vehicle_id, {_HOURS} FROM vpairs GROUP BY vehicle_id", "vpairs"),
    "hour_speed_enrich": _sql(
        f"SELECT s.vehicle_id, {r('s.v_median_speed_ms')} AS v_median_speed_ms, {_ENRICHED} FROM vstats s LEFT JOIN (SELECT vehicle_id, median(speed_ms) AS hall, " + ", ".join(f"median(speed_ms) FILTER ({_HOUR.format('ts')} = {h}) AS h{h}" for h in range(24)) + " FROM raw_pairs GROUP BY vehicle_id) p ON s.vehicle_id = p.vehicle_id",
        "vstats",
        "raw_pairs",
    ),
    "weather_fill": _sql(f"SELECT timestamp_hour, {r('temp_c')} AS temp_c, {r('precip_mm')} AS precip_mm, {r('wind_kph')} AS wind_kph, condition FROM weather", "weather"),
    "weather_join": _sql(
        f""", w AS (SELECT * FROM weather)
SELECT t.vehicle_id, t.grp, t.source_time, {r("coalesce(w.temp_c, (SELECT median(temp_c) FROM w))")} AS temp_c, {r("coalesce(w.precip_mm, (SELECT median(precip_mm) FROM w))")} AS precip_mm, {r("coalesce(w.wind_kph, (SELECT median(wind_kph) FROM w))")} AS wind_kph, coalesce(w.condition, '0') AS condition, CASE WHEN coalesce(w.precip_mm, (SELECT median(precip_mm) FROM w)) > 0.1 THEN 1 ELSE 0 END AS weather_is_rain
FROM trips t LEFT JOIN w ON t.source_time - t.source_time % 3600 = w.timestamp_hour""",
        "trips",
        "weather",
    ).replace("\n, w AS", ", w AS"),
    "weather_hit_rate": _sql(f"SELECT count(*) AS n_rows, {r('avg(CASE WHEN w.timestamp_hour IS NOT NULL THEN 1.0 ELSE 0.0 END)', 9)} AS hit_rate FROM trips t LEFT JOIN weather_raw w ON t.source_time - t.source_time % 3600 = w.timestamp_hour", "trips", "weather_raw"),
    "hist_medians": _sql(
        f"SELECT CASE WHEN grouping(src_cluster) = 0 AND grouping(hour) = 0 THEN 'od_hour' WHEN grouping(src_cluster) = 0 THEN 'od' WHEN grouping(hour) = 0 THEN 'hour' ELSE 'all' END AS grain, coalesce(src_cluster, -1) AS src_cluster, coalesce(dst_cluster, -1) AS dst_cluster, coalesce(hour, -1) AS hour, {r('median(duration_min)')} AS median_min, count(*) AS n FROM (SELECT src_cluster AS src_cluster, dst_cluster, hour, duration_min FROM labelled) GROUP BY GROUPING SETS ((src_cluster, dst_cluster, hour), (src_cluster, dst_cluster), (hour), ())",
        "labelled",
    ),
    "hist_encode": _sql(
        f""", train AS (SELECT * FROM labelled WHERE fold <> 0)
SELECT t.vehicle_id, t.grp, {_hist("train", "")} FROM labelled t
LEFT JOIN (SELECT src_cluster, dst_cluster, hour, median(duration_min) AS m FROM train GROUP BY 1, 2, 3) a ON t.src_cluster = a.src_cluster AND t.dst_cluster = a.dst_cluster AND t.hour = a.hour
LEFT JOIN (SELECT src_cluster, dst_cluster, median(duration_min) AS m FROM train GROUP BY 1, 2) b ON t.src_cluster = b.src_cluster AND t.dst_cluster = b.dst_cluster
LEFT JOIN (SELECT hour, median(duration_min) AS m FROM train GROUP BY 1) c ON t.hour = c.hour WHERE t.fold = 0""",
        "labelled",
    ).replace("\n, train AS", ", train AS"),
    "oof_encode": _sql(
        f""", rest AS (SELECT l.*, f.f FROM labelled l JOIN range(5) f(f) ON l.fold <> f.f)
SELECT t.vehicle_id, t.grp, {_hist("labelled", "")} FROM labelled t
LEFT JOIN (SELECT f, src_cluster, dst_cluster, hour, median(duration_min) AS m FROM rest GROUP BY 1, 2, 3, 4) a ON t.fold = a.f AND t.src_cluster = a.src_cluster AND t.dst_cluster = a.dst_cluster AND t.hour = a.hour
LEFT JOIN (SELECT f, src_cluster, dst_cluster, median(duration_min) AS m FROM rest GROUP BY 1, 2, 3) b ON t.fold = b.f AND t.src_cluster = b.src_cluster AND t.dst_cluster = b.dst_cluster
LEFT JOIN (SELECT f, hour, median(duration_min) AS m FROM rest GROUP BY 1, 2) c ON t.fold = c.f AND t.hour = c.hour""",
        "labelled",
    ).replace("\n, rest AS", ", rest AS"),
    "route_cost": _sql(
        f""", far AS (SELECT src, v AS dst, min(d) AS dist FROM hops GROUP BY src, v), ends AS (SELECT t.vehicle_id, t.grp, a.node_id AS src, b.node_id AS dst FROM trips t JOIN near_nodes a ON t.source_lat = a.lat AND t.source_lon = a.lon JOIN near_nodes b ON t.dest_lat = b.lat AND t.dest_lon = b.lon)
SELECT e.vehicle_id, e.grp, e.src, e.dst, {r("f.dist")} AS seconds FROM ends e LEFT JOIN far f ON e.src = f.src AND e.dst = f.dst""",
        "hops",
        "trips",
        "near_nodes",
    )
    .replace("\n, far AS", ", far AS")
    .replace("min(r.d + e.length_m)", f"min(r.d + e.length_m / ({default_ms('e.highway')}))")
    .replace("r.h < 30", "r.h < 60"),
    "knn_eta": _sql(
        f""", q AS (SELECT * FROM basic WHERE grp % 5 = 0), h AS (SELECT * FROM basic WHERE grp % 5 <> 0),
s AS (SELECT q.trip_id AS query_id, h.duration_min, row_number() OVER (PARTITION BY q.trip_id ORDER BY {hav("h.source_lat", "h.source_lon", "q.source_lat", "q.source_lon")} + {hav("h.dest_lat", "h.dest_lon", "q.dest_lat", "q.dest_lon")}, h.trip_id) AS r FROM q JOIN h ON q.vehicle_id = h.vehicle_id AND least(abs(q.hour - h.hour), 24 - abs(q.hour - h.hour)) <= 2),
k AS (SELECT query_id, median(duration_min) AS m, count(*)::INT AS n FROM s WHERE r <= 10 GROUP BY query_id)
SELECT q.trip_id AS query_id, {r("least(240.0::DOUBLE, greatest(0.5::DOUBLE, coalesce(k.m, greatest(0.5::DOUBLE, q.haversine_km / 12.0::DOUBLE * 60.0::DOUBLE))))")} AS knn_min, coalesce(k.n, 0) AS n_neighbours FROM q LEFT JOIN k ON q.trip_id = k.query_id""",
        "basic",
    ).replace("\n, q AS", ", q AS"),
    "quantile_map": f"""WITH p AS (SELECT o_orderkey, o_totalprice / 10000.0::DOUBLE AS pred FROM orders),
a AS (SELECT o_orderkey, (rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE) / (count(*) OVER ())::DOUBLE AS pct FROM p),
t AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS at FROM events)
SELECT a.o_orderkey, {r("least(120.0::DOUBLE, greatest(0.5::DOUBLE, t.value))")} AS mapped FROM a JOIN t ON t.at = least((SELECT count(*) - 1 FROM events), greatest(0, round_even(a.pct * (SELECT count(*) - 1 FROM events)::DOUBLE, 0)::BIGINT))""",
    "sanity_guard": _sql(f"SELECT vehicle_id, grp, {r('raw_pred')} AS raw_pred, {r('guarded')} AS guarded FROM guarded", "guarded"),
    "guard_report": _sql("SELECT count(*) AS n_rows, (sum(CASE WHEN abs(raw_pred - guarded) > 0.5 THEN 1 ELSE 0 END))::BIGINT AS n_adjusted FROM guarded", "guarded"),
    "ensemble_blend": _sql(
        f"SELECT vehicle_id, grp, {r('(raw_pred / a + physics_min / b) / (1 / a + 1 / b)')} AS blend FROM preds, (SELECT sqrt(avg(power(raw_pred - duration_min, 2))) AS a, sqrt(avg(power(physics_min - duration_min, 2))) AS b FROM preds)",
        "preds",
    ),
    "rmse_report": _sql(f"SELECT CASE WHEN grouping(is_weekend) = 1 THEN 'all' WHEN is_weekend = 1 THEN 'weekend' ELSE 'weekday' END AS stratum, {r('sqrt(avg(power(physics_min - duration_min, 2)))')} AS rmse, count(*) AS n FROM preds GROUP BY ROLLUP (is_weekend)", "preds"),
    "duration_percentiles": _sql(f"SELECT {_PCT}, {r('avg(duration_min)')} AS mean, {r('max(duration_min)')} AS max, count(*) AS n FROM trips", "trips"),
    "assign_cluster": _sql(f"SELECT *, src_cluster || '_' || dst_cluster AS od_pair FROM (SELECT vehicle_id, grp, {_cluster('source_lat', 'source_lon')} AS src_cluster, {_cluster('dest_lat', 'dest_lon')} AS dst_cluster FROM trips)", "trips"),
    "ping_scan": _sql(_SCAN, "pings"),
    "ping_union": _sql(_SCAN, "pings"),
}
SQL["training_rows"] = SQL["training_rows"].replace("TRIPS", SQL["trip_segments"].replace("SELECT vehicle_id, first_seq", "SELECT vehicle_id, grp, first_seq")).replace("SAMPLES", SQL["prefix_samples"])
