"""Fixed values that results depend on."""

EARTH_RADIUS_M = 6_371_000.0
TIME_INTERVAL_S = 1800
SIGMA_Z, BETA = 4.07, 3.0
DEDUP_M = 8.0
RADIUS_MIN_M, RADIUS_MAX_M, RADIUS_SCALE = 200.0, 350.0, 10.0
BEARING_SIGMA_DEG, BEARING_MIN_M = 45.0, 5.0
PATH_BREAK = 1e-8
TINY = 1e-50
MAX_SPEED_MS = 50.0
MAX_POINTS, MAX_POINTS_VEHICLE = 150, 400
HOPS, DECAY, OBSERVED_BOOST = 3, 0.8, 1.5
TRIP_MIN_S, TRIP_MAX_S, TRIP_MIN_POINTS, TRIP_GAP_S = 60, 7200, 4, 300
TURN_DEG = 30.0
KNN_K, KNN_HOURS, KNN_KPH = 10, 2, 12.0
FALLBACK_SPEED_MS = 11.2
DEFAULT_CAP_MS = 20.0
KM_PER_DEG = 111.0

#: Metres per second assumed on a road class without observations.
DEFAULT_SPEED_MS = {
    "motorway": 29.1,
    "motorway_link": 22.4,
    "trunk": 20.1,
    "trunk_link": 15.6,
    "primary": 15.6,
    "primary_link": 13.4,
    "secondary": 13.4,
    "secondary_link": 11.2,
    "tertiary": 11.2,
    "tertiary_link": 11.2,
    "residential": 11.2,
    "living_street": 6.7,
    "service": 6.7,
    "unclassified": 11.2,
    "other": 11.2,
}

#: Metres per second above which an observation on a road class is dropped.
SPEED_CAP_MS = {
    "motorway": 42.0,
    "motorway_link": 30.0,
    "trunk": 30.0,
    "trunk_link": 25.0,
    "primary": 25.0,
    "primary_link": 22.0,
    "secondary": 22.0,
    "secondary_link": 20.0,
    "tertiary": 20.0,
    "tertiary_link": 20.0,
    "residential": 18.0,
    "living_street": 10.0,
    "service": 10.0,
    "unclassified": 20.0,
}

#: The bucket of the route features that a road class falls in.
CLASS_BUCKET = {
    "motorway": "motorway",
    "motorway_link": "motorway",
    "trunk": "trunk",
    "trunk_link": "trunk",
    "primary": "primary",
    "primary_link": "primary",
    "secondary": "secondary",
    "secondary_link": "secondary",
    "tertiary": "other",
    "tertiary_link": "other",
    "residential": "residential",
    "living_street": "residential",
    "service": "other",
    "unclassified": "other",
}
BUCKETS = ("motorway", "trunk", "primary", "secondary", "residential", "other")
