"""Scalar goldens and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadflow.functions import clock, geo
from roadflow.operators import matching, predict


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_emission_and_transition_values(spark):
    e0, e10, t0, t10 = one(spark, *[F.exp(matching.log_emission(F.lit(x))) for x in (0.0, 10.0)], *[F.exp(matching.log_transition(F.lit(x))) for x in (0.0, 10.0)])
    assert (e0, e10) == (pytest.approx(0.0980202163), pytest.approx(0.0047910194))
    assert (t0, t10) == (pytest.approx(0.3333333333), pytest.approx(0.0118913311))


def test_query_time(spark):
    ts = one(spark, clock.parse_query_time(F.lit("6/8/08 21:35")))[0]
    assert ts == 1212960900
    assert tuple(one(spark, clock.tod_bin(F.lit(ts)), clock.day_of_week(F.lit(ts)), clock.hour(F.lit(ts)))) == (43, 6, 21)


def test_bearing_wraps(spark):
    assert one(spark, geo.bearing_delta(F.lit(359.0), F.lit(1.0)))[0] == 2.0


def test_circular_hours(spark):
    assert tuple(one(spark, clock.circular_hours(F.lit(23), F.lit(1)), clock.circular_hours(F.lit(23), F.lit(2)))) == (2, 3)


def test_projection_is_clamped(spark):
    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(0.0).alias("lat")) for x in (0.0, 1.0, 2.0)])
    p = one(spark, geo.project(F.lit(0.5), F.lit(1.25), line).alias("a"), geo.project(F.lit(0.5), F.lit(9.0), line).alias("b"))
    assert (p.a.lat, p.a.lon) == (0.0, 1.25) and (p.b.lat, p.b.lon) == (0.0, 2.0)


def test_guard(spark):
    g = one(spark, predict.guard(F.lit(1.0), F.lit(10.0), F.lit(1.0), F.lit(1.0)), predict.guard(F.lit(None).cast("double"), F.lit(10.0), F.lit(1.0), F.lit(1.0)))
    assert g[0] == pytest.approx(6.4) and 0.5 <= g[1] <= 240


@settings(max_examples=15, deadline=None)
@given(st.tuples(*[st.floats(-80, 80)] * 4))
def test_haversine_is_symmetric(spark, c):
    a, b, z, bear = one(spark, geo.haversine_m(*map(F.lit, c)), geo.haversine_m(*map(F.lit, (c[2], c[3], c[0], c[1]))), geo.haversine_m(F.lit(c[0]), F.lit(c[1]), F.lit(c[0]), F.lit(c[1])), geo.bearing_deg(*map(F.lit, c)))
    assert math.isclose(a, b, abs_tol=1e-6) and a >= 0 and z == 0 and 0 <= bear < 360
