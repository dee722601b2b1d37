from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldsonar.functions import maps, scalars


def one(spark, column, **values):
    kinds = {float: "double", int: "int", str: "string", list: "array<double>"}
    ddl = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl or "x int").select(column).first()[0]


def test_recorder_number(spark):
    c = F.col("f")
    assert one(spark, scalars.recorder_number(c), f="Recorder   12 - 1004 to 1704") == 12
    assert one(spark, scalars.recorder_number(c, strict=False), f="no") is None
    assert one(spark, scalars.recorder_number(c, strict=False), f=None) is None
    with pytest.raises(Exception, match="recorder number"):
        one(spark, scalars.recorder_number(c), f="no")


def test_coordinate(spark):
    c = F.col("v")
    for text, want in {"1.92444W": -1.92444, " 50.93976n ": 50.93976, "3e": 3.0, "7.5S": -7.5}.items():
        assert one(spark, scalars.coordinate(c), v=text) == want
    for bad in ("", "W", "12", "xW", None):
        assert one(spark, scalars.coordinate(c, strict=False), v=bad) is None
    with pytest.raises(Exception, match="coordinate"):
        one(spark, scalars.coordinate(c), v="12Q")


def test_recording_start(spark):
    got = lambda d, t: one(spark, scalars.recording_start(F.col("d"), F.col("t")), d=d, t=t)
    assert got("04-13-2026", "06:40:00") == dt.datetime(2026, 4, 13, 6, 40)
    assert got("13-04-2026", "6:4:0") == dt.datetime(2026, 4, 13, 6, 4)
    assert got("03-04-2026", "00:00:01") == dt.datetime(2026, 3, 4, 0, 0, 1)  # month first
    assert got("31-31-2026", "00:00:00") is None and got(None, "1:1:1") is None


def test_time_is_absolute_across_a_clock_change(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        start = scalars.recording_start(F.lit("03-29-2026"), F.lit("00:30:00"))
        later = F.date_format(scalars.plus_seconds(start, F.lit(3600.0)), "HH:mm")
        assert one(spark, later, x=1) == "02:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unusable_delays(spark):
    rows = spark.createDataFrame([(0.025,), (-0.03,), (0.0249,), (float("nan"),), (None,)], "t double")
    assert [r.t for r in rows.where(scalars.usable_tdoa(F.col("t"))).collect()] == [0.025, -0.03]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=30))
def test_angles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    tau = F.col("a") / 1e7
    out = df.select("a", scalars.wrap_degrees(F.col("a")).alias("w"), scalars.bearing_1(tau).alias("b1"), scalars.bearing_2(tau).alias("b2"), scalars.tdoa_weight(F.abs("a") / 1e4).alias("wt")).collect()
    for r in out:
        assert -180 <= r.w < 180 and abs(math.sin(math.radians(r.w - r.a))) < 1e-9
        assert 0 <= r.b1 < 360 and 0 <= r.b2 < 360 and min((r.b1 + r.b2 - 180) % 360, (180 - r.b1 - r.b2) % 360) < 1e-6
        assert 0.05 <= r.wt <= 1


def test_bearing_between(spark):
    for (x, y), want in {(0.0, 1.0): 0, (1.0, 0.0): 90, (0.0, -1.0): 180, (-1.0, 0.0): 270}.items():
        assert one(spark, scalars.bearing_between(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y")), x=x, y=y) == pytest.approx(want)


def test_geometry(spark):
    g = scalars.geometry_score(F.col("b"))
    assert one(spark, g, b=[10.0]) == 0
    assert one(spark, g, b=[10.0, 100.0]) == pytest.approx(1)
    assert one(spark, g, b=[0.0, 90.0, 30.0]) == pytest.approx(0.5)


@pytest.mark.parametrize("m", range(1, 9))
def test_mapped_rank(spark, m):
    rows = [(i, m, n) for i in range(m) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "i int, m int, n int")
    for r in df.select("*", scalars.mapped_rank(F.col("i"), F.col("m"), F.col("n")).alias("got")).collect():
        assert r.got == (0 if m <= 1 or r.n <= 1 else round(r.i / (m - 1) * (r.n - 1)))


def test_quality(spark):
    q = scalars.quality_pass(F.col("r"), F.col("g"), F.col("n"), F.col("m"))
    assert one(spark, q, r=18.0, g=0.18, n=2, m=0.0) is True
    assert one(spark, q, r=18.0, g=0.18, n=3, m=0.19) is False
    assert one(spark, q, r=18.1, g=0.9, n=3, m=1.0) is False
    assert one(spark, q, r=1.0, g=0.17, n=2, m=1.0) is False


def test_zoom_and_destination(spark):
    assert one(spark, maps.best_zoom(F.lit(-180.0), F.lit(-85.0), F.lit(180.0), F.lit(85.0)), x=1) == 3
    assert one(spark, maps.best_zoom(F.lit(0.0), F.lit(0.0), F.lit(1e-6), F.lit(1e-6)), x=1) == 18
    lon, lat = maps.destination(F.lit(179.999), F.lit(0.0), F.lit(90.0), F.lit(1000.0))
    assert one(spark, lon, x=1) == pytest.approx(-179.992, abs=1e-3) and one(spark, lat, x=1) == pytest.approx(0, abs=1e-9)


def test_formats(spark):
    assert one(spark, scalars.joined_bearings(F.col("b")), b=[1.0, 359.98765]) == "1.000|359.988"
    assert one(spark, scalars.channels_text(F.array(F.lit("right"), F.lit("left"))), x=1) == "left,right"
