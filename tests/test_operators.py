"""Time joins, events, sites and maps against plain versions on random rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldsonar.operators.numbering import numbered
from fieldsonar.operators import events, mapping, sessions, sites, timejoin


def rows_of(seed, n=400, blocks=5, span=3000):
    rng = random.Random(seed)
    return [(i, rng.randrange(1, 5), rng.randrange(blocks), rng.randrange(span) * 1_000_000, rng.randrange(50) / 10, rng.randrange(30) / 100) for i in range(n)]


COLS = "row_id long, site_id int, block long, t long, peak_time_s double, abs_tdoa_ms double"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS).repartition(3)


@pytest.mark.parametrize("bucket_s", [None, 500.0])
def test_nearest(spark, bucket_s):
    rng = random.Random(1)
    a = [(i, rng.randrange(3), rng.randrange(4000) * 500_000) for i in range(300)]
    b = [(i, rng.randrange(3), rng.randrange(4000) * 500_000) for i in range(200)]
    left, right = spark.createDataFrame(a, "i long, g int, t long"), spark.createDataFrame(b, "j long, g int, t long")
    got = {r.i: (r.t_b, r.j_b) for r in timejoin.nearest(left, right, ["g"], 20.0, payload=["j"], bucket_s=bucket_s).collect()}
    want = {}
    for i, g, t in a:
        near = [(abs(u - t), u, j) for j, h, u in b if h == g and abs(u - t) <= 20_000_000]
        if near:
            want[i] = min(near)[1:]
    assert got == want


def test_nearest_edges(spark):
    one = spark.createDataFrame([(1, 0, 100_000_000)], "i long, g int, t long")
    two = spark.createDataFrame([(1, 0, 90_000_000), (2, 0, 110_000_000)], "j long, g int, t long")
    assert timejoin.nearest(one, two, ["g"], 10.0, payload=["j"]).first().j_b == 1  # a tie: the earlier; the limit counts
    assert timejoin.nearest(one, two, ["g"], 9.9).collect() == []
    assert timejoin.nearest(one.limit(0), two, ["g"], 1.0).collect() == []
    assert timejoin.nearest(one, two.limit(0), ["g"], 1.0).collect() == []


def test_pair_tables(spark):
    rows = rows_of(2)
    got = timejoin.pair_alignment(frame(spark, rows), 60.0).collect()
    for r in got:
        d = []
        times = sorted(x[3] for x in rows if x[1] == r.site_b)
        for x in rows:
            if x[1] == r.site_a:
                near = min(abs(u - x[3]) for u in times)
                if near <= 60_000_000:
                    d.append(near / 1e6)
        assert (r.n_matches, r.median_delta_s, r.max_delta_s, r.min_delta_s) == (len(d), np.median(d), max(d), min(d))
    assert [(-r.n_matches, r.median_delta_s) for r in got] == sorted((-r.n_matches, r.median_delta_s) for r in got)
    wide = timejoin.pair_matrix(timejoin.pair_alignment(frame(spark, rows), 60.0), [1, 2, 3, 4, 9])
    m = {r.site_id: r.asDict() for r in wide.collect()}
    assert all(m[s][str(s)] == 0 for s in m) and all(m[a][str(b)] == m[b][str(a)] for a in m for b in m) and not any(m[9][str(s)] for s in m)
    assert timejoin.pair_alignment(frame(spark, rows).where("site_id = 1")).collect() == []


def test_clock_offsets(spark):
    rng = random.Random(3)
    base = [rng.randrange(3_000_000_000) for _ in range(120)]
    rows = [(i, 1, t // 600_000_000, t, 0.0, 0.1) for i, t in enumerate(base)]
    rows += [(1000 + i, 2, t // 600_000_000, t + 2_500_000, 0.0, 0.1) for i, t in enumerate(base[:100])]
    rows += [(5000, 3, 999, 5, 0.0, 0.1)]
    got = {r.other_site_id: r for r in timejoin.clock_offsets(frame(spark, rows), "block").collect()}
    assert got.keys() == {2, 3} and got[2].reference_site_id == 1
    assert got[2].applied_correction_s == pytest.approx(-2.5) and got[2].mad_delta_s == pytest.approx(0, abs=2)
    assert (got[3].n_matches, got[3].applied_correction_s, got[3].mad_delta_s, got[3].p10_delta_s) == (0, 0.0, None, None)
    fixed = timejoin.with_offsets(frame(spark, rows), timejoin.clock_offsets(frame(spark, rows), "block"))
    assert {(r.site_id, r.t_corrected - r.t) for r in fixed.select("site_id", "t", "t_corrected").collect()} == {(1, 0), (2, -2_500_000), (3, 0)}


def test_weighted_median(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(20)), float(rng.randrange(1, 5))) for g in range(4) for _ in range(30)]
    got = {r.g: r.weighted_median for r in timejoin.weighted_median(spark.createDataFrame(rows, "g int, v double, w double"), ["g"], "v", "w").collect()}
    for g in got:
        mine = sorted((v, w) for h, v, w in rows if h == g)
        total, run = sum(w for _, w in mine), 0.0
        for v, w in mine:
            run += w
            if run >= total / 2:
                assert got[g] == v
                break


def plain_events(rows, most, exclusive):
    out, blocks = [], defaultdict(list)
    for r in rows:
        blocks[r[2]].append(r)
    number = 0
    for b in sorted(blocks):
        by = defaultdict(list)
        for r in blocks[b]:
            by[r[1]].append(r)
        for s in by:
            by[s].sort(key=lambda r: (r[4], -r[5], r[0]))
        if len(by) < 2:
            continue
        anchor = min(by, key=lambda s: (-len(by[s]), s))
        m, found = len(by[anchor]), []
        for i in range(m):
            pick = [by[s][i if s == anchor else 0 if m <= 1 or len(by[s]) <= 1 else round(i / (m - 1) * (len(by[s]) - 1))] for s in by]
            found.append((-len(pick), -round(sum(p[5] for p in pick), 9), min(p[3] for p in pick), i, pick))
        used, taken = set(), 0
        for *_, pick in sorted(found, key=lambda f: f[:4]):
            ids = {p[0] for p in pick}
            if exclusive and ids & used:
                continue
            used |= ids
            out += [(number, p[1], p[0]) for p in pick]
            number, taken = number + 1, taken + 1
            if taken == most:
                break
    return sorted(out)


@pytest.mark.parametrize("exclusive", [False, True])
def test_build_events(spark, exclusive):
    rows = rows_of(5, 300, 12) + [(9000, 1, 77, 5, 0.0, 0.1), (9001, 1, 78, 5, 0.0, 0.1), (9002, 2, 78, 5, 0.0, 0.1)]
    got = sorted((r.event_id, r.site_id, r.row_id) for r in events.build_events(frame(spark, rows), 4, exclusive=exclusive).collect())
    assert got == plain_events(rows, 4, exclusive)
    assert events.build_events(frame(spark, rows).limit(0)).collect() == []


def plain_anchors(times, width):
    out, anchor = {}, None
    for t in sorted(times):
        if anchor is None or t - anchor > width:
            anchor = t
        out[t] = anchor
    return out


@pytest.mark.parametrize("width_s", [0.5, 30.0, 4000.0])
def test_anchored_sessions(spark, width_s):
    rng = random.Random(int(width_s))
    rows = [(i, rng.randrange(1, 5), 0, rng.choice((rng.randrange(40_000), 90_000 + rng.randrange(200))) * 300_000, 0.0, 0.1) for i in range(500)]
    df, width = frame(spark, rows), int(width_s * 1e6)
    want = plain_anchors({r[3] for r in rows}, width)
    assert {(r.row_id, r.anchor) for r in events.anchored_sessions(df, width).collect()} == {(r[0], want[r[3]]) for r in rows}
    sites_of = defaultdict(set)
    for r in rows:
        sites_of[want[r[3]]].add(r[1])
    assert events.multi_site_events(df, (width,), []).first().n_events == sum(len(s) >= 2 for s in sites_of.values())
    top = events.provisional_events(df, width, 3).collect()
    assert [(r.n_sites, r.anchor) for r in top] == [(n, a) for n, a in sorted(((len(s), a) for a, s in sites_of.items()), key=lambda x: (-x[0], x[1]))[:3]]


@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(0, 12), st.data())
@settings(max_examples=300, deadline=None)
def test_anchor_maps_compose(times, width, data):
    """Pieces' maps, composed in any grouping, give the anchors of the whole."""
    times = np.array(sorted(times), np.int64)
    want = plain_anchors(times.tolist(), width)
    cuts = sorted({0, len(times), *data.draw(st.lists(st.integers(0, len(times)), max_size=5))})
    whole, anchor = sessions.AnchorMap(width), sessions.BEFORE
    for a, b in itertools.pairwise(cuts):
        assert sessions.anchors_of(times[a:b], width, anchor).tolist() == [want[t] for t in times[a:b].tolist()]
        piece = sessions.AnchorMap.of_times(width, times[a:b])
        whole = whole.then(piece)
        anchor = int(piece(np.array([anchor]))[0])
        assert anchor == want[times[b - 1]] == int(whole(np.array([sessions.BEFORE]))[0])


@pytest.mark.parametrize("width_s, ranges", [(0.5, 9), (30.0, 9), (30.0, 1), (4000.0, 9)])
def test_sessions_over_ranges(spark, monkeypatch, width_s, ranges):
    """One dense stretch and many small groups, in small pieces and many tasks."""
    monkeypatch.setattr(sessions, "PIECE_ROWS", 37)
    rng, width = random.Random(3), int(width_s * 1e6)
    rows = [(i, "dense", rng.randrange(1, 5), rng.randrange(9_000_000) * 1000) for i in range(1500)] + [(9000 + i, None, 1, i * 7_000_000) for i in range(60)]
    rows += [(2000 + i, f"g{i % 150}", rng.randrange(1, 5), rng.randrange(3000) * 500_000) for i in range(900)] + [(9999, "dense", 1, None)]
    df = spark.createDataFrame(rows, "row_id long, block string, site_id int, t long").repartition(5)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(ranges)}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.row_id: r.anchor for r in events.anchored_sessions(df, width, ["block"]).collect()}
        counts = {(r.block, r.width_us): r.n_events for r in events.multi_site_events(df, (width, 2 * width), ["block"]).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want, sites = {}, defaultdict(set)
    for block in {r[1] for r in rows}:
        for w in (width, 2 * width):
            anchors = plain_anchors({r[3] for r in rows if r[1] == block and r[3] is not None}, w)
            for r in rows:
                if r[1] == block and r[3] is not None:
                    sites[block, w, anchors[r[3]]].add(r[2])
                    if w == width:
                        want[r[0]] = anchors[r[3]]
    assert got == want
    n_events = {(block, w): sum(len(s) >= 2 for (b, v, _), s in sites.items() if (b, v) == (block, w)) for block, w, _ in sites}
    assert counts == n_events


def test_long_stretch_in_seconds():
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 10**9, 2_000_000))
    pieces = [t[i : i + 20_000] for i in range(0, len(t), 20_000)]
    whole = sessions.AnchorMap(5_000_000)
    for p in pieces:
        whole = whole.then(sessions.AnchorMap.of_times(5_000_000, p))
    assert int(whole(np.array([sessions.BEFORE]))[0]) == sessions.anchors_of(t, 5_000_000, sessions.BEFORE)[-1] and len(whole.entry) <= 11_000


@pytest.mark.parametrize("swept", [100_000, 16])
def test_pairs_within(spark, monkeypatch, swept):
    """All pairs of sites in one sweep, also in small steps; equal times, ties, empty stretches, and a bucket with most rows."""
    monkeypatch.setattr(timejoin, "SWEPT_ROWS", swept)
    rng = random.Random(swept)
    rows = [(i, rng.choice("abcdef"), rng.choice((rng.randrange(-40, 4000), rng.randrange(400, 460))) * 500_000) for i in range(700)] + [(9000, None, 5), (9001, "a", None)]
    df = spark.createDataFrame(rows, "row_id long, s string, t long").repartition(4)
    got = sorted((r.row_id, r.site_a, r.site_b, r.t, r.row_id_b, r.t_b, r.delta_us) for r in timejoin.pairs_within(df, 10.0, ["row_id"], "s").collect())
    of = defaultdict(list)
    for i, s, t in rows:
        if s and t is not None:
            of[s].append((t, i))
    want = []
    for i, s, t in rows:
        for other in sorted(of):
            if s and t is not None and other > s:
                gap, when, row = min((abs(u - t), u, j) for u, j in of[other])
                if gap <= 10_000_000:
                    want.append((i, s, other, t, row, when, when - t))
    assert got == sorted(want)
    assert timejoin.pairs_within(df.limit(0), 10.0, ["row_id"], "s").collect() == []


@pytest.mark.parametrize("bins", [1 << 18, 64])
def test_quantiles(spark, monkeypatch, bins):
    """Groups of all sizes and signs, one with most rows; few counts a round make many rounds."""
    from fieldsonar.operators import quantiles as Q

    monkeypatch.setattr(Q, "BINS", bins)
    rng = random.Random(bins)
    groups = {"hot": [rng.gauss(405_640, 30) for _ in range(3000)], "one": [7.5], None: [0.0, -0.0, 3.0], "same": [2.0] * 50, "wide": [rng.choice((-1, 1)) * 10.0 ** rng.randrange(-300, 300) for _ in range(200)], "two": [-1e-9, 1e-9], "far": [float("-inf"), 1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("nan", float("nan")), ("one", float("nan"))]
    rng.shuffle(rows)
    shares = {"middle": 0.5, "tenth": 0.1, "ninth": 0.9, "low": 0.0, "high": 1.0}
    got = {r.g: r for r in Q.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"], "x", shares).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        for name, share in shares.items():
            with np.errstate(invalid="ignore"):
                assert got[g][name] == pytest.approx(np.quantile(xs, share), rel=1e-12) or np.isnan(np.quantile(xs, share))
    whole = [(i % 5, rng.randrange(-10**12, 10**12)) for i in range(2000)]
    got = {r.g: r.middle for r in Q.quantiles(spark.createDataFrame(whole, "g int, x long"), ["g"], "x", {"middle": 0.5}, 1e6).collect()}
    assert got == {g: pytest.approx(np.median([x for h, x in whole if h == g]) / 1e6, rel=1e-12) for g in range(5)}


def points_of(seed, n=90):
    rng = random.Random(seed)
    return [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(n)]


def plain_clusters(points, radius):
    up = {p[0]: p[0] for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x, y in points:
        for b, u, v in points:
            if a < b and (x - u) ** 2 + (y - v) ** 2 <= radius * radius:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {p[0]: root(p[0]) for p in points}


def test_dense_clusters(spark):
    """Tens of thousands of points within a few radii, in two groups a hair apart, and lines along the edges of cells."""
    rng = np.random.default_rng(4)
    left, right = rng.uniform((0, 0), (20, 20), (20_000, 2)), rng.uniform((22.51, 0), (40, 20), (20_000, 2))
    line = np.stack([np.arange(40) * 2.5 + 100, np.zeros(40)], axis=1)
    loose = np.stack([np.arange(40) * 2.5000001 + 300, np.zeros(40)], axis=1)
    rows = [(i, float(px), float(py)) for i, (px, py) in enumerate(np.concatenate([left, right, line, loose]))]
    got = {r.id: r.cluster for r in sites.clusters(spark.createDataFrame(pd.DataFrame(rows, columns=["id", "x", "y"])), 2.5).collect()}
    gap = (right[:, 0].min() - left[:, 0].max()) > 2.5
    assert gap and {got[i] for i in range(20_000)} == {0} and {got[i] for i in range(20_000, 40_000)} == {1}
    assert {got[i] for i in range(40_000, 40_040)} == {2} and [got[i] for i in range(40_040, 40_080)] == list(range(3, 43))


def test_clusters_and_sweep(spark):
    points = points_of(6) + [(500, 1.0, 1.0), (501, 1.0, 1.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r.id: r.cluster for r in sites.clusters(df, 12.0).collect()}
    want = plain_clusters(points, 12.0)
    assert len(Counter(got.values())) == len(set(want.values()))
    order = {r: i for i, r in enumerate(sorted(set(want.values())))}
    assert got == {i: order[r] for i, r in want.items()}
    sweep = sites.radius_sweep(df, 6, low=1.0, high=9.0, step=2.0)
    assert {(r.radius_m, r.n_clusters) for r in sweep.collect()} == {(w, len(set(plain_clusters(points, w).values()))) for w in (1.0, 3.0, 5.0, 7.0, 9.0)}
    best = sites.chosen_radius(sweep, 60).first()
    assert (best.radius_m, best.n_clusters) == min(((r.radius_m, r.n_clusters) for r in sweep.collect()), key=lambda r: (abs(r[1] - 60), r[0]))


def test_site_join_wants_unique_sites(spark):
    d = spark.createDataFrame([(1, "a", None, 1.0, 2.0), (1, "a", None, 3.0, 4.0), (2, "b", "c", 400000.0, 100000.0)], "site_id int, LON string, LAT string, easting_m double, northing_m double")
    s = sites.site_summary(d)
    r = {x.site_id: x for x in s.collect()}
    assert (r[1].n_detections, r[1].n_unique_locations, r[1].canonical_easting_m) == (2, 1, 2.0)
    assert sites.with_sites(d, s).count() == 3
    with pytest.raises(ValueError):
        sites.with_sites(d, s.unionByName(s))


def test_maps(spark):
    rec = spark.createDataFrame([(1, -1.92, 50.94), (2, -1.925, 50.941)], "site_id int, lon double, lat double")
    drawn = mapping.canvas(mapping.bounds(rec))
    c = drawn.first()
    tiles = mapping.tiles(drawn).collect()
    assert len(tiles) == (c.canvas_width // 256) * (c.canvas_height // 256) and tiles[0].url.startswith("https://tile.openstreetmap.org/")
    for r in mapping.on_canvas(rec, drawn).collect():
        assert 0 <= r.canvas_x <= c.canvas_width and 0 <= r.canvas_y <= c.canvas_height
    same = mapping.bounds(rec.where("site_id = 1")).first()
    assert same.lon_max - same.lon_min == pytest.approx(5e-5)


def test_forest_over_many_cells(spark):
    """The sweep against union-find at every radius, where clusters reach over cells of several levels."""
    rng = np.random.default_rng(6)
    chain = [(float(i) * 1.7, 3.0 * (i % 2)) for i in range(400)]
    cloud = [tuple(map(float, p)) for p in rng.uniform(0, 300, (250, 2)).round(1)]
    points = list(enumerate([*chain, *cloud, (0.0, 0.0), (0.0, 0.0), (-500.0, 900.0)]))
    df = spark.createDataFrame([(i, *p) for i, p in points], "id long, x double, y double")
    got = {r.radius_m: r.n_clusters for r in sites.radius_sweep(df, 3, low=1.0, high=9.0, step=0.5).collect()}
    at = np.array([p for _, p in points])
    apart = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    for radius, n in got.items():
        up = list(range(len(at)))

        def root(i, up=up):
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, j in zip(*np.nonzero(apart <= radius)):
            up[root(int(i))] = root(int(j))
        assert n == len({root(i) for i in range(len(at))}), radius


def test_numbers_in_order(spark):
    keys = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id % 3 AS s").repartition(7)
    got = numbered(keys, "k", "at").collect()
    assert sorted((r.k, r["at"]) for r in got) == [(i, i) for i in range(1000)]
    sums, total = {r.k: r.before for r in numbered(keys, "k", "before", "s").collect()}, 0
    for r in sorted(keys.collect(), key=lambda r: r.k):
        assert sums[r.k] == total
        total += r.s
    assert numbered(keys.limit(0), "k", "at").collect() == []


def test_candidates_of_all_counts_without_a_join_by_rank(spark):
    """Ranks mapped to every pair of counts, halves to even; candidate rows are made where the ranked rows are, never broadcast."""
    rows, want = [], set()
    for block, (m, n) in enumerate((m, n) for m in range(1, 24) for n in range(1, m + 1)):
        for site, count in ((1, m), (2, n)):
            rows += [(block, site, float(i), 0.1, i, block * 1000 + site * 100 + i) for i in range(count)]
        for i in range(m):
            # as in the SQL: a quotient, a product, and then the even one of two as near
            want |= {(block, i, 1, block * 1000 + 100 + i), (block, i, 2, block * 1000 + 200 + (round(i / (m - 1) * (n - 1)) if m > 1 and n > 1 else 0))}
    rows += [(900, 1, 0.0, 0.1, 0, 1), (None, 1, 0.0, 0.1, 0, 2), (None, 2, 0.0, 0.1, 0, 3)]  # a block of one site, and none
    df = spark.createDataFrame(rows, "block long, site_id int, peak_time_s double, abs_tdoa_ms double, t long, row_id long")
    got = events.candidates(df).select("block", "anchor_idx", "site_id", "row_id", "n_sites")
    assert sorted(map(tuple, got.collect())) == sorted((*w, 2) for w in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert joins and not any("rank" in line for line in joins)
    assert not any("Broadcast" in line and "site_id" in line.split("Join")[1] for line in joins)


def test_sweep_of_dense_points(spark):
    """Thousands of points within one radius, copies of them, a gap between two dense groups that only some radii close, and points without a place."""
    rng = np.random.default_rng(8)
    left, right = rng.uniform((0, 0), (10, 10), (6_000, 2)), rng.uniform((13.3, 0), (20, 10), (6_000, 2))
    grid = np.stack(np.meshgrid(np.arange(12) * 2.5 - 200, np.arange(12) * 3.0), axis=-1).reshape(-1, 2)
    at = np.concatenate([left, right, grid, left[:3000], [[np.nan, 1.0], [np.inf, 2.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1]}))
    df = df.unionByName(spark.createDataFrame([(len(at), None, 1.0)], "id long, x double, y double"))
    got = {r.radius_m: r.n_clusters for r in sites.radius_sweep(df, 3, low=1.0, high=8.0, step=0.25).collect()}
    # the nearest places on either side, by the few near the gap
    a, b = left[left[:, 0] > 9.5], right[right[:, 0] < 13.8]
    gap = float(np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)).min())
    assert len(got) == 29 and 3.3 < gap < 4
    for radius, n in got.items():
        assert n == 3 + (2 if radius < gap else 1) + (144 if radius < 2.5 else 12 if radius < 3 else 1), radius
