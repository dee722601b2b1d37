from __future__ import annotations

import random
from itertools import combinations

import pytest

from fieldsonar.llm import ngram_join as J
from fieldsonar.operators.components import components
from fieldsonar.storage import written
from tests.llm.util import frame, no_rows, odd_rows, prose, words


def shingles(text, width):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def plain(rows, m):
    sets = [shingles(r[1], m.width) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= m.percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0], root(i)) for i, (r, s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rng = random.Random(seed)
    rows, passage = odd_rows(5000), prose(rng, 6)
    for i in range(70):
        text = prose(rng, rng.randrange(4, 16))
        if i % 4 == 0:
            text = f"{passage} {text}"
        rows.append((i, text, "en", "s", 1))
    for i in range(110):  # copies, near copies around the limit, chains of near copies
        w = rng.choice(rows[len(odd_rows(5000)) :])[1].split(" ")
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"new{rng.randrange(999)}"]
        rows.append((100 + i, " ".join(w) if i % 9 else " ".join(w).upper(), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("width", "percent", "tile"), [(4, 85, 2048), (5, 80, 8)])
def test_against_all_pairs(spark, monkeypatch, width, percent, tile):
    monkeypatch.setattr(J, "TILE", tile)
    m, rows = J.Measure(width, percent), corpus(width)
    got = J.linked(frame(spark, rows, clash=True), m).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc, r.n, r.component) for r in got), key=key) == sorted((x[:3] for x in plain(rows, m)), key=key)


def test_one_of_each(spark):
    m, rows = J.Measure(5, 80), corpus(2)
    got = J.one_of_each(frame(spark, rows, clash=True), m)
    assert "node" in got.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got.collect())
    want = {}
    for r, (doc, n, comp, root) in zip(rows, plain(rows, m)):
        if n == 0:
            want.setdefault(("own", len(want)), r)
        elif doc == comp:
            want.setdefault(root, r)
    assert len(ids) == len(want)
    assert {i for i in ids if i[2]} <= {(r[0] is not None, r[0] or 0, r[1] or "") for r in rows}


def test_empty(spark):
    assert J.linked(no_rows(spark), J.Measure(4, 85)).collect() == []
    assert J.one_of_each(no_rows(spark), J.Measure(4, 85)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)] + [(500, x) for x in range(501, 540)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_jobs(spark):
    """Whether a round changed anything is observed while it is written, without a scan and jobs of its own."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(9, 9), (90, 80)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = components(edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {r.node: r.label for r in got.collect()} == {**dict.fromkeys(range(41), 0), 80: 80, 90: 80}
    assert jobs <= 60


def test_grown_components(spark):
    first = components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long"))
    more = written(spark.createDataFrame([(3, 11), (30, 31), (5, 5)], "a long, b long"), "more")
    got = {r.node: r.label for r in J._grown(first, more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 30, 31: 30}
    none = written(spark.createDataFrame([], "a long, b long"), "more")
    assert {r.node: r.label for r in J._grown(first, none).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}
    assert components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []
