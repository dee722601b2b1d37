from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldsonar.llm import periodic_runs as P
from tests.llm.util import DATA, frame, no_rows, odd_rows, prose, words


def plain_runs(w):
    """By the definition: every stretch that no neighbour extends, under its smallest period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(key, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(key).encode())
    g = h // 10
    if key is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def both(w):
    ids = np.array(w, np.int64)
    first = np.array([0, len(w)])
    return P.runs_of(ids, P.proposed_lags(ids, first)[0])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_few_words(w):
    assert both(w) == plain_runs(w)


def test_nested_and_touching_runs():
    rng = random.Random(2)
    for _ in range(300):
        w: list[int] = []
        while len(w) < 150:
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            unit = unit * rng.choice((1, 1, 5)) + [rng.randrange(50)] * rng.randrange(2)
            w += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
        assert both(w) == plain_runs(w)


def test_texts_of_a_chunk_stay_apart():
    rng = random.Random(5)
    texts = [[rng.randrange(4)] * rng.randrange(0, 9) + [7, 8] * rng.randrange(0, 5) for _ in range(200)]
    first = np.cumsum([0, *map(len, texts)])
    lags = P.proposed_lags(np.array([x for t in texts for x in t], np.int64), first)
    assert [P.runs_of(np.array(t, np.int64), q) for t, q in zip(texts, lags)] == [plain_runs(t) for t in texts]


def test_long_texts_take_time_in_proportion():
    rng = np.random.default_rng(1)
    n = 400_000
    fibonacci = [0]
    other = [0, 1]
    while len(other) < n:
        fibonacci, other = other, other + fibonacci
    hostile = {
        "one word": np.zeros(n, np.int64), "long period": np.tile(np.arange(n // 5), 5), "two words": rng.integers(0, 2, n), "fibonacci": np.array(other[:n]),
        "many periods": np.concatenate([np.tile(rng.integers(0, 9, q), 4) for q in range(1, 440)]), "sixes": np.tile(np.concatenate([np.tile([1, 2, 3, 4, 5, 6], 5), [9]]), n // 31),
    }
    for name, ids in hostile.items():
        began = time.perf_counter()
        runs = both(ids)
        assert time.perf_counter() - began < 20, name
        if name == "one word":
            assert runs == [(0, n, 1)]
        if name == "long period":
            assert runs == [(0, n, n // 5)]


def test_against_plain(spark):
    rng = random.Random(7)
    rows = [r for r in odd_rows(5000) if len(r[1] or "") < 50_000]
    rows += [(None, "no key but a a a a a a a", "en", "s", 1)]
    for i in range(120):
        text = prose(rng, rng.randrange(1, 8))
        if i % 3 == 0:
            text += " " + "\n".join([prose(rng, 1)] * rng.randrange(2, 9))
        if i % 4 == 0:
            text += " no" * rng.randrange(4, 9) + "\x0b\x00  x"
        rows.append((i, text, "en", "s", 1))
    rows += rows[-2:]
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in P.periodic_runs(frame(spark, rows, clash=True), plant=True).collect()]
    assert sorted(got, key=key) == sorted(((r[0], *plain(r[0], r[1])) for r in rows), key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) and any(r[1] for r in got)


def test_collapsed_text(spark):
    got = P.periodic_runs(frame(spark, [(3, "so it is\nit is it is it is it is done", "en", "s", 1)])).collect()[0]
    assert (got.collapsed, got.n_runs, got.start, got.length, got.period) == ("so it is done", 1, 1, 10, 2)


def test_empty_table(spark):
    assert P.periodic_runs(no_rows(spark)).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in P.op11_periodic_runs(spark, str(DATA)).collect()}
    assert got.keys() == docs.keys()
    for k in [k for k in docs if len(docs[k]) < 12_000]:
        assert got[k] == plain(k, docs[k])
