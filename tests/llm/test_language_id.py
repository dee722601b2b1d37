from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from fieldsonar.llm import language_id as G
from tests.llm.util import DATA, frame, no_rows, odd_rows


def test_query_and_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = G.op9_language_id(spark, str(DATA)).collect()
    assert len(got) == len(docs)
    right = total = 0
    for r in got:
        held = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1
        if held and docs[r.doc_id].lang:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right >= 0.95 * total


def test_odd_rows(spark):
    rows = odd_rows(1) + [(70, "der die das und nicht", "de", "s", 1), (71, "12345 !!", "en", "s", 1), (72, "the and of to", "en", "s", 1)]
    docs = frame(spark, rows, clash=True)
    langs, table = G.train(docs.where(~G.held_out()))
    got = G.language_id(docs, langs, table).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in got:
        if all(not any(c.isalpha() for c in t or "") for t in texts[r.doc_id]):
            assert r.lang_pred == "und" and r.score == 0
        elif len(texts[r.doc_id]) == 1:
            assert r.lang_pred in langs
    assert G.language_id(no_rows(spark), langs, table).collect() == []


def test_nothing_learned(spark):
    langs, table = G.train(no_rows(spark))
    assert langs == []
    assert {(r.lang_pred, r.score) for r in G.language_id(frame(spark, odd_rows(1)), langs, table).collect()} == {("und", 0.0)}


def test_held_back_rows_are_not_learned(spark):
    rows = [(i, f"word{i} text", "aa" if i % 2 else "bb", "s", 1) for i in range(40)]
    docs = frame(spark, rows)
    only = G.train(docs.where(~G.held_out()))
    changed = [(i, t if zlib.crc32(str(i).encode()) % 5 else "quite other", g, s, n) for i, t, g, s, n in rows]
    again = G.train(frame(spark, changed).where(~G.held_out()))
    assert only[0] == again[0] and (only[1] == again[1]).all()


def test_against_plain(spark):
    """The model and its scores by dictionaries: counts of n-grams of letters, additive smoothing, products of shares."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = ("aa", "bb", "cc")[i % 3]
        letters = {"aa": "abcde ", "bb": "cdefé ", "cc": "xyzab "}[lang]
        rows.append((i, "".join(rng.choice(letters + "1.") for _ in range(rng.randrange(1, 80))), lang, "s", 1))
    rows += [(100, None, "aa", "s", 1), (101, "no language", None, "s", 1), (102, "ABC abc", "aa", "s", 1), (102, "ABC abc", "aa", "s", 1)]

    def grams(text):
        c = re.sub(" +", " ", "".join(x.lower() if x.isalpha() else " " for x in (text or "") + "\n"))
        return [c[i : i + k] for k in G.ORDERS for i in range(len(c) - k + 1) if k > 1 or c[i] != " "]

    count, docs = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        if t is not None and lang is not None:
            docs[lang] += 1
            count[lang].update(grams(t))
    langs, table = G.train(frame(spark, rows, clash=True))
    assert langs == ["aa", "bb", "cc"]
    # but for a few n-grams that share a bucket, the plain model over n-grams is the hashed one over buckets
    sums = {x: sum(count[x].values()) for x in langs}
    for i, x in enumerate(langs):
        got = np.round(np.exp(table[: G.BUCKETS, i].astype(float)) * (sums[x] + G.SMOOTHING * G.BUCKETS) - G.SMOOTHING).astype(int)
        assert got.sum() == sums[x] and len(count[x]) - 3 <= (got > 0).sum() <= len(count[x])
        assert sum((Counter(got[got > 0].tolist()) & Counter(count[x].values())).values()) >= len(count[x]) - 6
        assert math.isclose(math.exp(table[G.BUCKETS, i]), (docs[x] + 1) / (sum(docs.values()) + len(langs)), rel_tol=1e-5)
    got = {(r.doc_id): (r.lang_pred, r.score) for r in G.language_id(frame(spark, rows), langs, table).collect()}
    for key, t, *_ in rows:
        odds = {x: math.log((docs[x] + 1) / (sum(docs.values()) + len(langs))) + sum(math.log((count[x][g] + G.SMOOTHING) / (sums[x] + G.SMOOTHING * G.BUCKETS)) for g in grams(t)) for x in langs}
        best = max(langs, key=lambda x: odds[x])
        if not any(c.isalpha() for c in t or ""):
            assert got[key] == ("und", 0.0)
        else:
            share = 1 / sum(math.exp(v - odds[best]) for v in odds.values())
            assert got[key][0] == best or share < 0.6
            assert abs(got[key][1] - share) < 0.02
