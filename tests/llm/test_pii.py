from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from fieldsonar.llm import pii_crf as P
from tests.llm.util import DATA, frame, no_rows, odd_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400)
@given(st.text(alphabet="ab@.-+ ()0145", max_size=50))
def test_base_spans(text):
    assert P.base_spans(text) == plain(text)


def test_fixed_cases():
    text = "x a@b.c.d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 +1 (743) 555-3824 4111 1111 1111 1111 4785380592391139 +12 3"
    assert P.base_spans(text) == plain(text)
    assert P.base_spans("9" * 50_000 + "a@" * 2_000) == []  # no quadratic time


def test_long_runs_of_digits():
    assert P.base_spans("1.2.3." + "0" * 5000) == [(0, 1, 5006)] and P.base_spans("1.2.3." + "0" * 5000 + "256") == []
    assert P.base_spans("1.2.3.000000255") == plain("1.2.3.000000255")


def test_time_is_in_proportion():
    field, rng = P.trained(), random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    began = time.perf_counter()
    P.find(hexes(1_000_000), field)
    P.find(" ".join(hexes(40) for _ in range(25_000)), field)
    P.find("@" * 200_000, field)
    assert time.perf_counter() - began < 30


def test_recall_and_precision_by_kind():
    """On generated sentences that the field has not learned from."""
    field, right, found, there = P.trained(), Counter(), Counter(), Counter()
    based = Counter()
    for text, spans in P._sentences(random.Random(999), 1500):
        gold = {(s, y - 1, e) for s, y, e in spans}
        base, every = P.find(text, field)
        for k in range(4):
            of = lambda xs: {x for x in xs if x[1] == k}  # noqa: B023, E731
            right[k] += len(of(every) & of(gold))
            based[k] += len(of(base) & of(gold))
            found[k] += len(of(every))
            there[k] += len(of(gold))
    for k in range(4):
        assert right[k] >= 0.97 * there[k] and right[k] >= 0.95 * found[k]
    assert right[0] > 1.5 * based[0] and right[3] > 1.3 * based[3]  # what the patterns alone do not see


def test_planted_documents():
    """Personal data that the test tables have is found by its own kind."""
    field = P.trained()
    for text, kind in (("Reach x.y@example.com now", 0), ("from 10.1.2.3 port", 1), ("card 4111 1111 1111 1111 ok", 2), ("dial +1 (743) 555-3824 x", 3)):
        assert [k for _, k, _ in P.find(text, field)[1]] == [kind]


def test_field_adds_and_spares():
    field = P.trained()
    added = lambda t: [(P.KINDS[k], t[s:e]) for s, k, e in P.find(t, field)[1] if (s, k, e) not in P.find(t, field)[0]]
    assert added("call me at (743) 555-3824 today") == [("phone", "(743) 555-3824")]
    assert added("mail bob (at) example (dot) com please") == [("email", "bob (at) example (dot) com")]
    assert added("cards 4465758382889437 4465758382889437 are one run") == [("card", "4465758382889437")] * 2
    for clean in ("on 2024-01-02 at 12:30", "version 1.2.3 page 12", "sum 1,234.50", "x 400.1.2.3 y", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "no numbers here", "a 12 345 67 b"):
        assert added(clean) == []


def test_decoding_is_best():
    """The dynamic program against all segmentations of short regions."""
    field = P.trained()
    for text in ("a 555-123-4567 b", "z at 10.20.30.40 x", "12 34 56"):
        x = P.Lattice(text, 0, len(text))
        n = len(x.tokens)
        arcs = {j: [(i, f, range(1, 5)) for i, f in x.by_end[j]] + [(j - 1, x.outside[j - 1], range(1))] for j in range(1, n + 1)}

        def best(j, y, arcs=arcs, memo={}):  # noqa: B006
            if j == 0:
                return (0.0, []) if y == 0 else (float("-inf"), [])
            if (id(arcs), j, y) in memo:
                return memo[id(arcs), j, y]
            options = []
            for i, f, labels in arcs[j]:
                if y in labels:
                    for p in range(5):
                        s, path = best(i, p)
                        options.append((s + field.t[p, y] + field.scores(f)[y], path + ([(i, y, j)] if y else [])))
            memo[id(arcs), j, y] = max(options, key=lambda o: o[0]) if options else (float("-inf"), [])
            return memo[id(arcs), j, y]

        assert field.decode(x) == max((best(n, y) for y in range(5)), key=lambda o: o[0])[1]


def test_operator(spark):
    rows = odd_rows(10) + [(100, "mail a.b@c.org, or 10.0.0.1", "en", "s", 1)]
    got = P.pii(frame(spark, rows, clash=True), keep=("doc_id", "text", "row")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert set(filter(None, ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base).split(","))) <= set(r.spans.split(","))
        assert (r.masked is None) == (r.text is None) and r.n_spans == len(list(filter(None, r.spans.split(","))))
    assert next(r.masked for r in got if r.doc_id == 100) == "mail <EMAIL>, or <IP>"
    assert P.pii(no_rows(spark)).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = P.op4_pii_crf(spark, str(DATA)).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
