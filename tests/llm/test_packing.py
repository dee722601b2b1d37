from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fieldsonar.llm import best_fit_packing as B
from tests.llm.util import DATA, frame, no_rows, odd_rows, prose

ODD = ["it's a <|endoftext|> b", "<|ENDOFTEXT|>x", "a≠b a,́b é,x ×, ÷.a ñ", "don't,can't... 123abc4.5 É́ K İx ﬁ ǅ", "漢字,abc…def—x", "a'sb 's' ''s", "", "x\x0b\x0cy\x1cz w v", "Ça, va?À!", "ä,b 'd'D", "a<b a>b|c &&& %%x##"]


def test_ids_are_the_tokenizers():
    t, w = Tokenizer.from_file(B.default_tokenizer()), B.WordTokenizer(B.default_tokenizer())
    rng = random.Random(8)
    signs = "abcdeéß'.,<|>!?-_ \n0129漢́"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(40)) for _ in range(300)]
    for group in (texts, [x for x in texts if "<|" not in x]):
        ids, bounds = w(pa.array(group, pa.string()))
        for i, x in enumerate(group):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def check(rows, docs, capacity):
    t = Tokenizer.from_file(B.default_tokenizer())
    want = defaultdict(int)
    for key, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[key, p, at, len(cut), zlib.crc32(cut)] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places), sum(r.length for r in rows)


def test_packs(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD", 64)
    rng = random.Random(6)
    rows = odd_rows(700) + [(i, prose(rng, rng.randrange(1, 12)), "en", "s", 1) for i in range(150)]
    got = B.packed(frame(spark, rows, clash=True), capacity=256).collect()
    n, total = check(got, [(r[0], r[1]) for r in rows], 256)
    assert n <= total / 256 * 1.1 + 6
    assert B.packed(no_rows(spark)).collect() == []


def test_repeated_rows_do_not_fill_one_shard(spark):
    rows = [(1, "the same text", "en", "s", 1)] * 500
    cut = B.written(B.pieces(frame(spark, rows), B.default_tokenizer()), "t")
    shards = [r[0] for r in cut.selectExpr("pmod(salt, 8) AS s").groupBy("s").count().select("count").collect()]
    assert len(shards) == 8 and max(shards) < 120


def test_algorithm():
    rng = random.Random(1)
    for _ in range(5):
        lengths = [rng.choice((rng.randrange(1, 90), rng.randrange(30, 70), 100)) for _ in range(300)]
        s = B.Shard(lengths, 100)
        first = s.fill([], sorted(s.items, key=lambda i: -lengths[i]))
        best = s.evolve([], 5)[0]
        assert sorted(i for b in best for i in b) == s.items and all(sum(lengths[i] for i in b) <= 100 for b in best)
        assert s.bound <= len(best) <= len(first)
        a, b = (s.fill([], rng.sample(s.items, len(s.items))) for _ in range(2))
        for child in (s.crossed(a, b, rng), s.refilled(a, rng)):
            assert sorted(i for x in child for i in x) == s.items and all(sum(lengths[i] for i in x) <= 100 for x in child)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    n, total = check(B.op8_best_fit_packing(spark, str(DATA)).collect(), docs, 2048)
    assert n <= -(-total // 2048) + 1


def triplets(rng, n, capacity=2048):
    """Pieces that fill n sequences whole, three by three, where the best fit in descending order does not find it."""
    out = []
    for _ in range(n):
        a = rng.randrange(capacity * 3 // 8, capacity // 2)
        b = rng.randrange((capacity - a) // 2 - 100, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return out


def test_search_beats_best_fit():
    rng = random.Random(3)
    for n in (20, 40, 83):
        s = B.Shard(triplets(rng, n), 2048)
        first = s.fill([], sorted(s.items, key=lambda i: -s.size[i]))
        best = s.evolve([], 1)[0]
        assert sorted(i for b in best for i in b) == s.items and max(sum(s.size[i] for i in b) for b in best) <= 2048
        assert len(first) >= 1.07 * n and len(best) <= n + 1


def least_bins(sizes, capacity):
    """The exact optimum, by sums over subsets."""
    n, best = len(sizes), {0: (0, capacity)}
    best = [(0, capacity)] + [(99, 0)] * ((1 << n) - 1)  # bins and fill of the last one
    for mask in range(1 << n):
        bins, fill = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                new = (bins, fill + sizes[i]) if fill + sizes[i] <= capacity and bins else (bins + 1, sizes[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], new)
    return best[-1][0]


def test_small_instances_against_the_optimum():
    rng = random.Random(12)
    for _ in range(25):
        sizes = [rng.randrange(15, 75) for _ in range(rng.randrange(4, 11))]
        assert len(B.Shard(sizes, 100).evolve([], 2)[0]) == least_bins(sizes, 100)


def test_fullest():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 60) for _ in range(9)]
        s = B.Shard(sizes, 100)
        got = s.fullest(sorted(range(9), key=lambda i: -sizes[i]), 100)
        sums = {sum(sizes[i] for i in range(9) if m >> i & 1) for m in range(512)}
        assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == max(x for x in sums if x <= 100)


def test_shards_give_back_their_last_bins(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 12)), "en", "s", 1) for i in range(300)]
    docs = [(r[0], r[1]) for r in rows]
    counts = {}
    for share in (0, 1 / 4):
        monkeypatch.setattr(B, "SHARD", 32)
        monkeypatch.setattr(B, "GIVEN_BACK", share)
        counts[share], total = check(B.pack(B.written(B.pieces(frame(spark, rows), B.default_tokenizer(), 256), "t"), 256, 32).withColumnRenamed("doc", "doc_id").collect(), docs, 256)
    assert counts[1 / 4] < counts[0] and counts[1 / 4] <= total / 256 * 1.03 + 1
