from __future__ import annotations

import random
import re
from collections import defaultdict

import pyarrow as pa

from fieldsonar.llm import substring_dedup as D
from tests.llm.util import frame, no_rows, odd_rows, prose


def runs(text):
    """(words, start, end) of all runs, by plain loops."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    starts = [i for i, (w, s, e) in enumerate(words) if i == 0 or words[i - 1][0][-1] in ".!?" or "\n" in text[words[i - 1][2] : s]]
    n, cut = len(starts), [*starts, len(words)]
    out = set()
    for i in range(n):
        long = cut[i + 1] - cut[i] >= D.LONG_SENTENCE
        j = i + (1 if long else 2)
        while j <= n and cut[j] - cut[i] < D.MIN_WORDS:
            j += 1
        if j <= n:
            out.add((i, j))
        j = i + 1 - (1 if long else 2)
        while j >= 0 and cut[i + 1] - cut[j] < D.MIN_WORDS:
            j -= 1
        if j >= 0:
            out.add((j, i + 1))
    low = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    return sorted((cut[i], tuple(low(w) for w, _, _ in words[cut[i] : cut[j]]), words[cut[i]][1], words[cut[j] - 1][2]) for i, j in out)


def plain(rows):
    first, times, got = {}, defaultdict(int), {}
    order = lambda k: (k is None, k or 0)
    for key, text, *_ in rows:
        for _, w, _, _ in runs(text):
            times[w] += 1
            first[w] = min(first.get(w, key), key, key=order)
    for key, text, *_ in rows:
        seen, spans = set(), []
        for _, w, s, e in sorted(runs(text), key=lambda r: (r[0], r[3])):
            if times[w] > 1 and (key != first[w] or w in seen):
                spans.append((s, e))
            seen.add(w)
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        if merged:
            got[key, text] = merged
    return got


def corpus():
    rng = random.Random(4)
    passages = [prose(rng, 7) for _ in range(4)] + [" ".join(f"q{rng.randrange(900)}" for _ in range(60))]
    rows = odd_rows(3000)
    for i in range(80):
        text = prose(rng, rng.randrange(2, 10))
        if i % 3 == 0:
            text = f"{text}\n{rng.choice(passages)}\n{prose(rng, 2)}"
        if i % 10 == 0:
            text = f"{text} {text}"
        rows.append((i, text, "en", "s", 1))
    return rows + rows[-3:]


def test_against_plain(spark):
    rows = corpus()
    got = D.repeated_spans(frame(spark, rows, clash=True)).collect()
    texts = {}
    from pyspark.sql import functions as F

    for r in frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        texts[r.doc_id, r.h] = r.text
    assert {(r.doc, texts[r.doc, r.text_hash]): [tuple(s) for s in r.spans] for r in got} == plain(rows)


def test_cleaned_texts(spark):
    rows = corpus()
    want = plain(rows)
    clean = D.without_repeats(frame(spark, rows))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in clean.collect())

    def cut(key, text):
        if (key, text) not in want:
            return text or ""
        keep, at = [], 0
        for s, e in want[key, text]:
            keep.append(text[at:s])
            at = e
        return "".join(keep) + text[at:]

    assert got == sorted((k is not None, k or 0, cut(k, t)) for k, t, *_ in rows)
    assert D.repeated_spans(no_rows(spark)).collect() == []


def test_passage_in_mid_sentence(spark):
    rng = random.Random(8)
    tail = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    for before, whole, after in ((6, 47, 0), (0, 47, 6), (6, 47, 6), (31, 20, 0)):
        middle = tail(whole) + "."
        passage = " ".join(x for x in (tail(before) + "." if before else "", middle, tail(after) if after else "") if x)
        host = lambda: f"{tail(15)}. {tail(5)}{' ' if before else '. '}{passage} {tail(5)}. {tail(15)}."
        rows = [(i, host(), "en", "s", 1) for i in range(3)]
        texts = {i: t for i, t, *_ in rows}
        got = {r.doc: [texts[r.doc][s:e] for s, e in r.spans] for r in D.repeated_spans(frame(spark, rows)).collect()}
        # the sentences that are cut by the host stay
        assert got == {1: [middle], 2: [middle]}


def test_patterned_texts_that_differ(spark):
    """Thue-Morse patterns, which every polynomial modulo 2^64 confuses: one sentence each, of the same words and length."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    rows = [(i, " ".join(("ka", "ri")[b ^ i] for b in bits), "en", "s", 1) for i in range(2)]
    assert {r.doc_id: r.text for r in D.without_repeats(frame(spark, rows)).collect()} == {i: t for i, t, *_ in rows}
    # and the same text twice still goes
    again = {r.doc_id: r.text for r in D.without_repeats(frame(spark, [*rows, (2, rows[0][1], "en", "s", 1)])).collect()}
    assert again == {0: rows[0][1], 1: rows[1][1], 2: ""}


def test_runs_need_both_hashes(spark, monkeypatch):
    """Texts that one hash confuses keep their words."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 8), "en", "s", 1) for i in range(6)]
    real = D.sentence_runs

    def clashing(texts):
        return [(v * 0 + 7, *rest) for v, *rest in real(texts)]

    one, both = real(pa.array([rows[0][1]]))[0][:2]
    assert len(one) and not set(one.tolist()) & set(both.tolist())
    monkeypatch.setattr(D, "sentence_runs", clashing)
    got = D.repeated_spans(frame(spark, rows + [(9, rows[0][1], "en", "s", 1)]))
    assert got.count() <= 1


def test_many_spans_merge_in_proportion(spark):
    line = "a b c d e f g h i j k l m n o p q r s t u v w x {}. "
    text = "".join(line.format(i % 50) + f"z{i} own words here. " for i in range(20_000))
    got = D.repeated_spans(frame(spark, [(1, text, "en", "s", 1)])).collect()
    assert len(got) == 1 and len(got[0].spans) == 20_000 - 50 and all(a.end < b.start for a, b in zip(got[0].spans, got[0].spans[1:]))
    clean = D.without_repeats(frame(spark, [(1, text, "en", "s", 1)])).first().text
    assert len(clean) == len(text) - sum(s.end - s.start for s in got[0].spans)
