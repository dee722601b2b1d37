from __future__ import annotations

import random
import re
from collections import Counter

from fieldsonar.llm.quality_rules import MIN_WORDS, NGRAM_LIMITS, op2_repetition_quality, quality_rules
from tests.llm.util import DATA, frame, no_rows, odd_rows, prose, words


def plain(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    chars = sum(map(len, w))
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    failed = len(w) < MIN_WORDS or 100 * len(cover) > 50 * len(w)
    bad = len(dup) > 0.3 * len(lines) or sum(len(y) for x in dup for y in words(x)) > 0.2 * chars
    for n, most in NGRAM_LIMITS.items():
        seen, inside = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                inside |= set(range(i, i + n))
            seen.add(g)
        bad = bad or sum(len(w[i]) for i in inside) > most * chars
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(dup), len(cover), failed, not failed and not bad)


def test_against_plain(spark):
    rng = random.Random(3)
    rows = odd_rows(1000)
    for i in range(60):
        text = prose(rng, rng.randrange(1, 20))
        if i % 3 == 0:
            text += "\n" + "\n".join([prose(rng, 1)] * rng.randrange(1, 6)) + "\n"
        if i % 5 == 0:
            text = text + " " + text[: rng.randrange(len(text))]
        if i % 7 == 0:
            text = text.replace("w1", "é|<").replace("w2", "\x0b# a a a a a")
        rows.append((i, text, "en", "s", len(text)))
    got = quality_rules(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *plain(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def test_empty_table(spark):
    assert quality_rules(no_rows(spark)).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op2_repetition_quality(spark, str(DATA)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == plain(docs[r.doc_id])
