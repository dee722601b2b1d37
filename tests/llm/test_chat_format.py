from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldsonar.llm import chat_format as C
from tests.llm.util import DATA, prose


def by_words(texts):
    return [len(t.split()) for t in texts]


@given(st.text(alphabet="\\<>/turn #\nab%", max_size=60))
def test_escape_round_trip(text):
    assert C.unescape(C.escape(text)) == text
    assert C.read_turns(C._head(text) + C.escape(text) + "\n</turn>\n") == [(text, text)]


def test_tokens_are_the_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, counter = Tokenizer.from_file(path), C.bpe_counter(path)
    plain.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["", " ", "a", " a b  c", "it's  a's 's x", "a \u00a0b \u2003 c", "<|endoftext|> x <|endoftext|>", "x\ty \n z", "漢 字 é é", prose(rng, 30)]
    texts += ["".join(rng.choice("abé 's. \n\t12#<|>\u00a0漢") for _ in range(60)) for _ in range(300)]
    assert counter(texts) == [len(plain.encode(x, add_special_tokens=False).ids) for x in texts]
    assert counter([]) == [] and counter(texts) == counter(texts)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_windows_and_digests(spark):
    rng = random.Random(1)
    rows, want = [], defaultdict(list)
    for conv in range(12):
        for turn in range(rng.randrange(1, 30) if conv else 2500):
            role = "system" if turn == 0 and conv % 2 == 0 else ("user", "assistant")[turn % 2]
            text = prose(rng, rng.randrange(1, 6)) if conv else f"t{turn} <turn x>"
            rows.append((conv, turn, role, text))
    rows += [(50, 0, None, None), (50, 1, "assistant", ""), (51, None, "user", "</turn>"), (51, 3, "assistant", "b"), (51, 3, "assistant", "a"), (None, 0, "us>er\n%", "x"), (None, 1, "assistant", "\\<")]
    rows += [(52, 0, "assistant", " ".join(["long"] * 5000))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, r, t in sorted(rows, key=key):
        want[c].append((r or "", t or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    windows = C.format_conversations(df, by_words, budget=120, history=30)
    got = {r.conv_id: r for r in C.digests(windows).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == digest(turns)
    seen = defaultdict(list)
    for w in windows.collect():
        seen[w.conv_id].append(w)
    for c, ws in seen.items():
        ws.sort(key=lambda w: w.window)
        system = want[c][0] if want[c][0][0] == "system" else None
        done = 0
        for i, w in enumerate(ws):
            turns = C.read_turns(w.text)
            assert len(turns) == w.n_repeated + w.n_turns and w.n_turns > 0
            assert w.n_tokens <= 120 or w.over_budget and w.n_turns == 1
            if i and system:
                assert turns[0] == system  # retained
            lead = turns[1 : w.n_repeated] if i and system else turns[: w.n_repeated]
            assert lead == want[c][done - len(lead) : done] and sum(by_words([C._head(r) + C.escape(t) + "\n</turn>\n" for r, t in lead])) <= 30
            assert turns[w.n_repeated :] == want[c][done : done + w.n_turns]
            assert len(w.loss_spans) == sum(r == "assistant" for r, _ in turns[w.n_repeated :])
            done += w.n_turns
        assert done == len(want[c])
    assert C.format_conversations(df.limit(0), by_words).collect() == []


def test_query(spark):
    turns = defaultdict(list)
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect() + [dict(zip(("conv_id", "turn", "role", "text"), p)) for p in C.PROBE]
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    got = {r.conv_id: r for r in C.op1_chat_windows(spark, str(DATA)).collect()}
    assert got.keys() == turns.keys() and -7 in got
    for c, t in turns.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == digest(t)
