from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from fieldsonar.llm import chat_repair as R
from tests.llm.util import DATA

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
SHAPE = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """By rounds over all states: least (cost, letters) of ways through (initial, fault) rows, without a heuristic."""
    best = {0: (0, "")}

    def inserted(best):
        while True:
            more = dict(best)
            for state, (cost, letters) in best.items():
                to = 3 if state == 2 else 2
                more[to] = min(more.get(to, (1 << 60, "")), (cost + 3, letters + "I"))
            if more == best:
                return best
            best = more

    for initial, fault in rows:
        new = {}
        for state, (cost, letters) in inserted(best).items():
            place = 3 if state == 2 else 2
            ways = [(state, 4, "D")]
            if fault not in (R.BLANK, R.DUPLICATE):
                charge = 3 if fault == R.CUT else 0
                ways.append((place, 3 + charge, "R"))
                if (initial, place) in (("u", 2), ("a", 3)):
                    ways.append((place, charge, "K"))
                if initial == "s" and state == 0:
                    ways.append((1, charge, "K"))
            for to, price, letter in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (cost + price, letters + letter))
        best = new
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def all_edits(rows, most):
    """Every sequence of edits of at most so many letters that gives the shape: (cost, letters)."""
    for n in range(len(rows), most + 1):
        for letters in itertools.product("KRDI", repeat=n):
            if n - letters.count("I") != len(rows):
                continue
            for roles in itertools.product("ua", repeat=letters.count("R") + letters.count("I")):
                source, new, cost, out, fine = iter(rows), iter(roles), 0, "", True
                for x in letters:
                    if x == "I":
                        cost, out = cost + 3, out + next(new)
                        continue
                    initial, fault = next(source)
                    if x == "D":
                        cost += 4
                        continue
                    fine = fine and fault not in (R.BLANK, R.DUPLICATE)
                    cost += (3 if fault == R.CUT else 0) + (3 if x == "R" else 0)
                    out += next(new) if x == "R" else initial
                if fine and SHAPE.fullmatch(out):
                    yield cost, "".join(letters)


def random_rows(rng, n):
    return [(rng.choice("suauaua "), rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(n)]


def test_search_against_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(4))
        want = min(all_edits(rows, 5))
        assert min(R.search(rows, R.NOTHING, (R.NOTHING, R.A)).values()) == want == cheapest(rows)


def test_search_against_rounds():
    rng = random.Random(2)
    for _ in range(2000):
        rows = random_rows(rng, rng.randrange(25))
        assert min(R.search(rows, R.NOTHING, (R.NOTHING, R.A)).values()) == cheapest(rows)


def test_joined_pieces(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5)
    rng = random.Random(3)
    for _ in range(400):
        rows = random_rows(rng, rng.randrange(1, 60))
        piece = R._Piece(1)
        for initial, fault in rows:
            piece.add(1, initial, fault)
        assert piece.repaired() == cheapest(rows)
        # the same rows, in ranges
        ways, cut = R.Ways(R.NOTHING), sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        for a, b in itertools.pairwise(cut):
            part = R._Piece(1)
            for initial, fault in rows[a:b]:
                part.add(1, initial, fault)
            block = {}
            for w in part.from_every_state():
                block.setdefault(w["start"], {})[w["end"]] = (w["cost"], w["letters"])
            ways.through(block)
        assert ways.best() == cheapest(rows)


def plain(table, damage=False):
    out, held = {}, {}
    for c, t, role, text in table:
        held.setdefault(c, [])
        role, text, n = " " if role is None else role, " " if text is None else text, 1
        if damage:
            luck = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if luck == 0:
                continue
            text = "" if luck == 1 else re.sub("[.!?]", "", text) if luck == 2 else text
            role, n = "user" if luck == 4 else role, 2 if luck == 3 else 1
        held[c] += [(t, role, text)] * n
    for c, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            last = text.rstrip(SPACE)[-1:]
            marked.append((role[:1], R.BLANK if not last else R.DUPLICATE if (role, text) in seen else R.CUT if last not in ".!?" else R.FINE))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, letters = cheapest(marked)
        repaired = list(R.replay(letters, iter([(r, x) for _, r, x in rows])))
        assert SHAPE.fullmatch("".join(r[:1] for r, _ in repaired))
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, f in marked) for k in (R.BLANK, R.DUPLICATE, R.CUT)),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked)), cost, letters, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest(),
        )
    return out


def values(df, conv="conv_id"):
    return {r[conv]: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def conversations(rng, n, long=0):
    texts = ["Yes.", "No!", "so", "  ", "", "What?", "ok. \n", None, "émile…", "\x0b\x00", "x" * 2000 + "."]
    rows = []
    for c in [None, *range(n)]:
        for t in [None, None, *range(rng.randrange(8))][rng.randrange(3) :]:
            if rng.random() < 0.9:
                rows.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "users"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    for t in range(long):
        rows.append((-9, t // 2, rng.choice(["user", "assistant"]), rng.choice(["Go on.", f"{rng.random()}.", f"{rng.random()}"])))
    return rows + rows[:3]


@pytest.mark.parametrize("ranges", [1, 7])
def test_against_plain(spark, monkeypatch, ranges):
    rows = conversations(random.Random(ranges), 60, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS conv", "1 AS kind", "'y' AS digest", "2 AS fault", "3 AS more")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        if ranges > 1:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = values(R.repair_conversations(df))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == plain(rows)


def test_long_conversations_take_time_in_proportion():
    rng = random.Random(4)
    for rows in (random_rows(rng, 60_000), [("u", R.FINE)] * 60_000, [(" ", R.CUT)] * 60_000):
        piece = R._Piece(1)
        for initial, fault in rows:
            piece.add(1, initial, fault)
        cost, letters = piece.repaired()
        assert len(letters) >= len(rows) and cost > 0


def test_empty_table(spark):
    assert R.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert values(R.op13_chat_repair(spark, str(DATA))) == plain(rows, damage=True)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({R.SQL})").fetchall()}
    assert values(R.op13_chat_repair(spark, str(DATA))) == want


def test_damage_of_odd_rows(spark, tmp_path):
    rows = conversations(random.Random(9), 150) + [(1000 + i, None if i % 9 else 3, "user", "Alone.") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = values(R.op13_chat_repair(spark, str(tmp_path)))
    want = plain(rows, damage=True)
    assert got == want and any(w[6] == "" for w in want.values())
