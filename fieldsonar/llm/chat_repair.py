"""Repair of conversation structure: the cheapest edits that give role initials `(s?(ua)+)?`.

Edits: keep a row (K, 0), give it the role that the place asks for (R, 3), delete it (D, 4; blank and duplicate rows must
go), insert a turn with an empty text (I, 3). A truncated row that is not deleted costs 3 more. Ties go to the edits whose
letters are least.

A* on the edit lattice. A node is (rows consumed, what stands last: nothing, s, u or a). The heuristic is a suffix sum of
what every way to the end still has to pay: 4 for each row that must go, 3 for each truncated row (it stays for 3 or goes
for 4). No edit costs less than the heuristic falls by, so a node's first visit, in the order of (cost + heuristic,
letters), is its cheapest one with the least letters: of two ways of equal cost to a node neither's letters begin the
other's, as more letters for the same rows are more insertions, so the lesser one stays the lesser whatever follows.

A conversation is cut into blocks of BLOCK rows. The search of a block ends in all four states; ways through it are
joined to those before it by their costs and letters, and letters that all live ways share are put aside, so a long
conversation costs time and memory in proportion. A conversation may be spread over many tasks: rows are sorted into ranges, every
range gives the ways through its piece from each state it may be entered in, and the pieces of one conversation are joined.
Only the digest of a repaired text, which is sequential, streams through one task a conversation.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, quoted, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a block.
BLOCK = 256
FINE, BLANK, DUPLICATE, CUT = range(4)
#: What stands last: nothing yet, s, u or a. A conversation may end with nothing or with a.
NOTHING, S, U, A = range(4)
_ENDS = (NOTHING, A)
_NAMES = {U: "user", A: "assistant"}
Way = tuple[int, str]


def _wanted(state: int) -> int:
    """The role that an inserted or changed turn gets after a state."""
    return A if state == U else U


def _after(state: int, initial: str) -> int | None:
    """The state after a kept row, or None where it may not stand."""
    to = {"s": S, "u": U, "a": A}.get(initial)
    return to if to == _wanted(state) or (to == S and state == NOTHING) else None


def search(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...] | None = None) -> dict[int, Way]:
    """The cheapest way, (cost, letters), through rows of (role initial, fault) from a state to each final state.

    With `ends` the search stops at the first of those states.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        ahead[i] = ahead[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED if fault == CUT else 0)
    heap = [(ahead[0], "", 0, start, 0)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, Way] = {}
    while heap:
        _, letters, i, state, cost = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            found[state] = (cost, letters)
            if ends and state in ends:
                return {state: found[state]}
        steps = [(INSERT, "I", i, _wanted(state))]
        if i < n:
            initial, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault in (FINE, CUT):
                more = TRUNCATED if fault == CUT else 0
                if (to := _after(state, initial)) is not None:
                    steps.append((KEEP + more, "K", i + 1, to))
                steps.append((REROLE + more, "R", i + 1, _wanted(state)))
        for price, letter, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(heap, (cost + price + ahead[j], letters + letter, j, to, cost + price))
    return found


class Ways:
    """The cheapest ways from one state through the rows so far, to each state; letters that all share are held once."""

    def __init__(self, start: int) -> None:
        self.start, self.shared = start, []
        self.live: dict[int, Way] = {start: (0, "")}

    def through(self, block: dict[int, dict[int, Way]]) -> None:
        """Go on through a block or piece, of which `block` has the ways from each state."""
        joined: dict[int, Way] = {}
        for middle, (cost, letters) in self.live.items():
            for end, (more, after) in block.get(middle, {}).items():
                way = (cost + more, letters + after)
                if end not in joined or way < joined[end]:
                    joined[end] = way
        prefix = os.path.commonprefix([letters for _, letters in joined.values()])
        self.shared.append(prefix)
        self.live = {end: (cost, letters[len(prefix) :]) for end, (cost, letters) in joined.items()}

    def all(self) -> dict[int, Way]:
        shared = "".join(self.shared)
        return {end: (cost, shared + letters) for end, (cost, letters) in self.live.items()}

    def best(self) -> Way:
        cost, letters = min(self.live[end] for end in _ENDS if end in self.live)
        return cost, "".join(self.shared) + letters


class _Piece:
    """What a range of sorted rows has of one conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.block, self.counts = conv, [], [0, 0, 0]
        self.ways: list[Ways] | None = None
        self.illegal = self.distinct = self.rows = 0
        self.first = self.last = self.low = self.high = None
        self.turn_before, self.first_turn = _UNSEEN, _UNSEEN

    def add(self, turn, initial: str, fault: int) -> None:
        if self.last is not None:
            self.illegal += f"{self.last}{initial}" not in ("su", "ua", "au")
        else:
            self.first, self.first_turn = initial, turn
        self.last, self.rows = initial, self.rows + 1
        if fault:
            self.counts[fault - 1] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += turn != self.turn_before
        self.turn_before = turn
        self.block.append((initial, fault))
        if len(self.block) == BLOCK:
            self._close((NOTHING, S, U, A))

    def _close(self, starts: tuple[int, ...]) -> None:
        if self.ways is None:
            self.ways = [Ways(s) for s in starts]
        if self.block:
            block = {s: search(self.block, s) for s in {m for w in self.ways for m in w.live}}
            for w in self.ways:
                w.through(block)
            self.block = []

    def repaired(self) -> Way:
        """The whole conversation's cost and letters, when no other range has rows of it."""
        if self.ways is None:
            return min(search(self.block, NOTHING, _ENDS).values())
        self._close(())
        return self.ways[0].best()

    def from_every_state(self) -> list[dict]:
        self._close((NOTHING, S, U, A))
        return [{"start": w.start, "end": end, "cost": cost, "letters": letters} for w in self.ways for end, (cost, letters) in w.all().items()]


_UNSEEN = object()
_TAIL = "blank long, duplicate long, truncated long, illegal long"
_WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _distinct_rows(turns: DataFrame) -> DataFrame:
    """conv, turn, role, digest (of role and text), initial, mark (the text's last sign that is no space) and how many copies; counted in tasks first."""
    mark = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    rows = turns.select("conv", "turn", "role", _digest().alias("digest"), mark.alias("mark"), "copies")
    return written(rows.groupBy("conv", "turn", "role", "digest").agg(F.first("mark").alias("mark"), F.sum("copies").alias("copies")), "turns")


def _with_faults(narrow: DataFrame) -> DataFrame:
    """Each distinct row's initial and fault, and how many `more` copies follow it, which are blank or duplicates.

    A role and text that very many turns have is counted in tasks first, and its join can be split.
    """
    order = F.struct(F.col("turn").isNotNull().alias("full"), F.col("turn").alias("turn"))
    seen = narrow.groupBy("conv", "digest").agg(F.count("*").alias("times"), F.min(order).alias("least")).where("times > 1")
    seen = written(seen.select(F.col("conv").alias("seen_conv"), F.col("digest").alias("seen_digest"), "least"), "turns-seen")
    got = narrow.join(seen, F.col("conv").eqNullSafe(F.col("seen_conv")) & (F.col("digest") == F.col("seen_digest")), "left")
    again = F.coalesce(order > F.col("least"), F.lit(False))
    fault = F.when(F.col("mark") == "", BLANK).when(again, DUPLICATE).when(~F.col("mark").isin(".", "!", "?"), CUT).otherwise(FINE)
    return got.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"), (F.col("copies") - 1).alias("more"))


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows go by turn, null turns first, those of one turn by role and then by a digest of the text. A null role or text is one
    space. A row's first fault counts: blank (nothing but white space), duplicate (role and text were there before),
    truncated (the last sign is none of . ! ?). Roles count by their first character; other roles than s, u and a cannot be kept. Equal rows
    are copies of one another (`copies` may hold a number of them). Rows of a null conversation are one conversation.
    An empty table gives an empty one; other columns are left aside.
    """
    kind = turns.schema[conv].dataType.simpleString()
    whole = turns.schema[turn].dataType.simpleString()
    if whole not in ("bigint", "int") or kind not in ("bigint", "int", "string"):
        raise ValueError(f"{conv} is {kind} and {turn} {whole}; conversations are integers or strings, turns are integers")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    filled = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    rows = turns.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), (F.col(quoted(copies)).cast("long") if copies else F.lit(1).cast("long")).alias("copies"))
    narrow = _with_faults(_distinct_rows(rows))
    ordered = narrow.repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole conversations, and of the first and last one, which other ranges may have rows of too."""
        done: list[dict] = []
        now: _Piece | None = None
        first = True

        def row(p: _Piece, open_: bool) -> dict:
            cost, letters = (None, None) if open_ else p.repaired()
            return {
                "conv": p.conv, "first_turn": p.first_turn, "last_turn": p.turn_before, "first": p.first, "last": p.last, "low": p.low, "high": p.high, "distinct": p.distinct,
                "blank": p.counts[0], "duplicate": p.counts[1], "truncated": p.counts[2], "illegal": p.illegal, "cost": cost, "audit": letters, "ways": p.from_every_state() if open_ else None,
            }

        for batch in batches:
            for c, t, initial, fault, more in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or c != now.conv:
                    if now is not None:
                        done.append(row(now, first))
                        first = False
                    now = _Piece(c)
                now.add(t, initial, fault)
                for _ in range(more):
                    now.add(t, initial, BLANK if fault == BLANK else DUPLICATE)
                if len(done) >= 2000:
                    yield pa.RecordBatch.from_pylist(done, schema=_pieces_schema(arrow))
                    done = []
        if now is not None:
            done.append(row(now, True))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_pieces_schema(arrow))

    spec = f"conv {kind}, first_turn long, last_turn long, first string, last string, low long, high long, distinct long, {_TAIL}, cost long, audit string, ways array<struct<start:int,end:int,cost:long,letters:string>>"
    found = written(ordered.select("conv", "turn", "initial", "fault", "more").mapInArrow(lean(pieces), spec).withColumn("range", F.spark_partition_id()), "conversation-pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    tail = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    closed = found.where("ways IS NULL").select("conv", gaps.alias("gaps"), *tail)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        """A conversation's pieces, at most one a range, joined in their order."""
        parts = sorted(table.to_pylist(), key=lambda p: p["range"])
        ways, sums, before = Ways(NOTHING), [0, 0, 0, 0], None
        low = high = None
        distinct = 0
        for p in parts:
            block: dict[int, dict[int, Way]] = {}
            for w in p["ways"]:
                block.setdefault(w["start"], {})[w["end"]] = (w["cost"], w["letters"])
            ways.through(block)
            sums = [a + p[k] for a, k in zip(sums, ("blank", "duplicate", "truncated", "illegal"))]
            low, high = p["low"] if low is None else low, high if p["high"] is None else p["high"]
            distinct += p["distinct"]
            if before is not None:
                sums[3] += f"{before['last']}{p['first']}" not in ("su", "ua", "au")
                distinct -= p["first_turn"] is not None and p["first_turn"] == before["last_turn"]
            before = p
        cost, letters = ways.best()
        gaps = 0 if low is None else high - low + 1 - distinct
        return pa.table([pa.array([x], t) for x, t in zip((parts[0]["conv"], gaps, *sums, cost, letters), (arrow, *[pa.int64()] * 6, pa.string()))], names=["conv", "gaps", *tail])

    opened = found.where("ways IS NOT NULL").groupBy("conv").applyInArrow(join, f"conv {kind}, gaps long, {_TAIL}, cost long, audit string")
    plans = written(closed.unionByName(opened), "conversation-plans")
    return plans.join(_digests(rows, plans, kind, arrow).withColumnRenamed("conv", "own_conv"), F.col("conv").eqNullSafe(F.col("own_conv"))).drop("own_conv").withColumnRenamed("conv", conv)


def _pieces_schema(arrow: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    return pa.schema(
        [("conv", arrow), ("first_turn", long), ("last_turn", long), ("first", text), ("last", text), ("low", long), ("high", long), ("distinct", long)]
        + [(c.split()[0], long) for c in _TAIL.split(", ")]
        + [("cost", long), ("audit", text), ("ways", pa.list_(_WAY))]
    )


def replay(letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text) that edits make of rows."""
    state = NOTHING
    for letter in letters:
        if letter == "I":
            state = _wanted(state)
            yield _NAMES[state], ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = _after(state, role[:1])
            yield role, text
        elif letter == "R":
            state = _wanted(state)
            yield _NAMES[state], text


def _digests(rows: DataFrame, plans: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """conv and repaired_sha256: each conversation's edits come first, then its rows in order, as a stream."""
    none = lambda t: F.lit(None).cast(t)
    head = plans.select("conv", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), F.col("audit").alias("text"), none("binary").alias("digest"), F.lit(1).cast("long").alias("copies"))
    body = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("digest"), "copies")
    ordered = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        source = stream()
        upcoming = next(source, None)

        def texts(conv) -> Iterator[tuple[str, str]]:
            nonlocal upcoming
            while upcoming is not None and upcoming[1] == 1 and upcoming[0] == conv:
                _, _, role, text, n = upcoming
                for _ in range(n):
                    yield role, text
                upcoming = next(source, None)

        done: list[tuple] = []
        while upcoming is not None:
            conv, letters = upcoming[0], upcoming[3]
            upcoming = next(source, None)
            sha, own = hashlib.sha256(), texts(conv)
            for i, (role, text) in enumerate(replay(letters, own)):
                sha.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
            for _ in own:  # what is left
                pass
            done.append((conv, sha.hexdigest()))
            if len(done) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (arrow, pa.string()))], names=["conv", "repaired_sha256"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (arrow, pa.string()))], names=["conv", "repaired_sha256"])

    return ordered.select("conv", "kind", "role", "text", "copies").mapInArrow(lean(run), f"conv {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text and copies, with faults by the checksum of `conv_id:turn`; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("luck"))
    text = F.when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("luck") == 4, "user").otherwise(F.col("role"))
    return rows.where("luck <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("luck") == 3, 2).otherwise(1).cast("long").alias("copies"))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: its faults, the repair's cost and edits, and the digest of what comes out."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = repair_conversations(damaged(turns), copies="copies").withColumnRenamed("conv_id", "own_conv")
    every = turns.select("conv_id").distinct()
    out = every.join(got, every["conv_id"].eqNullSafe(got["own_conv"]), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(state: str, price: str, letter: str, line: str | None = None, only: str = "true") -> str:
    """SQL: the way that goes on from a state, or one that is never the least."""
    out = f"w.{state}.lines" + (f" || chr(10) || {line}" if line else "")
    return f"CASE WHEN {only} THEN {{'cost': w.{state}.cost + {price}, 'letters': w.{state}.letters || '{letter}', 'lines': {out}}} ELSE never END"


_STAYS, _CHARGE = "r.fault IN (0, 3)", "CASE WHEN r.fault = 3 THEN 3 ELSE 0 END"
_INSERT_U = _least("w.u", *(_way(s, "3", "I", "'user:'") for s in ("n", "s", "a")))
#: The same result by rounds over all states of each row, without the search.
SQL = f"""WITH RECURSIVE crc_table AS (SELECT {"list_transform(" * 8}range(0, 256){", lambda c: xor(c >> 1, (c & 1) * 3988292384))" * 8} AS t),
luck AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS luck FROM conversations, crc_table),
harmed AS (SELECT conv_id, turn, CASE WHEN luck = 4 THEN 'user' ELSE role END AS role,
  CASE luck WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN luck = 3 THEN [1, 2] ELSE [1] END) AS copy FROM luck WHERE luck <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS i FROM harmed),
marked AS (SELECT *, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
r AS (SELECT conv_id, turn, role, text, i, before, CASE WHEN mark = '' THEN 1 WHEN again THEN 2 WHEN mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, count(*) OVER (PARTITION BY conv_id) AS n FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
steps AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, n AS last, never AS never, {{'n': {{'cost': CAST(0 AS BIGINT), 'letters': '', 'lines': ''}}, 's': never, 'u': never, 'a': never}} AS w
  FROM r, (SELECT {{'cost': CAST(1000000000 AS BIGINT), 'letters': '~', 'lines': ''}} AS never)
  UNION ALL
  SELECT conv_id, i, last, never, {{'n': {_way("n", "4", "D")},
    's': {_least(_way("s", "4", "D"), _way("n", _CHARGE, "K", "role || ':' || text", "r.fault IN (0, 3) AND role[1] = 's'"))},
    'u': {_least(_way("u", "4", "D"), *(_way(s, f"3 + {_CHARGE}", "R", "'user:' || text", _STAYS) for s in "nsa"), *(_way(s, _CHARGE, "K", "role || ':' || text", f"{_STAYS} AND role[1] = 'u'") for s in "nsa"))},
    'a': {_least(_way("a", "4", "D"), _way("u", f"3 + {_CHARGE}", "R", "'assistant:' || text", _STAYS), _way("u", _CHARGE, "K", "role || ':' || text", f"{_STAYS} AND role[1] = 'a'"))}}} AS w
  FROM (SELECT r.conv_id, r.i, r.role, r.text, r.fault, p.last, p.never, {{'n': p.w.n, 's': p.w.s, 'u': p.w.u, 'a': {_least("p.w.a", _way("u", "3", "I", "'assistant:'").replace("w.", "p.w."))}}} AS w
    FROM r JOIN (SELECT conv_id, i, last, never, {{'n': w.n, 's': w.s, 'u': {_INSERT_U}, 'a': w.a}} AS w FROM steps) p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1) r),
ended AS (SELECT conv_id, never, {{'n': w.n, 's': w.s, 'u': {_INSERT_U}, 'a': w.a}} AS w FROM steps WHERE i = last),
best AS (SELECT conv_id, {_least("w.n", "w.a", _way("u", "3", "I", "'assistant:'"))} AS b FROM ended)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(b.letters, '') AS audit, sha256(coalesce(substr(b.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""
