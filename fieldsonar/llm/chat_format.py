"""Chat formatting in budgeted windows.

Each turn becomes `<turn ROLE>`, its escaped text and `</turn>`, each on lines of their own. Prefix sums of the
turns' tokens cut a conversation into turn-aligned windows within a token budget. A later window repeats the leading
system turn and a limited history; loss falls on assistant texts that were not in an earlier window.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, quoted

BUDGET, HISTORY = 1024, 256
#: Turns held at once; a longer conversation passes through in blocks.
BLOCK = 1024
TRAINED_ROLE, SYSTEM_ROLE = "assistant", "system"

_CONTROL = re.compile(r"\\|<(?=/?turn)|#(?=##)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)\n</turn>\n", re.DOTALL)
_IN_ROLE = re.compile(r"[%<>\\\n]")


def escape(text: str) -> str:
    """A backslash before each backslash and before each start of a control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _head(role: str) -> str:
    return f"<turn {_IN_ROLE.sub(lambda m: f'%{ord(m[0]):02X}', role)}>\n"


def _formatted(role: str, text: str) -> str:
    return _head(role) + escape(text) + "\n</turn>\n"


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a formatted window."""
    role = lambda r: re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), r)
    return [(role(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


def bpe_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with a tokenizer file; loaded once in a worker."""

    def count(texts: list[str]) -> list[int]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if (t := _LOADED.get(path)) is None:
            t = _LOADED[path] = Tokenizer.from_file(path)
            t.encode_special_tokens = True
        # a few at a time: their tokens are not held together
        return [len(e.ids) for at in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]

    return count


_LOADED: dict = {}


class Windows:
    """Takes one conversation's turns in order and gives its windows."""

    def __init__(self, conv: object, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.turns: list[tuple[str, str, int]] = []  # role, formatted, tokens
        self.system: list[tuple[str, str, int]] = []
        self.begin = 0  # first turn of the held block that no window has had
        self.window = 0
        self.fresh = True

    def add(self, role: str, formatted: str, tokens: int) -> None:
        if self.fresh and role == SYSTEM_ROLE:
            self.system = [(role, formatted, tokens)]
        self.fresh = False
        self.turns.append((role, formatted, tokens))

    def take(self, last: bool) -> Iterator[dict]:
        """Windows of the held turns; unless they are the last, the one that may still grow stays."""
        total = [0, *accumulate(t[2] for t in self.turns)]
        n = len(self.turns)
        while self.begin < n:
            s, first = self.begin, self.window == 0
            lead = [] if first else self.system
            own = 1 if self.system and self.window else 0
            room = self.budget - sum(t[2] for t in lead)
            spare = max(0, min(self.history, room - self.turns[s][2]))
            # the block begins with the system turn only while the first window is not past it
            floor = own if self.turns and self.system and self.turns[0] is self.system[0] else 0
            h = s if first else max(floor, bisect_left(total, total[s] - spare, 0, s + 1))
            h = min(h, s)
            end = max(s + 1, bisect_right(total, total[h] + room) - 1)
            if end >= n and not last:
                break
            end = min(end, n)
            yield self._window(lead + self.turns[h:s], self.turns[s:end])
            self.begin, self.window = end, self.window + 1
        # keep only what later windows may repeat
        keep = bisect_left(total, total[self.begin] - self.history)
        self.turns, self.begin = self.turns[keep:], self.begin - keep

    def _window(self, repeated: list, new: list) -> dict:
        parts, loss, at = [], [], 0
        for i, (role, formatted, _) in enumerate(repeated + new):
            if i >= len(repeated) and role == TRAINED_ROLE:
                loss.append({"start": at + len(_head(role)), "end": at + len(formatted) - len("\n</turn>\n")})
            parts.append(formatted)
            at += len(formatted)
        tokens = sum(t[2] for t in repeated + new)
        return {"conv": self.conv, "window": self.window, "text": "".join(parts), "n_repeated": len(repeated), "n_turns": len(new), "n_tokens": tokens, "over_budget": tokens > self.budget, "loss_spans": loss}


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SCHEMA = "window int, text string, n_repeated int, n_turns int, n_tokens long, over_budget boolean, loss_spans array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame, count: Callable[[list[str]], list[int]], budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Windows of all conversations: conv, window, text, n_repeated leading turns, n_turns new ones, n_tokens, loss_spans.

    Turns go by their number, equal numbers by role and text; null numbers first. A null role or text is empty. Rows
    of a null conversation id are one conversation. A turn over the budget has a window of its own, marked
    over_budget. Only the first turn counts as the system turn. An empty table gives an empty one, other columns are
    left aside. Tokens are counted where the rows are read; one shuffle then brings conversations
    together, whose tasks only cut windows and stream, so a long conversation is never held whole.
    """
    kind = turns.schema[conv].dataType
    name = kind.simpleString()
    arrow = pa.int64() if name == "bigint" else pa.int32() if name == "int" else pa.string()
    if name not in ("bigint", "int", "string"):
        raise ValueError(f"{conv} is {name}; integers and strings are taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Windows | None = None
        out: list[dict] = []
        size = 0

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            types = [arrow, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), _SPANS]
            names = ["conv", *[s.split()[0] for s in SCHEMA.split(", ")]]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], ty) for n, ty in zip(names, types)], names=names)

        for batch in batches:
            for c, r, t, n in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or c != now.conv:
                    if now is not None:
                        out += now.take(True)
                    now = Windows(c, budget, history)
                now.add(r, _formatted(r, t), n)
                if len(now.turns) - now.begin >= BLOCK:
                    out += now.take(False)
                    size = sum(len(w["text"]) for w in out)
                if size > 4_000_000 or len(out) > 2000:
                    yield batch_of(out)
                    out, size = [], 0
        if now is not None:
            out += now.take(True)
        if out:
            yield batch_of(out)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n = count([_formatted(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist())])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=["conv", "turn", "role", "text", "n"])

    empty = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = turns.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = rows.mapInArrow(lean(counted), f"conv {name}, turn {turns.schema[turn].dataType.simpleString()}, role string, text string, n long")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return rows.select("conv", "role", "text", "n").mapInArrow(lean(run), f"conv {name}, {SCHEMA}").withColumnRenamed("conv", conv)


def digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What a reader of the windows finds: turns, loss text and sizes by conversation. Streams over windows in order."""
    name = windows.schema[conv].dataType.simpleString()
    arrow = pa.int64() if name == "bigint" else pa.int32() if name == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def row() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])

        def batch_of() -> pa.RecordBatch:
            types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["c"]:
                    if now is not None:
                        out.append(row())
                    now = [r["c"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                new = read_turns(r["text"])[r["n_repeated"] :]
                now[1] += len(new)
                for role, text in new:
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in r["loss_spans"]:
                    text = unescape(r["text"][span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(r["text"])
                now[6] += 1
            if len(out) > 5000:
                yield batch_of()
                out = []
        if now is not None:
            out.append(row())
        if out:
            yield batch_of()

    schema = f"c {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    rows = windows.select(F.col(conv).alias("c"), "text", "n_repeated", "loss_spans")
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("c", conv)


#: A conversation whose texts hold control strings of common templates.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_chat_windows(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """What a reader finds in the windows of every conversation, and of PROBE; a conversation -7 of the table has PROBE's turns too."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(probe), bpe_counter(tokenizer)))
