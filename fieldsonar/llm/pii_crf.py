"""Personal data by fixed patterns and a semi-Markov conditional random field.

The field scores whole candidate spans (their digits, shape, checksums and surroundings) and a dynamic program over
spans of bounded length chooses boundaries and types together. A candidate is made of whole runs of letters and digits;
it has an @ (or "at" in brackets) inside, or else no letter and DIGITS digits. Other spans cannot be candidates, so only
the surroundings of triggers are decoded; elsewhere the best labelling is "outside" in any case, and the result is that
of decoding the whole text. Runs of more than MAX_CHARS letters and digits are no part of a candidate; surroundings end
there and at most MAX_CHARS and a run from a trigger, so time is in proportion to the text.

The field is trained here, in one task, on a fixed number of generated sentences (TRAIN_SENTENCES); its weights
are a few thousand numbers.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, free_prefix, in_task, lean, quoted, tidy

#: The kinds, in their listed order.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Longest candidate, in tokens and in characters.
MAX_TOKENS, MAX_CHARS = 18, 64
#: Fewest and most digits of a candidate without an at sign.
DIGITS = (4, 21)
FEATURES = 1 << 12
TRAIN_SENTENCES, EPOCHS = 240, 8

# The base patterns. The lookbehinds only keep a failing run from being tried again at each of its characters.
_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a local part before it and a dotted domain after it; the local part begins after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _AT_DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all base spans, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_LONG_RUN = re.compile(rf"[^\W_]{{{MAX_CHARS + 1},}}")
_TRIGGER = re.compile(r"[0-9]{2,}|@|[(\[{] ?at ?[)\]}]|\b[0-9](?=[-. ()]{1,2}[0-9])")
#: A short text of this list before a span is a feature by itself.
_CUES = {"phone": "tel", "tel": "tel", "call": "tel", "mobile": "tel", "fax": "tel", "mail": "mail", "email": "mail", "contact": "mail", "ip": "net", "host": "net", "server": "net", "card": "card", "visa": "card", "pay": "card", "version": "count", "page": "count", "no": "count", "v": "count", "order": "count", "isbn": "count", "id": "count", "on": "date", "date": "date"}


def _f(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode()) % FEATURES


@lru_cache(maxsize=8_192)
def _span_features(span: str, cue: str, before: str, after: str) -> tuple[int, ...]:
    """Features of a whole candidate span; before and after are the classes of the characters next to it."""
    digits = _NOT_DIGIT.sub("", span)
    shape = re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}", re.sub(r"[^\W\d_]+", "a", span))
    coarse = re.sub(r"d[0-9]+", "d", shape)
    n = len(digits)
    low = span.lower()
    parts = span.split(".")
    out = [("bias",), ("n", min(n, 21)), ("shape", shape), ("coarse", coarse), ("edges", before, after), ("cue", cue)]
    out += [("first", shape[0]), ("last", coarse[-1]), ("firsts", shape[0], before), ("lasts", coarse[-1], after)]
    out.append(("luhn", 12 <= n <= 19 and luhn(digits), 12 <= n <= 19))
    out.append(("octets", len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)))
    out.append(("at", "@" in span, span.count("@"), bool(re.search(r"[(\[{] ?at ?[)\]}]", low))))
    mail = re.fullmatch(r"[\w.%+-]+(?:@| ?[(\[{] ?at ?[)\]}] ?)[\w-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[\w-]+)+", low)
    out.append(("mail", bool(mail), before in "ao_"))
    tel = bool(re.fullmatch(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}", span))
    out.append(("tel", tel, 9 <= n <= 15, cue))
    grouped = bool(re.fullmatch(r"[0-9]{4}(?:([ -])[0-9]{4}){2}(?:\1[0-9]{1,7})", span)) or bool(re.fullmatch(r"[0-9]{12,19}", span))
    out.append(("grouped", grouped, 12 <= n <= 19 and luhn(digits)))
    return tuple(_f(*x) for x in out)


@lru_cache(maxsize=8_192)
def _outside_features(token: str) -> tuple[int, ...]:
    shape = f"d{min(len(token), 21)}" if token.isdecimal() else "a" if token.isalpha() else "x" if token.isalnum() else token
    return (_f("out"), _f("out", shape), _f("outd", token.isdecimal()))


def _kind_of(text: str, i: int) -> str:
    """Class of the character at i: none, space, letter, digit or the sign itself."""
    if i < 0 or i >= len(text):
        return "^"
    c = text[i]
    return " " if c.isspace() else "d" if c.isdecimal() else "a" if c.isalnum() else c if c in ".,-+@()_/:" else "o"


class Lattice:
    """Tokens of a region and its candidate spans: (first token, end token, features)."""

    def __init__(self, text: str, lo: int, hi: int) -> None:
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        n = len(self.tokens)
        word = [text[a:b] for a, b in self.tokens]
        digits = [0, *accumulate(len(w) if w.isdecimal() else sum(map(str.isdecimal, w)) for w in word)]
        letters = [0, *accumulate(w.isalnum() and not w.isdecimal() for w in word)]
        signs = [0, *accumulate(w == "@" or w.lower() == "at" and 0 < k < n - 1 and word[k - 1] in "([{" and word[k + 1] in ")]}" for k, w in enumerate(word))]
        self.outside = [_outside_features(w) for w in word]
        self.by_end: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            a = self.tokens[i][0]
            if not (word[i].isalnum() or word[i] in "+("):
                continue
            cue = None
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                b = self.tokens[j - 1][1]
                if b - a > MAX_CHARS or (j - i > 1 and self.tokens[j - 1][0] - self.tokens[j - 2][1] > 2):
                    break
                if not word[j - 1].isalnum():
                    continue
                if signs[j] == signs[i] and (letters[j] > letters[i] or not DIGITS[0] <= digits[j] - digits[i] <= DIGITS[1]):
                    continue
                if j - i < 3 and not (word[i].isdecimal() and b - a >= 10):
                    continue
                span = text[a:b]
                if "\n" in span:
                    break
                if cue is None:
                    cue = next((c for w in reversed(word[max(0, i - 3) : i]) if (c := _CUES.get(w.lower()))), "")
                self.by_end[j].append((i, _span_features(span, cue, _kind_of(text, a - 1), _kind_of(text, b))))


def _regions(text: str) -> list[tuple[int, int]]:
    """Surroundings of triggers that hold every candidate span whole, between the runs that none begins or ends in."""
    out: list[tuple[int, int]] = []
    floor = 0
    for a, b in [*((m.start(), m.end()) for m in _LONG_RUN.finditer(text)), (len(text), len(text))]:
        own: list[list[int]] = []
        for m in _TRIGGER.finditer(text, floor, a):
            lo, hi = max(floor, m.start() - MAX_CHARS - 24), min(a, m.end() + MAX_CHARS + 8)
            while lo > floor and text[lo - 1].isalnum() and text[lo].isalnum():
                lo -= 1
            while hi < a and text[hi - 1].isalnum() and text[hi].isalnum():
                hi += 1
            if own and lo <= own[-1][1]:
                own[-1][1] = max(hi, own[-1][1])
            else:
                own.append([lo, hi])
        out += [(x, y) for x, y in own]
        floor = b
    return out


class Field:
    """Weights by feature and label, and by pair of labels in succession."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, len(LABELS)))
        self.t = np.zeros((len(LABELS), len(LABELS)))
        self.cache: dict[tuple[int, ...], list[float]] = {}

    def scores(self, features: tuple[int, ...]) -> list[float]:
        got = self.cache.get(features)
        if got is None:
            if len(self.cache) > 16_384:
                self.cache.clear()
            got = self.cache[features] = self.w[list(features)].sum(axis=0).tolist()
        return got

    def _arcs(self, x: Lattice, j: int) -> Iterator[tuple[int, tuple[int, ...], slice]]:
        yield j - 1, x.outside[j - 1], slice(0, 1)
        for i, f in x.by_end[j]:
            yield i, f, slice(1, len(LABELS))

    def decode(self, x: Lattice) -> list[tuple[int, int, int]]:
        """(first token, label, end token) of the entities of the best segmentation; ties go to the earlier label and the longer span."""
        n, labels = len(x.tokens), range(len(LABELS))
        t = self.t.tolist()
        best = [[0.0, *[-math.inf] * (len(LABELS) - 1)]]
        #: For each place and label: the best score of coming from there to that label, and the label it comes from.
        into: list[list[tuple[float, int]]] = []
        back: list[list[tuple[int, int]]] = [[(0, 0)] * len(LABELS)]
        for j in range(1, n + 1):
            before = best[-1]
            into.append([max(((before[p] + t[p][y], -p) for p in labels)) for y in labels])
            score, way = [-math.inf] * len(LABELS), [(0, 0)] * len(LABELS)
            s, p = into[j - 1][0]
            score[0], way[0] = s + self.scores(x.outside[j - 1])[0], (j - 1, -p)
            for i, f in x.by_end[j]:
                own, come = self.scores(f), into[i]
                for y in labels[1:]:
                    s, p = come[y]
                    if s + own[y] > score[y]:
                        score[y], way[y] = s + own[y], (i, -p)
            best.append(score)
            back.append(way)
        out, j, y = [], n, max(labels, key=lambda y: best[n][y])
        while j > 0:
            i, prev = back[j][y]
            if y:
                out.append((i, y, j))
            j, y = i, prev
        return out[::-1]

    def learn(self, x: Lattice, gold: dict[tuple[int, int], int], g2: tuple[np.ndarray, np.ndarray], rate: float) -> None:
        """One AdaGrad step up the log-likelihood of the gold segmentation: observed less expected features."""
        n, k = len(x.tokens), len(LABELS)
        a = np.full((n + 1, k), -np.inf)
        a[0, 0] = 0
        arcs = [[] if j == 0 else list(self._arcs(x, j)) for j in range(n + 1)]
        for j in range(1, n + 1):
            for i, f, labels in arcs[j]:
                a[j, labels] = np.logaddexp(a[j, labels], np.logaddexp.reduce(a[i][:, None] + self.t[:, labels], axis=0) + np.array(self.scores(f))[labels])
        z = np.logaddexp.reduce(a[n])
        b = np.full((n + 1, k), -np.inf)
        b[n] = 0
        dw: dict[int, np.ndarray] = {}
        dt = np.zeros_like(self.t)
        for j in range(n, 0, -1):
            for i, f, labels in arcs[j]:
                s = self.t[:, labels] + (np.array(self.scores(f))[labels] + b[j, labels])[None, :]
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(s, axis=1))
                p = np.exp(a[i][:, None] + s - z)
                d = -p.sum(axis=0)
                dt[:, labels] -= p
                if labels.start and (y := gold.get((i, j))):
                    d[y - 1] += 1
                elif not labels.start and not any(u <= i < v for u, v in gold):
                    d[0] += 1
                if np.abs(d).max() > 1e-6:
                    for q in f:
                        dw.setdefault(q, np.zeros(k))[labels] += d
        prev = 0
        at = 0
        by_start = {u: (v, y) for (u, v), y in gold.items()}
        while at < n:
            at, y = by_start.get(at, (at + 1, 0))
            dt[prev, y] += 1
            prev = y
        rows = np.array(list(dw))
        if len(rows):
            grad = np.stack([dw[q] for q in rows.tolist()]) - 1e-3 * self.w[rows]
            g2[0][rows] += grad**2
            self.w[rows] += rate * grad / np.sqrt(g2[0][rows] + 1e-6)
        g2[1][...] += dt**2
        self.t += rate * dt / np.sqrt(g2[1] + 1e-6)
        self.cache.clear()


def _sentences(rng: random.Random, n: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their spans: personal data in many forms, and numbers that are none."""
    syllables = ("ka", "ri", "to", "men", "sol", "the", "an", "de", "ver", "lo", "qui", "st")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = str(rng.choice((3, 4, 5, 6))) + num(rng.choice((11, 13, 14, 14, 14, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def bad_card() -> str:
        d = num(rng.choice((12, 16, 16, 17)))
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    def email() -> str:
        at, dot = rng.choice((("@", "."),) * 3 + ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", ".")))
        return rng.choice((word(), word() + "." + num(2), word() + "_" + word())) + at + word() + num(rng.choice((0, 1))) + dot + rng.choice(("com", "org", "net", "example" + dot + "com", "de"))

    def phone() -> str:
        return rng.choice((f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}"))

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    none = (
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}",
        lambda: f"{rng.randint(0, 99)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}",
        lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}",
        lambda: num(rng.randint(1, 11)),
        bad_card,
        lambda: f"{rng.randint(1, 999)},{num(3)}.{num(2)}",
        lambda: f"{num(2)} {num(3)} {num(2)}",
        lambda: f"@{word()}",
        lambda: f"{word()} @ {word()}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"",
        lambda: f"{num(4)}-{num(4)}",
        lambda: " ".join(num(rng.randint(1, 3)) for _ in range(6)),
    )
    some = (email, ip, card, phone)
    cues = (("email", "contact", "mail"), ("host", "server", "ip"), ("card", "visa", "pay"), ("call", "tel", "phone"))
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.55:
                y = rng.randrange(4)
                text += rng.choice(cues[y]) + rng.choice((" ", ": ")) if rng.random() < 0.3 else ""
                s = some[y]()
                spans.append((len(text), y + 1, len(text) + len(s)))
                text += s
            else:
                text += rng.choice(("", "version ", "page ", "no ", "order ")) + rng.choice(none)()
            text += rng.choice((" ", " ", ", ", ". ", "%%% ", "&&& ", "### ", " | "))
        yield text + word() + ".", spans


def trained(seed: int = 11, n: int = TRAIN_SENTENCES, epochs: int = EPOCHS) -> Field:
    """The field, fitted to n generated sentences; the same on every run."""
    rng, field = random.Random(seed), Field()
    g2 = (np.zeros_like(field.w), np.zeros_like(field.t))
    data = []
    for text, spans in _sentences(rng, n):
        x = Lattice(text, 0, len(text))
        start = {a: i for i, (a, _) in enumerate(x.tokens)}
        end = {b: i + 1 for i, (_, b) in enumerate(x.tokens)}
        gold = {(start[s], end[e]): y for s, y, e in spans}
        known = {(i, j) for j, arcs in enumerate(x.by_end) for i, _ in arcs}
        if gold.keys() <= known:
            data.append((x, gold))
    for epoch in range(epochs):
        rng.shuffle(data)
        for x, gold in data:
            field.learn(x, gold, g2, 0.5 / (1 + epoch / 4))
    _span_features.cache_clear()
    del data
    tidy()
    return field


#: The trained weights, a few hundred KB, once they are there: the training has no input but its parameters.
_WEIGHTS: list[tuple[np.ndarray, np.ndarray]] = []


def weights(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, trained in a task the first time."""

    def fit(_: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
        field = trained()
        return field.w.astype(np.float32), field.t

    if not _WEIGHTS:
        _WEIGHTS.append(in_task(spark.range(1), fit))
    return _WEIGHTS[0]


def crf_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the field's entities in a whole text."""
    out = []
    for lo, hi in _regions(text):
        x = Lattice(text, lo, hi)
        if any(x.by_end):
            out += [(x.tokens[i][0], y - 1, x.tokens[j - 1][1]) for i, y, j in field.decode(x)]
    return out


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with what the field adds beside them."""
    base = base_spans(text)
    if "@" not in text and not _DIGIT.search(text) and not _TRIGGER.search(text):
        return base, base
    more = [x for x in crf_spans(text, field) if not any(x[0] < e and s < x[2] for s, _, e in base)]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans that overlap replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, masked string"


def pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask: bool = True, prefix: str = "") -> DataFrame:
    """One row per row of docs: the columns in keep, counts and digest of base spans, all spans, their number, and the masked text.

    Null text counts as empty and has no spans (masked is then null); repeated rows each give a row; an empty table
    gives an empty one. Columns not in keep are left aside; `prefix` goes before the names of the new columns, where
    keep has such names itself. Narrow: no shuffle.
    """
    w, t = weights(docs.sparkSession)
    n = len(keep)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        field.w, field.t = w.astype(float), t
        for batch in batches:
            for part in chunks(batch, "__t"):
                rows = []
                for x in part.column(n).to_pylist():
                    base, every = find(x or "", field)
                    counts = [sum(y[1] == i for y in base) for i in range(4)]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every), None if x is None or not mask else masked(x, every)))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *[pa.array(c, ty) for c, ty in zip(zip(*rows), types)]], names=[*(f"__c{i}" for i in range(n)), *(f"__v{i}" for i in range(len(names)))])

    schema = ", ".join([f"__c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"__v{i} {f.split()[1]}" for i, f in enumerate(SCHEMA.split(", "))])
    got = docs.select(*[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(keep)], F.col(quoted(text)).cast("string").alias("__t")).mapInArrow(lean(run), schema)
    return got.toDF(*keep, *(prefix + c for c in names))


def without_pii(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced by its kind in angle brackets, and the size following the text.

    A null text stays null, and a text without spans stays as it is, with its size. Other columns stay as they are,
    whatever their names; repeated rows each stay; an empty table gives an empty one.
    """
    own = free_prefix(docs)
    got = pii(docs, text, tuple(docs.columns), prefix=own)
    changed, new = F.col(own + "n_spans") > 0, F.col(own + "masked")
    return got.withColumns({text: F.when(changed, new).otherwise(F.col(quoted(text))), size: F.when(changed, F.char_length(new).cast("long")).otherwise(F.col(quoted(size)))}).select(*map(quoted, docs.columns))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans' counts and digest, and all spans, of every document."""
    return pii(documents(spark, sf_dir), mask=False).drop("masked")
