"""Periodic runs of words: stretches that repeat with a smallest period q over at least four periods (and six words).

Bit-parallel lags. A text's words get numbers; bit b of every number makes plane b, one big integer with a bit for each
word. For a lag q the planes are XORed with themselves shifted by q and the results ORed: a zero bit is a word equal to
the word q further on. A run of length L is a stretch of L - q such zeros, and ANDs of the complement with itself under
doubling shifts leave a bit only where a stretch of the least length begins.

Trying every lag of a long text would cost the square of its length, so lags come from the text: within a run of
period q a window of W words, q < W <= 2 q, next occurs exactly q further on, and does so from at least
max(6, 4 q) - q - W + 1 places in a row. Windows of 2, 4, 8 ... words are named exactly, by pairs of names, over all
texts of a chunk at once; only windows that occur again in their text go on to the next width. Lags that no window
proposes have no run, and those proposed are few (about the square root of the words at most), so nothing is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, documents, lean, quoted, text_column

MIN_LENGTH, MIN_PERIODS = 6, 4
#: Lags whose equal words are remembered for their multiples; others are worked out again.
KNOWN = 16


def least_length(q: int) -> int:
    return max(MIN_LENGTH, MIN_PERIODS * q)


def proposed_lags(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """For each text (its words' numbers lie from first[i] to first[i + 1]) every lag that may have a run, and few others."""
    n, texts = len(ids), len(first) - 1
    doc = np.repeat(np.arange(texts), np.diff(first))
    out: list[list[int]] = [[] for _ in range(texts)]
    names = ids.astype(np.int64)  # of the window of `width` words from each place on; -1: leaves the text or does not occur again
    width = 1
    at = np.arange(n)
    while len(at):
        follow = at + width
        fits = follow < n
        at, follow = at[fits], follow[fits]
        fits = (doc[at] == doc[follow]) & (names[at] >= 0) & (names[follow] >= 0)
        at, follow = at[fits], follow[fits]
        if not len(at):
            break
        pair = names[at] * (int(names.max()) + 1) + names[follow]
        width *= 2
        order = np.argsort(pair, kind="stable")  # equal windows by place, so those of a text lie together
        place, pair = at[order], pair[order]
        same = np.zeros(len(place) + 1, bool)  # as the one before, in the same text
        same[1:-1] = (pair[1:] == pair[:-1]) & (doc[place[1:]] == doc[place[:-1]])
        again = same[:-1] | same[1:]
        names = np.full(n, -1, np.int64)
        names[place[again]] = np.cumsum(~same[:-1])[again]
        # the distance to the next occurrence, of windows no longer than twice it
        ahead = np.zeros(n, np.int64)
        ahead[place[:-1][same[1:-1]]] = (place[1:] - place[:-1])[same[1:-1]]
        ahead[(ahead < width // 2) | (ahead >= width)] = 0
        hits = np.flatnonzero(ahead)
        if len(hits):
            opens = np.ones(len(hits), bool)
            opens[1:] = (np.diff(hits) > 1) | (np.diff(ahead[hits]) != 0) | (np.diff(doc[hits]) != 0)
            begin = np.flatnonzero(opens)
            long = np.diff(np.append(begin, len(hits)))
            q = ahead[hits[begin]]
            enough = long >= np.maximum(MIN_LENGTH, MIN_PERIODS * q) - q - width + 1
            for d, lag in set(zip(doc[hits[begin[enough]]].tolist(), q[enough].tolist())):
                out[d].append(lag)
        at = np.flatnonzero(names >= 0)
    return [sorted(lags) for lags in out]


class Planes:
    """Bit planes of a sequence of numbers as big integers, and where it equals itself shifted."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        bits = int(ids.max()).bit_length() if self.n else 0
        self.planes = [int.from_bytes(np.packbits(((ids >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]
        self._known: dict[int, int] = {}

    def equal(self, q: int) -> int:
        """Bit i: word i and word i + q are equal."""
        if q not in self._known:
            differs = 0
            for plane in self.planes:
                differs |= plane ^ (plane >> q)
            every = (1 << (self.n - q)) - 1
            if len(self._known) >= KNOWN:
                self._known.pop(next(iter(self._known)))
            self._known[q] = (differs & every) ^ every
        return self._known[q]

    def runs(self, q: int) -> list[tuple[int, int, int]]:
        """(start, length, q) of the maximal runs with smallest period q."""
        least = least_length(q) - q
        stretch, have = self.equal(q), 1
        while have < least and stretch:
            step = min(have, least - have)
            stretch &= stretch >> step
            have += step
        if not stretch:
            return []
        flags = np.unpackbits(np.frombuffer(stretch.to_bytes(self.n // 8 + 1, "little"), np.uint8), bitorder="little")
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
        smaller = [q // p for p in _primes(q)]
        out = []
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = e - 1 - s + least + q
            # over four periods or more a smaller period divides q
            if not any(self._all_equal(d, s, length - d) for d in smaller):
                out.append((s, length, q))
        return out

    def _all_equal(self, q: int, start: int, count: int) -> bool:
        every = (1 << count) - 1
        return (self.equal(q) >> start) & every == every


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def runs_of(ids: np.ndarray, lags: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start, then period."""
    if not lags:
        return []
    planes = Planes(ids)
    return sorted((r for q in lags for r in planes.runs(q)), key=lambda r: (r[0], r[2]))


def planted(keys: list, counts: np.ndarray) -> np.ndarray:
    """For each word of all texts in turn, the place within its text that it is taken from: a tenth of the texts repeat a period up to their end."""
    out = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = 0
    for key, n in zip(keys, counts.tolist()):
        if n and key is not None and (h := zlib.crc32(str(key).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[at + a : at + n] = a + np.arange(n - a) % p
        at += n
    return out


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: key, how many runs, the longest one, digests of all runs and of the collapsed words, and the collapsed text.

    Collapsed is what is left when every run keeps its first period alone, joined by spaces (null without keep_text).
    With `plant` a tenth of the texts are first given a run, by their key; a null key plants none. Null, empty and
    blank texts have no words: no runs, and the digests of nothing. The longest run is by length, then smallest start,
    then period. Any number of equal rows or keys is fine, each row is by itself; an empty table gives an empty one;
    other columns are left aside. One pass without a shuffle. A text costs about n log n in its n words, and n^1.5 / 64
    for the lags that it may have runs of, however it is made; it is held whole by one task.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", *[c.split()[0] for c in SCHEMA.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                w = Words(part.column(1))
                counts, first = w.counts, w.first
                words = w.array()
                ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if plant:
                    source = planted(part.column(0).to_pylist(), counts) + np.repeat(first[:-1], counts)
                    words, ids = words.take(pa.array(source)), ids[source]
                kept = np.ones(len(ids), bool)
                rows: list[tuple] = []
                for i, lags in enumerate(proposed_lags(ids, first)):
                    own = np.unique(ids[first[i] : first[i + 1]], return_inverse=True)[1] if lags else ids[:0]
                    found = runs_of(own, lags)
                    for s, length, q in found:
                        kept[first[i] + s + q : first[i] + s + length] = False
                    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
                    rows.append((len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest))
                left = np.concatenate([[0], np.cumsum(kept)])[first].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(left), words if kept.all() else words.filter(pa.array(kept)))
                joined = pc.binary_join(lists, b" ")
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()])]
                texts = joined.cast(pa.string()) if keep_text else pa.nulls(len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.array(digests, pa.string()), texts], names=names)

    rows = docs.select(F.col(quoted(key)).alias("key"), text_column(docs, text).alias("t"))
    return rows.mapInArrow(lean(run), f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a planted run: the runs and what is left of the words without them."""
    return periodic_runs(documents(spark, sf_dir), plant=True, keep_text=False).drop("collapsed")
