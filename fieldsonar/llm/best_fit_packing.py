"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenised, cut into pieces of at most the sequence length, and dealt into shards of bounded size. Each
shard is packed by several islands: a chromosome is a list of bins, crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold the same documents and best-fits the documents so displaced. Mutation
empties the least filled bins and some others and refills them one by one as full as their documents allow. After each
round the islands' elites migrate to the next island. An island stops where a lower bound proves it optimal.

What the shards' least filled bins hold is dealt into shards again, until one shard is left, so that no shard keeps a
half-empty last bin to itself.
"""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bytes_of, chunks, documents, lean, mixed, quoted, remove, text_column, written

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0
#: Pieces in a shard, on average; every shard packs by itself.
SHARD = 4096
ISLANDS, ROUNDS, POPULATION, GENERATIONS, ELITES = 3, 2, 6, 8, 2
#: A shard gives back at most this share of its pieces, of its least filled bins, where less than that of a bin is full.
GIVEN_BACK, FULL = 1 / 8, 0.97
#: Bins that a mutation empties.
MIXED = 48
#: Words whose ids a worker remembers, from task to task.
CACHE_WORDS = 1_000_000
#: Bytes of text that are encoded at once.
ENCODED = 4_000_000

PIECE = "doc {kind}, piece int, start long, length int, ids_crc32 long, salt long"


_ONE_KIND = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:;=?@\[-`{}~]+")
_LETTER, _SIGN, _OTHER = 1, 2, 0
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
#: ASCII signs, but for an apostrophe (contractions) and what special tokens are written with.
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = _SIGN


class Parts(Words):
    """Words of texts, cut further between letters and signs; `simple` marks parts of one kind alone.

    Letters are those of ASCII and two-byte Latin ones; no cut is made beside any other character.
    """

    def __init__(self, texts: pa.Array) -> None:
        special = b"<|" in bytes_of(texts)[0].tobytes()
        super().__init__(texts, lower=not special)
        kind = _KIND[self.raw]
        latin = np.zeros(len(kind), dtype=bool)
        if len(kind) > 1:
            latin[:-1] = (self.raw[:-1] == 0xC3) & (self.raw[1:] != 0x97) & (self.raw[1:] != 0xB7)
            latin[1:] |= latin[:-1]
        kind[latin] = _LETTER
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != _OTHER) & (kind[:-1] != _OTHER)) + 1 if not special else np.zeros(0, np.int64)
        # white space is of no kind, so a cut is always inside a word, but may be between two texts
        cut = np.setdiff1d(cut, self.starts, assume_unique=True)
        self.starts, self.ends = np.sort(np.concatenate([self.starts, cut])), np.sort(np.concatenate([self.ends, cut]))
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)


class WordTokenizer:
    """Ids of texts by a tokenizer file, each distinct part of a word encoded once.

    Right for lower-casing tokenizers that cut texts at white space and between letters and signs and whose last id of
    each such part has an end mark.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) < 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, self.kind)
        self.bounds = np.zeros(1, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        """Parts of one kind go in groups, split again at the end marks; others one by one."""
        plain = [x for x in words if _ONE_KIND.fullmatch(x)]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        flat, size, order = [], [], []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(g) and ends[-1] == len(ids):
                flat.append(ids)
                size.append(np.diff(ends, prepend=0))
                order += g
        done = set(order) if len(order) < len(words) else ()
        rest = [x for x in words if x not in done] if done else ([] if order else words)
        for x, e in zip(rest, self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)):
            flat.append(np.array(e.ids, self.kind))
            size.append(np.array([len(e.ids)]))
            order.append(x)
        if not order:
            return
        new, n, at = np.concatenate(flat), np.concatenate(size), int(self.bounds[-1])
        while at + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(new)] = new
        self.known.update(zip(order, range(len(self.bounds) - 1, len(self.bounds) - 1 + len(order))))
        self.bounds = np.concatenate([self.bounds, (at + np.cumsum(n)).astype(np.int32)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's bounds in them."""
        w = Parts(texts)
        number, words = w.ids()
        words = words.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.forget()
        self._learn([x for x in words if x not in self.known])
        slot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        # 32 bits hold the places in a chunk and in what is remembered
        begin, size = self.bounds[slot][number], (self.bounds[slot + 1] - self.bounds[slot])[number]
        total = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=total[1:])
        at = np.repeat(begin - total[:-1], size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], total[w.first]


_LOADED: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every row of docs: doc, piece, start, length, ids_crc32, salt and, if asked for, their ids.

    Null text counts as empty and has the end id only; repeated rows each have their pieces. Narrow: no shuffle.
    """
    schema = PIECE.format(kind=docs.schema[key].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordTokenizer(tokenizer)
        encode, done = _LOADED[tokenizer], TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in chunks(batch, "t", ENCODED):
                ids, bounds = encode(part.column(1))
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                end = np.array([END_ID], "<u4")
                for i in range(part.num_rows):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]].astype("<u4"), end])
                    for p, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(cut.astype(np.int32))
                salt = mixed(np.arange(done, done + len(row), dtype=np.uint64)).view(np.int64)
                done += len(row)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(salt)]
                names = ["doc", "piece", "start", "length", "ids_crc32", "salt"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(quoted(key)).alias("k"), text_column(docs, text).alias("t")).mapInArrow(lean(run), schema)


class Shard:
    """One bin-packing problem; a packing is a list of bins, a bin a list of item numbers."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.capacity, self.size = capacity, lengths
        self.whole = [[i] for i, n in enumerate(lengths) if n == capacity]
        self.items = [i for i, n in enumerate(lengths) if n < capacity]
        self.bound = self._bound()

    def _bound(self) -> int:
        """The L2 lower bound: items over half a bin, and what no split of the rest can save."""
        s = np.sort(np.array([self.size[i] for i in self.items], np.int64))
        if not len(s):
            return 0
        c, total = self.capacity, np.concatenate([[0], np.cumsum(s)])
        best = math.ceil(int(s.sum()) / c)
        for k in {0, *s[s <= c // 2].tolist()}:
            big = len(s) - int(np.searchsorted(s, c - k, side="right"))
            lo, mid, hi = (int(np.searchsorted(s, x, side=y)) for x, y in ((k, "left"), (c // 2, "right"), (c - k, "right")))
            half = hi - mid
            rest = total[mid] - total[lo] - (half * c - (total[hi] - total[mid]))
            best = max(best, big + half + max(0, math.ceil(int(rest) / c)))
        return best

    def fill(self, bins: list[list[int]], order: list[int]) -> list[list[int]]:
        """Put items, in this order, each where it fits best. A bit set of free sizes finds the bin in one step."""
        free: dict[int, list[int]] = {}
        mask = 0
        for b, items in enumerate(bins):
            if room := self.capacity - sum(map(self.size.__getitem__, items)):
                free.setdefault(room, []).append(b)
                mask |= 1 << room
        for i in order:
            n = self.size[i]
            if fits := mask >> n:
                room = n + (fits & -fits).bit_length() - 1
                stack = free[room]
                b = stack.pop()
                if not stack:
                    mask ^= 1 << room
                bins[b].append(i)
            else:
                room, b = self.capacity, len(bins)
                bins.append([i])
            if room > n:
                free.setdefault(room - n, []).append(b)
                mask |= 1 << room - n
        return bins

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then bins filled unevenly (squared fill), as those leave room that can be used."""
        return -len(bins), sum(sum(map(self.size.__getitem__, b)) ** 2 for b in bins)

    def crossed(self, a: list[list[int]], b: list[list[int]], rng: random.Random) -> list[list[int]]:
        full = sorted(b, key=lambda x: -sum(map(self.size.__getitem__, x)))
        full = full[: max(1, len(full) // 2)]
        put = rng.sample(full, max(1, len(full) // 2))
        inside = {i for x in put for i in x}
        stay, out = [list(x) for x in put], []
        for x in a:
            if inside.isdisjoint(x):
                stay.append(list(x))
            else:
                out += [i for i in x if i not in inside]
        return self.fill(stay, sorted(out, key=lambda i: -self.size[i]))

    def fullest(self, items: list[int], room: int) -> list[int]:
        """Of items, in descending size, some that fill a room as far as any do: subset sums as bits of a number."""
        mask, reach = (1 << room + 1) - 1, [1]
        for i in items:
            reach.append(reach[-1] | reach[-1] << self.size[i] & mask)
            if reach[-1] >> room:
                break
        at, out = reach[-1].bit_length() - 1, []
        for k in range(len(reach) - 1, 0, -1):
            if at and not reach[k - 1] >> at & 1:  # only with this item
                out.append(items[k - 1])
                at -= self.size[items[k - 1]]
        return out

    def refilled(self, a: list[list[int]], rng: random.Random) -> list[list[int]]:
        """Empties the least filled bins and some others, and fills bins with what they held, each as full as can be."""
        order = sorted(range(len(a)), key=lambda b: sum(map(self.size.__getitem__, a[b])))
        some = max(2, min(len(a), MIXED) // 2)
        drop = {*order[:some], *rng.sample(range(len(a)), min(len(a), some))}
        out = sorted((i for b in drop for i in a[b]), key=lambda i: -self.size[i])
        kept = [list(x) for b, x in enumerate(a) if b not in drop]
        while out:
            first = out[0]
            rest = out[1:]
            if rng.random() < 0.5:  # not always the largest that fit: another order gives another packing
                part = rest[:]
                rng.shuffle(part)
                part = sorted(part[: max(8, len(part) // 2)], key=lambda i: -self.size[i])
                mine = self.fullest(part, self.capacity - self.size[first])
                if self.size[first] + sum(map(self.size.__getitem__, mine)) < self.capacity:
                    mine = self.fullest(rest, self.capacity - self.size[first])
            else:
                mine = self.fullest(rest, self.capacity - self.size[first])
            kept.append([first, *mine])
            gone = {first, *mine}
            out = [i for i in out if i not in gone]
        return kept

    def evolve(self, elites: list[list[list[int]]], seed: int) -> list[list[list[int]]]:
        """The best packings after some generations, best first."""
        if not self.items:
            return [[]]
        rng = random.Random(seed)
        rated = lambda bins: (self.fitness(bins), bins)
        crowd = [rated(x) for x in elites]
        while len(crowd) < POPULATION:
            spread = 0 if not crowd else 0.3
            crowd.append(rated(self.fill([], sorted(self.items, key=lambda i: -self.size[i] * (1 - spread * rng.random())))))
            if len(crowd[-1][1]) <= self.bound:
                return [crowd[-1][1]]
        crowd.sort(key=lambda x: x[0], reverse=True)
        for _ in range(GENERATIONS):
            if len(crowd[0][1]) <= self.bound:
                break
            (_, a), (_, b) = rng.sample(crowd, 2)
            young = [self.crossed(a, b, rng), self.refilled(self.crossed(b, a, rng), rng), self.refilled(crowd[0][1], rng)]
            crowd = sorted(crowd + [rated(x) for x in young], key=lambda x: x[0], reverse=True)[:POPULATION]
        return [bins for _, bins in crowd[:ELITES]]


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [-1] * n
    for b, items in enumerate(bins):
        for i in items:
            out[i] = b
    return out


def _bins(labels: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, b in enumerate(labels):
        if b >= 0:
            out[b].append(i)
    return out


def _round(shards: DataFrame, number: int, capacity: int) -> DataFrame:
    """One round on every island: shard, island, lengths, elites (each a bin number for every item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["lengths"], capacity)
                got = shard.evolve([_bins(x) for x in r["elites"]], r["shard"] * 1009 + r["island"] * 31 + number)
                labels = [_labels(x, len(r["lengths"])) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([len(got[0])], pa.int32()), pa.array([labels], pa.list_(pa.list_(pa.int32())))],
                    names=["shard", "island", "bins", "elites"],
                )

    return shards.mapInArrow(lean(run), "shard long, island int, bins int, elites array<array<int>>")


def given_back(lengths: list[int], labels: list[int], capacity: int, share: float) -> set[int]:
    """The least filled bins that a shard gives back: less than FULL, and with such a share of its pieces at most."""
    fill, held = Counter(), Counter()
    for n, b in zip(lengths, labels):
        if b >= 0:
            fill[b] += n
            held[b] += 1
    out, room = set(), int(share * len(lengths))
    for b in sorted(fill, key=lambda b: (fill[b], b)):
        if fill[b] >= FULL * capacity or held[b] > room:
            break
        out.add(b)
        room -= held[b]
    return out


def _packed_shards(cut: DataFrame, shards: int, level: int, capacity: int) -> tuple[DataFrame, list[DataFrame]]:
    """Every piece with sequence_id and offset, null where its shard gives it back; and the tables that this has written."""
    spark = cut.sparkSession
    item = F.struct("salt", "doc", "piece", "start", "length", "ids_crc32")
    grouped = written(cut.withColumn("shard", F.pmod("salt", F.lit(shards)).cast("long")).groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items")), "pack-shards")
    made = [grouped]
    problem = grouped.select("shard", F.col("items.length").alias("lengths"))
    none = F.array().cast("array<array<int>>")
    state = problem.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), none.alias("elites"))
    tasks = min(shards * ISLANDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8))
    for number in range(ROUNDS):
        elites = written(_round(state.select("shard", "island", "lengths", "elites").repartition(tasks, "shard", "island"), number, capacity), "pack-elites")
        made.append(elites)
        # ring migration: each island goes on with its own elites and the best of the island before it
        near = elites.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("elites", 1, 1).alias("guest"))
        state = elites.join(near, ["shard", "island"]).join(problem, "shard").select("shard", "island", "lengths", F.concat("elites", "guest").alias("elites"))
    best = elites.groupBy("shard").agg(F.min_by(F.col("elites")[0], F.struct("bins", "island")).alias("labels"))
    share = 0.0 if shards == 1 else GIVEN_BACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, labels, number in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                used, offset, sequence = {}, [], []
                back = given_back(lengths, labels, capacity, share)
                alone = max(labels, default=-1) + 1
                for n, b in zip(lengths, labels):
                    if b in back:
                        offset.append(None)
                        sequence.append(None)
                        continue
                    if b < 0:  # a whole sequence by itself
                        b, alone = alone, alone + 1
                    offset.append(used.get(b, 0))
                    used[b] = offset[-1] + n
                    sequence.append(level << 58 | number << 24 | b)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sequence], pa.list_(pa.int64())), pa.array([offset], pa.list_(pa.int64()))], names=["shard", "sequence_id", "offset"])

    placed = problem.join(best, "shard").select("lengths", "labels", "shard").mapInArrow(lean(place), "shard long, sequence_id array<long>, offset array<long>")
    rows = grouped.join(placed, "shard").select(F.explode(F.arrays_zip("items", "sequence_id", "offset")).alias("x"))
    return rows.select("x.items.doc", "x.items.piece", "x.items.start", "x.items.length", "x.items.ids_crc32", "x.items.salt", "x.sequence_id", "x.offset"), made


def pack(cut: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Places for the pieces of a written table (columns doc, piece, start, length, ids_crc32, salt): sequence_id, offset.

    Every piece is placed once; sequences hold at most `capacity` ids and have no gaps. Rows of one document, or equal
    rows, spread over all shards by their salt, so that no key makes a shard large. Levels go on while there is more
    than one shard; each has at most GIVEN_BACK of the pieces of the one before. An empty table gives an empty one.
    """
    out, level = None, 0
    while True:
        count = cut.count()
        if level and not count:
            break
        shards = max(1, math.ceil(count / shard))
        rows, made = _packed_shards(cut, shards, level, capacity)
        rows = written(rows, "packed")
        remove(cut.sparkSession, *made)
        here = rows.where("sequence_id is not null")
        out = here if out is None else out.unionByName(here)
        if shards == 1:
            break
        cut, level = rows.where("sequence_id is null").drop("sequence_id", "offset"), level + 1
    return out.select("doc", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of docs with their places; see pieces() and pack() for odd input."""
    cut = written(pieces(docs, tokenizer or default_tokenizer(), capacity, key, text), "pack-pieces")
    return pack(cut, capacity).withColumnRenamed("doc", key)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 ids, and their places in sequences of that length."""
    return packed(documents(spark, sf_dir))
