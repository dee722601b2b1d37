"""N-gram Jaccard join, exact, in size-banded tiles with hashed bitmap signatures.

A document's set is its distinct word n-grams (64-bit hashes, sorted). Documents with equal sets are one class. For a
similarity of t, two classes can link only if they share one of the first n - ceil(t n) + 1 n-grams in any common
order, and if their sizes differ by no more than t; the order puts n-grams that are frequent in the corpus last, so
that a common passage opens no tile. What is frequent is read off a sketch of signed counters, whose noise grows with
the root of the corpus and not with the corpus.

A tile is the classes with such an n-gram; one of more than TILE classes is cut into bands of sizes, each a factor of
1 / t wide, and a band into parts of about TILE classes, so that what may link is in one band or two adjoining ones. In
a tile the parity bitmaps of two sets bound their overlap from above: bits that differ are n-grams that are not shared.
Pairs that this leaves are settled on the sorted arrays.

Only components are wanted, so nothing is compared whose component is known already, and no table of pairs is made:
tasks return forests, at most one edge a class. First the bitmaps, tile by tile, join what may link into groups; then
each group's texts come together once and links are settled on the sorted arrays, in parts of bounded size. Classes
of a large tile or group that end in different components also meet across its parts, each those of its own band and
the two beside it, so no link is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Words, chunks, documents, free_prefix, lean, mixed, quoted, remove, summed, text_column, written

#: Signed counters for the frequency of n-grams; a table of two bytes for each is broadcast.
COUNTERS = 1 << 20
#: Least count of a frequent n-gram, where the counters' noise is not more than a sixth of it.
FREQUENT = 256
#: Bits of the largest and smallest bitmap.
MOST_BITS, LEAST_BITS = 1 << 14, 1 << 8
#: Classes of a tile, or of a group, that are held at once.
TILE = 2048
#: Memory for the wide bitmaps of a part.
WIDE_BYTES = 1 << 26
_BASE = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Measure:
    """Words in an n-gram, and the least similarity as a percentage."""

    width: int
    percent: int

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1

    def band(self, n: Column) -> Column:
        """Number of a size's band. Bands are a trifle wider than the similarity allows, so sizes that fit are never two apart."""
        return F.floor(F.log(n.cast("double")) / (math.log(100 / self.percent) * (1 + 1e-9))).cast("int")


def shingle_sets(texts: pa.Array, width: int, distinct: bool = True) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes (or all of them, unsorted). Fewer words than the width are one n-gram."""
    w = Words(texts, lower=True)
    ids, words = w.ids()
    digest = xxhash.xxh3_64_intdigest
    code = np.fromiter((digest(x) for x in words.to_pylist()), np.uint64, len(words))[ids]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(code) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + code[k : len(code) - width + 1 + k]
        rolled = mixed(rolled)
    out = []
    first = w.first.tolist()
    for i in range(w.n_docs):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            got = rolled[a : b - width + 1]
            if distinct:
                got = np.sort(got)
                if len(got) > 1:
                    got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif b > a:
            got = np.array([digest(code[a:b].tobytes(), seed=b - a)], np.uint64)
        else:
            got = np.zeros(0, np.uint64)
        out.append(got)
    return out


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams at each bit, as 64-bit words; about as many bits as n-grams."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(grams) - 1).bit_length()))
    parity = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) brought to a smaller number of words; parity is kept under xor."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _cell(grams: np.ndarray) -> np.ndarray:
    """Counter (all bits but the last) and sign (the last) of each n-gram."""
    return (grams >> np.uint64(63 - COUNTERS.bit_length() + 1)).astype(np.int64)


def heat(docs: DataFrame, width: int) -> np.ndarray:
    """Rank of each counter and sign: 0 for n-grams that are not frequent. Counts cover all documents.

    An n-gram adds its sign to its counter, so that the many rare ones cancel out. Their noise is the counters' median
    size; one that stands out of it is the count of a frequent n-gram of that sign. Errors cost time and change nothing.
    """

    def count(part: pa.RecordBatch, total: np.ndarray) -> None:
        cell = _cell(np.concatenate(shingle_sets(part.column(0), width, distinct=False)))
        np.add.at(total, cell >> 1, 2 * (cell & 1) - 1)

    total = summed(docs.select(text_column(docs).alias("t")), count, COUNTERS)
    noise = float(np.median(np.abs(total))) / 0.6745
    out = np.zeros((COUNTERS, 2), np.uint8)
    for k, sign in enumerate((-1, 1)):  # few counters stand out, so nothing as long as all of them is made
        some = np.flatnonzero(sign * total >= max(FREQUENT, 6 * noise))
        out[some, k] = 1 + np.floor(np.log2(sign * total[some] / max(FREQUENT, 6 * noise)))
    return out.ravel()


def _row_key(docs: DataFrame, key: str, text: str) -> Column:
    """Equal for rows of equal keys and texts. A null key is like no other."""
    own = F.col(quoted(key)).cast("string")
    return F.concat_ws(":", F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), own)), F.hex(F.xxhash64(F.col(quoted(text)))))


def signatures(docs: DataFrame, measure: Measure, key: str, text: str) -> DataFrame:
    """doc, row, node (the class, 0 for an empty set), n; and once a class and task: its prefix and bitmap. Written."""
    levels = docs.sparkSession.sparkContext.broadcast(heat(docs.select(F.col(quoted(text)).alias("text")), measure.width))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            for part in chunks(batch, "t"):
                node, size, prefix, bits = [], [], [], []
                for grams in shingle_sets(part.column(2), measure.width):
                    n = len(grams)
                    me = int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)) if n else 0
                    node.append(me)
                    size.append(n)
                    if n and me not in seen:
                        seen.add(me)
                        rank = level[_cell(grams)]
                        take = measure.prefix(n)
                        # the n-grams are sorted: a stable order by rank is the common order (rank, hash)
                        prefix.append((grams[:take] if not rank.any() else grams[np.argsort(rank, kind="stable")[:take]]).view(np.int64))
                        bits.append(bitmap(grams).tobytes())
                    else:
                        prefix.append(None)
                        bits.append(None)
                cols = [part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "row", "node", "n", "prefix", "bits"])

    rows = docs.select(F.col(quoted(key)).alias("doc"), _row_key(docs, key, text).alias("row"), text_column(docs, text).alias("t"))
    got = written(rows.mapInArrow(lean(run), f"doc {kind}, row string, node long, n int, prefix array<long>, bits binary"), "signatures")
    levels.destroy()
    return got


class Joined:
    """Disjoint sets of nodes; a set is named by its least node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        if x not in up:
            return x
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a > b:
            a, b = b, a
        if a != b:
            self.up[b] = a
        return a

    def edges(self) -> pa.RecordBatch | None:
        """Every node with its set's name."""
        if not self.up:
            return None
        nodes = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], names=["a", "b"])


def _could_link(a_n: np.ndarray, b_n: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether the most overlap that the differing bits allow reaches the similarity."""
    both = a_n + b_n
    return (100 + percent) * (both - differ) >= 2 * percent * both


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


class Bitmaps:
    """Bitmaps of rows in ascending size; differing bits of one row and others, on the narrower of two widths."""

    def __init__(self, maps: list[bytes]) -> None:
        self.width = np.array([len(m) // 8 for m in maps])
        self.place = np.zeros(len(maps), np.int64)
        self.by: dict[int, dict[int, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.by[w] = {w: np.frombuffer(b"".join(maps[i] for i in rows), np.uint64).reshape(len(rows), w)}

    def rows(self, w: int, at: int) -> np.ndarray:
        """Rows of width w folded to width `at`."""
        if at not in self.by[w]:
            self.by[w][at] = folded(self.by[w][w], at)
        return self.by[w][at]

    def differ(self, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """own is one row's bitmap."""
        out = np.empty(len(others), np.int64)
        width = self.width[others]
        for w in np.unique(width).tolist():
            at = min(w, len(own))
            mine = folded(own[None, :], at)[0]
            some = width == w
            out[some] = np.bitwise_count(self.rows(w, at)[self.place[others[some]]] ^ mine).sum(axis=1, dtype=np.int64)
        return out


def _join_tile(tile: list[tuple], joined: Joined, percent: int) -> None:
    """Join the nodes of a tile, rows (node, n, bits), that the bitmaps let link; nodes joined already are not compared."""
    m = len(tile)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                (a, an, am), (b, bn, bm) = tile[i], tile[j]
                if 100 * an < percent * bn:
                    break
                if joined.find(a) == joined.find(b):
                    continue
                x, y = int.from_bytes(am, "little"), int.from_bytes(bm, "little")
                wide = len(bm)
                while wide > len(am):
                    wide //= 2
                    y = (y >> 8 * wide) ^ (y & ((1 << 8 * wide) - 1))
                if (100 + percent) * (an + bn - (x ^ y).bit_count()) >= 2 * percent * (an + bn):
                    joined.union(a, b)
        return
    node, n = np.array([r[0] for r in tile]), np.array([r[1] for r in tile])
    name = np.array([joined.find(x) for x in node.tolist()])
    if (name == name[0]).all():
        return
    maps = Bitmaps([r[2] for r in tile])
    for i in range(m - 1):
        end = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        near = i + 1 + np.flatnonzero(name[i + 1 : end] != name[i])
        if len(near):
            own = maps.by[maps.width[i]][maps.width[i]][maps.place[i]]
            for old in np.unique(name[near[_could_link(n[near], n[i], maps.differ(own, near), percent)]]).tolist():
                new = joined.union(old, int(name[i]))
                name[(name == old) | (name == name[i])] = new


def tiles(signed: DataFrame, measure: Measure) -> DataFrame:
    """gram, node, n, rows (classes in the tile), band and part: all classes of tiles of two or more. Written.

    Classes are counted under each n-gram with map-side sums, so that one under very many costs a row a task; the join
    back has plain exchanges on both sides, which may be split. Only a tile of more than TILE rows has bands and parts.
    """
    opened = signed.where("prefix is not null").select(F.explode("prefix").alias("gram"), "node", "n")
    # copies of a class in several tasks count each time here: what is counted is rows
    met = opened.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").cast("int").alias("rows")).where("low != high")
    met = written(met.select("gram", "rows"), "grams")
    found = written(opened.join(met, "gram"), "tiles")
    large = found.where(F.col("rows") > TILE).withColumn("band", measure.band(F.col("n")))
    bands = large.groupBy("gram", "band").agg(F.count("*").alias("in_band"))
    cut = large.join(bands, ["gram", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_band") / TILE)).cast("int"))
    whole = found.where(F.col("rows") <= TILE).withColumns({"band": F.lit(0), "part": F.lit(0)})
    names = ["gram", "node", "n", "rows", "band", "part"]
    if found.where(F.col("rows") > TILE).isEmpty():
        return whole.select(names)
    out = written(whole.select(names).unionByName(cut.select(names)), "tiles")
    remove(signed.sparkSession, found, met)
    return out


def possible(tiles: DataFrame, sizes: DataFrame, measure: Measure) -> DataFrame:
    """Edges (a, b) of a forest that joins, in each task, all classes of a tile, or of its parts, that the bitmaps let link."""
    rows = tiles.select("gram", "band", "part", "node", "n").join(sizes.select("node", "bits"), "node")
    rows = rows.select("gram", "band", "part", "node", "n", "bits").repartition("gram", "band", "part").sortWithinPartitions("gram", "band", "part", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, now, tile = Joined(), None, []
        for batch in batches:
            for gram, band, part, node, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (gram, band, part) != now:
                    _join_tile(tile, joined, measure.percent)
                    now, tile = (gram, band, part), []
                if not tile or tile[-1][0] != node:  # copies of a class from several tasks
                    tile.append((node, n, bits))
        _join_tile(tile, joined, measure.percent)
        if (edges := joined.edges()) is not None:
            yield edges

    return rows.mapInArrow(lean(run), "a long, b long")


def _spread(rows: DataFrame, group: str) -> DataFrame:
    """Rows of large groups whose classes have different labels, set out so that all of different labels meet that may link.

    rows has group, band, part, node, n, label and what else goes along. Residents stay in their parts; classes outside
    the group's commonest label also go, as probes, to every part of their own band and the two beside it.
    """
    names = rows.groupBy(group, "label").agg(F.count("*").alias("c"))
    names = names.groupBy(group).agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main")).where("labels > 1").select(group, "main")
    rows = rows.join(names, group)
    parts = rows.select(group, "band", "part").distinct().withColumnsRenamed({"band": "to_band", "part": "to_part"})
    probes = rows.where("label != main").withColumn("to_band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).drop("part")
    probes = probes.join(parts, [group, "to_band"]).withColumns({"band": F.col("to_band"), "part": F.col("to_part"), "probe": F.lit(True)}).drop("to_band", "to_part")
    return rows.withColumn("probe", F.lit(False)).unionByName(probes).drop("main").repartition(group, "band", "part").sortWithinPartitions(group, "band", "part", "probe", "n", "node")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select("node", F.col("label").alias("known")), "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")


def across(tiles: DataFrame, sizes: DataFrame, labels: DataFrame, measure: Measure) -> DataFrame:
    """Edges between classes of different labels in tiles of more than TILE rows that the bitmaps let link."""
    large = _labelled(tiles.where(F.col("rows") > TILE).drop("rows").distinct(), labels)
    rows = _spread(large, "gram").join(sizes.select("node", "bits"), "node")
    rows = rows.select("gram", "band", "part", "probe", "node", "n", "label", "bits").repartition("gram", "band", "part").sortWithinPartitions("gram", "band", "part", "probe", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, now, held, maps = Joined(), None, [], None
        n = name = None
        for batch in batches:
            for gram, band, part, probe, node, size, label, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (gram, band, part) != now:
                    now, held, maps = (gram, band, part), [], None
                if not probe:
                    held.append((label, size, bits))
                    continue
                if not held:
                    continue
                if maps is None:
                    maps = Bitmaps([h[2] for h in held])
                    n, name = np.array([h[1] for h in held]), np.array([joined.find(h[0]) for h in held])
                me = joined.find(label)
                near = np.flatnonzero(_fits(n, size, measure.percent) & (name != me))
                if len(near):
                    for old in np.unique(name[near[_could_link(n[near], size, maps.differ(np.frombuffer(bits, np.uint64), near), measure.percent)]]).tolist():
                        joined.union(old, label)
                        name[name == old] = joined.find(label)
        if (edges := joined.edges()) is not None:
            yield edges

    return rows.mapInArrow(lean(run), "a long, b long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct elements have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Sets:
    """Sorted arrays of a group of classes with wide bitmaps, whose bound is close, made from them."""

    def __init__(self, node: list[int], label: list[int], sets: list[np.ndarray]) -> None:
        self.node, self.name, self.sets = node, np.array(label), sets
        self.n = np.array([len(x) for x in sets])
        bits = 1 << max(8, int(8 * self.n.max() - 1).bit_length())
        while bits > 256 and bits // 8 * len(sets) > WIDE_BYTES:
            bits //= 2
        self.bits = bits
        self.maps = np.stack([self.bitmap(x) for x in sets])

    def bitmap(self, grams: np.ndarray) -> np.ndarray:
        parity = np.bincount((grams & np.uint64(self.bits - 1)).astype(np.int64), minlength=self.bits) & 1
        return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)

    def links(self, node: int, name: int, grams: np.ndarray, percent: int, joined: Joined, start: int = 0) -> list[tuple[int, int]]:
        """Links of a class to members from a place on, one to each component that it meets; joins the components."""
        out, size = [], len(grams)
        near = start + np.flatnonzero(_fits(self.n[start:], size, percent) & (self.name[start:] != name))
        if not len(near):
            return out
        differ = np.bitwise_count(self.maps[near] ^ self.bitmap(grams)).sum(axis=1, dtype=np.int64)
        ok = _could_link(self.n[near], size, differ, percent)
        near, differ = near[ok], differ[ok]
        for j in near[np.argsort(differ, kind="stable")].tolist():
            if self.name[j] == name:
                continue
            shared = _shared(self.sets[j], grams)
            if 100 * shared >= percent * (size + int(self.n[j]) - shared):
                out.append((self.node[j], node))
                old, new = int(self.name[j]), joined.union(int(self.name[j]), name)
                self.name[(self.name == old) | (self.name == name)] = new
                name = new
        return out


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def settled(held: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b), settled on the sets, that join all classes of a group which links connect within its parts.

    held has grp, band, part, node, n, t (text); a part has about TILE classes, so its sets are held at once.
    """
    rows = held.select("grp", "band", "part", "node", "n", "t").repartition("grp", "band", "part").sortWithinPartitions("grp", "band", "part", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            if len(nodes) < 2:
                return []
            group, joined, out = Sets(nodes, nodes, sets), Joined(), []
            for i in range(len(nodes) - 1):
                out += group.links(nodes[i], int(group.name[i]), sets[i], measure.percent, joined, i + 1)
            return out

        for batch in batches:
            for part in chunks(batch, "t"):
                found = []
                for grp, band, p, node, grams in zip(*(part.column(i).to_pylist() for i in range(4)), shingle_sets(part.column(5), measure.width)):
                    if (grp, band, p) != now:
                        found += close()
                        now, nodes, sets = (grp, band, p), [], []
                    if not nodes or nodes[-1] != node:  # repeated rows of a document
                        nodes.append(node)
                        sets.append(grams)
                if found:
                    yield _pairs(found)
        if found := close():
            yield _pairs(found)

    return rows.mapInArrow(lean(run), "a long, b long")


def settled_across(held: DataFrame, labels: DataFrame, measure: Measure) -> DataFrame:
    """Links between classes of different labels in groups of several parts."""
    rows = _spread(_labelled(held.where(F.col("size") > TILE).drop("size"), labels), "grp")
    rows = rows.select("grp", "band", "part", "probe", "node", "label", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group, joined = None, ([], [], []), None, Joined()
        for batch in batches:
            for part in chunks(batch, "t"):
                found = []
                for grp, band, p, probe, node, label, grams in zip(*(part.column(i).to_pylist() for i in range(6)), shingle_sets(part.column(6), measure.width)):
                    if (grp, band, p) != now:
                        now, held, group = (grp, band, p), ([], [], []), None
                    if not probe:
                        if not held[0] or held[0][-1] != node:
                            for kept, x in zip(held, (node, joined.find(label), grams)):
                                kept.append(x)
                    elif held[0]:
                        group = group or Sets(*held)
                        found += group.links(node, joined.find(label), grams, measure.percent, joined)
                if found:
                    yield _pairs(found)

    return rows.mapInArrow(lean(run), "a long, b long")


def _held(docs: DataFrame, groups: DataFrame, classes: DataFrame, measure: Measure, key: str, text: str) -> DataFrame:
    """The texts of all classes in groups, one row for each row that has the class's key: grp, size, band, part, node, n, t. Written."""
    counts = groups.groupBy("label").agg(F.count("*").alias("size"))
    wanted = written(groups.join(counts, "label").select("node", F.col("label").alias("grp"), "size").join(classes.select("node", "n", "row"), "node"), "wanted")
    large = wanted.where(F.col("size") > TILE).withColumn("band", measure.band(F.col("n")))
    bands = large.groupBy("grp", "band").agg(F.count("*").alias("in_band"))
    cut = large.join(bands, ["grp", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_band") / TILE)).cast("int")).drop("in_band")
    whole = wanted.where(F.col("size") <= TILE).withColumns({"band": F.lit(0), "part": F.lit(0)})
    texts = docs.select(_row_key(docs, key, text).alias("row"), F.col(quoted(text)).cast("string").alias("t"))
    out = written(texts.join(whole.unionByName(cut).hint("shuffle_hash"), "row").select("grp", "size", "band", "part", "node", "n", "t"), "texts")
    remove(docs.sparkSession, wanted)
    return out


def _grown(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components of what has labels, each a star already, and of more edges. These are deleted, the first labels' table is not."""
    out = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    remove(more.sparkSession, more)
    return out


def linked(docs: DataFrame, measure: Measure, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc, row (a key of the row), node, n (set size), group (its class's label) and component.

    A component is the least key among documents that links connect. A text that is null, empty or has no words has
    an empty set and is a component of its own. Repeated rows are one class and share a component; rows with one key
    and different texts are different nodes. Null keys link like others, and a component of null keys only is null.
    An empty table gives an empty one; other columns are left aside.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted(key)), F.col(quoted(text)))
    made = signatures(docs, measure, key, text)
    full = made.where("n > 0")
    classes = full.groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("doc", "row")).alias("least"), F.min("bits").alias("bits"))
    classes = written(classes.select("node", "n", F.col("least.doc").alias("doc"), F.col("least.row").alias("row"), "bits"), "classes")
    opened = tiles(full, measure)

    # groups: classes that the bitmaps let link, directly or through others
    edges = written(possible(opened, classes, measure), "possible")
    groups = components(edges)
    if not opened.where(F.col("rows") > TILE).isEmpty():
        first, groups = groups, _grown(groups, written(across(opened, classes, groups, measure), "possible"))
        remove(spark, first)
    remove(spark, opened, edges)

    # each group's texts move once; links are settled within it
    held = _held(docs, groups, classes, measure, key, text)
    links = written(settled(held, measure), "links")
    labels = components(links)
    if not held.where(F.col("size") > TILE).isEmpty():
        first, labels = labels, _grown(labels, written(settled_across(held, labels, measure), "links"))
        remove(spark, first)

    least = classes.join(labels, "node").groupBy("label").agg(F.min("doc").alias("component"))
    of_node = labels.join(least, "label").select("node", "label", "component")
    component = F.when(F.col("label").isNull(), F.col("doc")).otherwise(F.col("component"))
    # written, so that both sides of the last join are plain exchanges: a class of very many equal texts may be split
    own = written(classes.join(of_node, "node", "left").select("node", F.coalesce("label", "node").alias("group"), component.alias("component")), "named")
    remove(spark, held, groups, links, labels, classes)
    got = made.select("doc", "row", "node", "n").join(own, "node", "left")
    return got.select("doc", "row", "node", "n", "group", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def one_of_each(docs: DataFrame, measure: Measure, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs less all but one of each component: that with the least key. Texts without words all stay.

    Other columns stay as they are, whatever their names. Of repeated rows with that key, one stays.
    """
    got = written(linked(docs, measure, key, text), "linked")
    stay = got.where(F.col("doc").eqNullSafe(F.col("component")))
    # several rows of a component may have its least key: with other texts, or repeated
    chosen = written(stay.where("n > 0").groupBy("group").agg(F.min("row").alias("row"), F.count("*").alias("rows")), "chosen")
    keep = written(chosen.select("row").unionByName(stay.where("n = 0").select("row").distinct()), "kept")
    name = free_prefix(docs) + "row"
    out = docs.withColumn(name, _row_key(docs, key, text)).join(keep.withColumnRenamed("row", name).hint("shuffle_hash"), name, "left_semi")
    if not chosen.where("rows > 1").isEmpty():
        again = chosen.where("rows > 1").select(F.col("row").alias(name))
        out = out.join(again, name, "left_anti").unionByName(out.join(again, name, "left_semi").dropDuplicates([name]))
    return out.drop(name)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the least document that links connect it with."""
    got = linked(documents(spark, sf_dir), Measure(width=4, percent=85))
    return got.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
