"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its content (words and their beginnings that tell, and
shares of characters) and its page metadata (source, language, size, and how its lines are laid out). Over a few rounds
each labels the unlabelled documents that it is surest of for the other. How sure is sure enough is read off labelled
documents that are held back from learning: a view teaches a label only above the score from which on it is right often
enough there, and its pseudo-labels weigh as much as that share of right ones says. Each view keeps the round that did
best on the held-back documents and is calibrated there by itself; a combination of both calibrated views, in which
neither can count against its own evidence, scores all documents.

The views are fitted on a bounded sample of labelled documents (LABELLED, those with the smallest hashes of their keys)
and on what they taught each other, in one task at a time; the driver sees the weights alone. In each round every other
document is scored by both views, and the EXCHANGED that are surest of a class, of the whole table, are exchanged; every
document is scored at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PUNCTUATION, Words, bytes_of, chunks, documents, in_task, lean, quoted, remove, span_hashes, text_column, written

LABELLED = 6_000
ROUNDS, EXCHANGED = 3, 300
#: One labelled document in so many is held back.
HELD_BACK = 5
#: A view teaches a label where at least so many held-back rows, and this share of them, have it, and the share is above
#: the label's own by this much of what is left to 1.
TAUGHT_ROWS, TAUGHT_RIGHT, TAUGHT_LIFT = 10, 0.8, 0.3
#: Words that the content view takes, of those that at least so many sampled documents have.
TELLING, LEAST_DOCS = 400, 4
#: First bytes of longer words that count as words of their own.
STEMS = (4, 5)
BUCKETS = 1 << 20
#: Slots of sources and languages, and of each logarithm of a size or of a length of lines.
SOURCES, LANGS, SIZES = 64, 16, 32
#: Sizes that the metadata view takes: characters, and what layout() gives.
SIZE_KINDS = 6
META = SOURCES + LANGS + SIZE_KINDS * SIZES
THRESHOLD = 0.5

#: Classes of bytes whose shares the content view takes; a byte is in the first that has it.
_CLASSES = ("|", "#*$%&<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", ".,", "\t\n\x0b\x0c\r ")
_CLASS = np.array([next((i for i, c in enumerate(_CLASSES) if chr(b) in c), len(_CLASSES)) for b in range(256)], np.uint8)
CONTENT = len(_CLASSES) + 3


def content(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of each text's content, and its distinct words (or those in chosen): (shares, text of each word, bucket of each word).

    A word counts by itself, and a longer one also by its first bytes, which its other forms share.
    """
    raw, bounds = bytes_of(texts)
    n = len(bounds) - 1
    size = np.diff(bounds)
    kinds = len(_CLASSES) + 1
    count = np.bincount(np.repeat(np.arange(n) * kinds, size) + _CLASS[raw], minlength=n * kinds).reshape(n, kinds)
    w = Words(texts, lower=True, separators=PUNCTUATION)
    length = w.ends - w.starts
    stems = [np.flatnonzero(length > k) for k in STEMS]
    hashes = span_hashes(w.raw, (w.starts, w.ends), *((w.starts[some], w.starts[some] + k) for some, k in zip(stems, STEMS)))
    pairs = pc.unique(pa.array(w.doc << 40 | (hashes[0] >> np.uint64(24)).astype(np.int64))).to_numpy()
    different = np.bincount(pairs >> 40, minlength=n)
    words = np.maximum(w.counts, 1)
    letters = np.bincount(w.doc, weights=length, minlength=n)
    shares = np.column_stack([count[:, :-1] / np.maximum(size, 1)[:, None], letters / words / 10, different / words, np.log2(1 + w.counts) / 16])

    keys = []
    wanted = np.full(BUCKETS, chosen is None)
    wanted[chosen if chosen is not None else []] = True
    for doc, own, k in zip((w.doc, *(w.doc[some] for some in stems)), hashes, (0, *STEMS)):
        # other bits of the hash for each kind: a short word is not the beginning of a longer one
        bucket = (own >> np.uint64(4 * k) & np.uint64(BUCKETS - 1)).astype(np.int64)
        hit = wanted[bucket]
        keys.append(doc[hit] * BUCKETS + bucket[hit])
    doc, bucket = np.divmod(np.sort(pc.unique(pa.array(np.concatenate(keys))).to_numpy()), BUCKETS)
    return shares.astype(np.float32), doc, bucket


def layout(texts: pa.Array) -> np.ndarray:
    """Of each text: its number of lines, and their mean, longest, first and last length in bytes."""
    raw, bounds = bytes_of(texts)
    n = len(bounds) - 1
    breaks = np.flatnonzero(raw == 0x0A)
    owner = np.searchsorted(bounds, breaks, side="right") - 1
    count = 1 + np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    # lines in order: each text's first begins with the text, the others after a break
    start = np.empty(first[-1], np.int64)
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    start[opens], start[~opens] = bounds[:-1], breaks + 1
    end = np.empty_like(start)
    closes = np.zeros(first[-1], bool)
    closes[first[1:] - 1] = True
    end[closes], end[~closes] = bounds[1:], breaks
    size = end - start
    longest = np.maximum.reduceat(size, first[:-1]) if n else np.zeros(0, np.int64)
    return np.stack([count, np.diff(bounds) // np.maximum(count, 1), longest, size[first[:-1]], size[first[1:] - 1]], axis=1)


def metadata(source: list, lang: list, n_chars: list, lines: np.ndarray) -> np.ndarray:
    """Slots of a document's metadata in the other view: source, language, and half-steps of the logarithms of its sizes."""
    code = lambda x, n: zlib.crc32(repr(x).encode()) % n
    sizes = np.column_stack([np.array([0 if x is None or x < 1 else x for x in n_chars], np.float64), lines]) if len(lines) else np.zeros((0, SIZE_KINDS))
    step = np.minimum(SIZES - 1, (2 * np.log2(1 + sizes)).astype(np.int64))
    named = np.array([[code(s, SOURCES), SOURCES + code(g, LANGS)] for s, g in zip(source, lang)], np.int64).reshape(-1, 2)
    return np.hstack([named, SOURCES + LANGS + SIZES * np.arange(SIZE_KINDS) + step])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.ones(len(y)) if weight is None else weight
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(keep)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-5:
            break
    return w


def not_negative(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """As logistic(), the best weights of which none is below 0: those that would be are left out, the worst first."""
    use = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, use], y, ridge=ridge)
        if not use or (w[:-1] >= 0).all():
            break
        use.pop(int(np.argmin(w[:-1])))
    out = np.zeros(x.shape[1] + 1)
    out[use], out[-1] = w[:-1], w[-1]
    return out


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


@dataclass
class Model:
    #: The content view's words: buckets, sorted.
    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    #: Weights of the views, the intercept last.
    text: np.ndarray
    meta: np.ndarray
    #: Slope and intercept of each view's calibration, and its loss on held-back rows after it.
    platt: np.ndarray
    loss: tuple[float, float]
    #: For each view and label: the least score that teaches (infinite where none does) and the weight of what it teaches.
    least: np.ndarray
    weight: np.ndarray
    #: Weights of both calibrated views, none below 0, and the intercept.
    both: np.ndarray

    def content_logit(self, shares: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        z = ((shares - self.mean) / self.scale) @ self.text[:CONTENT] + self.text[-1]
        at = np.searchsorted(self.words, bucket)
        at[at == len(self.words)] = 0
        hit = self.words[at] == bucket if len(self.words) else np.zeros(len(bucket), bool)
        return z + np.bincount(doc[hit], weights=self.text[CONTENT:-1][at[hit]], minlength=len(shares))

    def meta_logit(self, slots: np.ndarray) -> np.ndarray:
        return self.meta[slots].sum(axis=1) + self.meta[-1]

    def calibrated(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both views' log-odds after calibration."""
        return tuple(np.clip(a * z + b, -12, 12) for z, (a, b) in zip((t, m), self.platt))

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The probability that calibrated log-odds give together."""
        return _p(self.both[0] * t + self.both[1] * m + self.both[2])


@dataclass
class Rows:
    """Documents to fit on: label, weight, whether held back, and both views; w and doc are all words and whose they are."""

    y: np.ndarray
    weight: np.ndarray
    held: np.ndarray
    shares: np.ndarray
    doc: np.ndarray
    w: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        """Of columns y, weight, held, shares, words, slots, in the order of column o."""
        table = table.sort_by("o").combine_chunks()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        words = table.column("words").combine_chunks()
        size = np.diff(words.offsets.to_numpy()) if table.num_rows else np.zeros(0, np.int64)
        return cls(
            table.column("y").to_numpy().astype(float), table.column("weight").to_numpy(), table.column("held").to_numpy(),
            flat("shares").reshape(-1, CONTENT), np.repeat(np.arange(table.num_rows), size), flat("words").astype(np.int64), flat("slots").reshape(-1, 2 + SIZE_KINDS),
        )

    def views(self, words: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(self.y), CONTENT + len(words)), np.float32)
        x[:, :CONTENT] = (self.shares - mean) / scale
        if len(words):
            at = np.searchsorted(words, self.w)
            at[at == len(words)] = 0
            hit = words[at] == self.w
            x[self.doc[hit], CONTENT + at[hit]] = 1
        meta = np.zeros((len(self.y), META), np.float32)
        meta[np.arange(len(self.y))[:, None], self.slots] = 1
        return x, meta


def _telling(rows: Rows, learn: np.ndarray) -> np.ndarray:
    """Buckets of the words whose share of documents differs most between the classes."""
    count = np.stack([np.bincount(rows.w[(learn & (rows.y == c))[rows.doc]], minlength=BUCKETS) for c in (0, 1)])
    n = np.array([(learn & (rows.y == c)).sum() for c in (0, 1)])[:, None]
    rate = (count + 0.5) / (n + 1)
    z = np.abs(np.log(rate[1] / rate[0])) / np.sqrt(1 / (count[0] + 0.5) + 1 / (count[1] + 0.5))
    z[count.sum(axis=0) < LEAST_DOCS] = 0
    top = np.argsort(-z, kind="stable")[:TELLING]
    return np.sort(top[z[top] > 2.5])


def teaching(z: np.ndarray, y: np.ndarray, label: int, line: np.ndarray) -> tuple[float, float]:
    """From which score for a label on a view teaches it, and the weight of what it teaches: (inf, 0) where it does not.

    z is the view's log-odds on held-back rows, turned to the label, and line their calibration. The margin is the least
    score at which the calibrated probability is TAUGHT_RIGHT and from which on so large a share of the rows has the
    label, and a share that is TAUGHT_LIFT of the way from the label's own share to 1.
    """
    if line[0] <= 0:
        return float("inf"), 0.0
    sure = (np.log(TAUGHT_RIGHT / (1 - TAUGHT_RIGHT)) + (-line[1] if label else line[1])) / line[0]
    order = np.argsort(-z, kind="stable")
    right = (y[order] == label).astype(float)
    share = np.cumsum(right) / np.arange(1, len(y) + 1)
    base = float((y == label).mean()) if len(y) else 1.0
    ends = np.append(np.diff(z[order]) != 0, True) if len(y) else np.zeros(0, bool)
    good = ends & (z[order] >= sure) & (np.arange(1, len(y) + 1) >= TAUGHT_ROWS) & (share >= max(TAUGHT_RIGHT, base + TAUGHT_LIFT * (1 - base)))
    if not good.any():
        return float("inf"), 0.0
    at = int(np.flatnonzero(good)[-1])
    return float(z[order[at]]), max(0.0, 2 * float(share[at]) - 1) / 2


def fitted(known: Rows, taught: tuple[Rows, Rows], last: Model | None) -> Model | None:
    """Both views after a round; taught are the rows that each was taught. None where there are fewer than two classes.

    The words, their scale and each view's best round so far come from the model of the round before.
    """
    if len(np.unique(known.y)) < 2:
        return None
    held = known.held.copy()
    if len(np.unique(known.y[~held])) < 2 or len(np.unique(known.y[held])) < 2:
        held[:] = False  # too few to hold any back
    learn, judge = ~held, held if held.any() else ~held
    if last is None:
        words, mean, scale = _telling(known, learn), known.shares[learn].mean(axis=0), known.shares[learn].std(axis=0) + 1e-3
    else:
        words, mean, scale = last.words, last.mean, last.scale
    own, y = known.views(words, mean, scale), known.y
    weights, platt, loss, least, weight, odds = [], [], [], np.full((2, 2), np.inf), np.zeros((2, 2)), []
    for v in (0, 1):
        more = taught[v].views(words, mean, scale)[v]
        w = logistic(np.concatenate([own[v][learn], more]), np.concatenate([y[learn], taught[v].y]), np.concatenate([np.ones(learn.sum()), taught[v].weight]), ridge=1.0 if v else 0.3)
        z = np.clip(own[v][judge] @ w[:-1] + w[-1], -12, 12)
        line = not_negative(z[:, None], y[judge])
        for label in (0, 1):
            least[v, label], weight[v, label] = teaching(z if label else -z, y[judge], label, line)
        mine = (w, line, _loss(line[0] * z + line[1], y[judge]))
        if last is not None and last.loss[v] <= mine[2]:  # what this round taught did not help: the best so far stays
            mine = ((last.text, last.meta)[v], last.platt[v], last.loss[v])
            z = np.clip(own[v][judge] @ mine[0][:-1] + mine[0][-1], -12, 12)
        weights.append(mine[0])
        platt.append(mine[1])
        loss.append(mine[2])
        odds.append(np.clip(mine[1][0] * z + mine[1][1], -12, 12))
    odds = np.stack(odds, axis=1)
    # both together, or one view alone where that errs less on the held-back rows
    options = [not_negative(odds, y[judge]), np.array([1.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0])]
    z = [odds @ w[:2] + w[2] for w in options]
    both = options[min(range(3), key=lambda i: (int(((z[i] >= 0) != y[judge]).sum()), _loss(z[i], y[judge])))]
    return Model(words, mean, scale, weights[0], weights[1], np.stack(platt), (loss[0], loss[1]), least, weight, both)


def known(labels: DataFrame) -> DataFrame:
    """Labels to fit on, y and whether held back: of the LABELLED keys with the smallest hashes."""
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    label = label.select("doc_id", ((F.col("q") == 1) & (F.col("x") == 0)).cast("int").alias("y"), F.xxhash64("doc_id", F.lit(1)).alias("order"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_BACK)) == 0
    return label.orderBy("order", "doc_id").limit(LABELLED).select("doc_id", "y", held.alias("held"))


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def _views(part: pa.RecordBatch, text: int, meta: tuple[int, int, int], chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares, text of each word, words (all, or those in chosen) and slots of a batch's rows."""
    texts = part.column(text)
    return *content(texts, chosen), metadata(*(part.column(i).to_pylist() for i in meta), layout(texts))


def features(rows: DataFrame, chosen: np.ndarray | None = None) -> DataFrame:
    """Both views of rows, with o (their key and text), k (text and metadata), y and held: shares, words (all, or the chosen buckets) and slots. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                shares, doc, bucket, slots = _views(part, 2, (3, 4, 5), chosen)
                n = np.arange(part.num_rows + 1)
                lists = [_lists(shares.ravel(), n * CONTENT), _lists(bucket.astype(np.int32), np.searchsorted(doc, n)), _lists(slots.astype(np.int32).ravel(), n * slots.shape[1])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists, part.column(6), part.column(7)], names=["o", "k", "shares", "words", "slots", "y", "held"])

    meta = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]
    k = F.xxhash64("text", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("source", "lang", "n_chars")])
    rows = rows.select(F.xxhash64("doc_id", "text").alias("o"), k.alias("k"), text_column(rows).alias("t"), *meta, "y", "held")
    return rows.mapInArrow(lean(run), "o long, k long, shares array<float>, words array<int>, slots array<int>, y int, held boolean")


def surest(pool: DataFrame, model: Model, done: list[set[int]]) -> DataFrame:
    """Of all rows of pool (features), the EXCHANGED of each teacher (view) and label that it is surest of, above its
    margin, and that the other view (done, by learner) has not been taught yet.

    Equal rows count once. Each task keeps its own EXCHANGED, so that few rows meet.
    """
    taught = [np.array(sorted(t), np.int64) for t in done]  # bounded by the rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[pa.Table, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lists = batch.column(0).to_numpy(), [batch.column(i) for i in (1, 2, 3)]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists[1].offsets.to_numpy()))
            shares, bucket, slots = (x.flatten().to_numpy() for x in lists)
            odds = (model.content_logit(shares.reshape(-1, CONTENT), doc, bucket), model.meta_logit(slots.reshape(-1, 2 + SIZE_KINDS)))
            for v in (0, 1):
                fresh = ~np.isin(key, taught[1 - v])
                for label in (0, 1):
                    sure = np.round(odds[v] if label else -odds[v], 9)
                    at = np.flatnonzero(fresh & (sure >= model.least[v, label]))
                    if not len(at):
                        continue
                    table, sure = pa.Table.from_batches([batch.take(pa.array(at))]), sure[at]
                    if (v, label) in best:
                        table, sure = pa.concat_tables([best[v, label][0], table]), np.concatenate([best[v, label][1], sure])
                    keys = table.column(0).to_numpy()
                    one = np.unique(keys, return_index=True)[1]
                    one = one[np.lexsort((keys[one], -sure[one]))][:EXCHANGED]
                    best[v, label] = table.take(pa.array(one)).combine_chunks(), sure[one]
        for (v, label), (table, sure) in best.items():
            for part in table.to_batches():
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(sure), *part.columns], names=["teacher", "label", "sure", *part.schema.names])

    got = pool.select("k", "shares", "words", "slots").mapInArrow(lean(run), "teacher int, label int, sure double, k long, shares array<float>, words array<int>, slots array<int>")
    place = F.dense_rank().over(Window.partitionBy("teacher", "label").orderBy(F.desc("sure"), "k"))
    return got.withColumn("place", place).where(F.col("place") <= EXCHANGED).dropDuplicates(["teacher", "label", "k"])


#: Columns of the rows that a fit reads; learner is -1 for labelled rows.
_FIT = ["learner", "o", "y", "weight", "held", "shares", "words", "slots"]


def _fit(rows: DataFrame, last: Model | None) -> Model | None:
    def fit(table: pa.Table | None) -> Model | None:
        if table is None:
            return None
        learner = table.column("learner").to_numpy()
        known, *taught = (Rows.of(table.filter(pa.array(learner == v))) for v in (-1, 0, 1))
        return fitted(known, tuple(taught), last)

    return in_task(rows.select(_FIT), fit)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of labelled documents and of what the views teach each other over ROUNDS rounds.

    Labels of a null key or without a quality do not count; several labels of a key are its worst. Null text and null
    metadata are values of their own; repeated rows count once. None where the documents' labels are not of both kinds,
    and for empty tables. The model does not depend on the order of rows or on how they are dealt out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars")
    few = written(known(labels), "labels")
    # bounded by LABELLED, so it may be broadcast
    rows = features(docs.join(F.broadcast(few), "doc_id")).dropDuplicates(["o"])
    rows = written(rows.select(F.lit(-1).alias("learner"), "o", "y", F.lit(1.0).alias("weight"), "held", "shares", "words", "slots"), "labelled")
    model, made, done = _fit(rows, None), [few, rows], [set(), set()]
    if model is not None:
        rest = docs.join(F.broadcast(few), "doc_id", "left_anti").withColumns({"y": F.lit(None).cast("int"), "held": F.lit(False)})
        # words are looked up once; all other documents' views are then small
        pool = written(features(rest, model.words).select("k", "shares", "words", "slots"), "views")
        made.append(pool)
        for _ in range(ROUNDS):
            got = written(surest(pool, model, done), "taught")
            made.append(got)
            new = got.select("teacher", "k").collect()  # at most 4 * EXCHANGED numbers
            if not new:
                break
            for r in new:
                done[1 - r["teacher"]].add(r["k"])
            weight = F.element_at(F.array(*[F.lit(float(x)) for x in model.weight.ravel()]), 2 * F.col("teacher") + F.col("label") + 1)
            more = got.select((1 - F.col("teacher")).alias("learner"), F.col("k").alias("o"), F.col("label").alias("y"), weight.alias("weight"), F.lit(False).alias("held"), "shares", "words", "slots")
            rows = rows.unionByName(more)
            model = _fit(rows, model)
    remove(spark, *made)
    return model


def classify(docs: DataFrame, model: Model | None, extra: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per row of docs: the columns in extra (doc_id by default), p_content, p_metadata, prob and kept.

    A null or wordless text has prob 0 and is not kept. Null metadata is a value of its own. Repeated rows are scored
    alike. Without a model (no labels of both kinds) every text with words has prob 1. An empty table gives an empty
    one. Columns not in extra are left aside; `prefix` goes before the names of the new columns, where extra has such
    names itself. Narrow: no shuffle.
    """
    extra = extra or ["doc_id"]
    n = len(extra)
    new = [prefix + c for c in ("p_content", "p_metadata", "prob", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__t"):
                shares, doc, bucket, slots = _views(part, n, (n + 1, n + 2, n + 3), model.words if model is not None else None)
                if model is None:
                    t = m = np.full(part.num_rows, 30.0)
                    p = np.ones(part.num_rows)
                else:
                    t, m = model.calibrated(np.clip(model.content_logit(shares, doc, bucket), -12, 12), np.clip(model.meta_logit(slots), -12, 12))
                    p = model.score(t, m)
                p = np.where(shares[:, -1] > 0, p, 0.0)
                cols = [pa.array(x.astype(np.float64)) for x in (_p(t), _p(m), p)] + [pa.array(p >= THRESHOLD)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *cols], names=[*(f"__c{i}" for i in range(n)), "__v0", "__v1", "__v2", "__v3"])

    schema = ", ".join(f"__c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    rows = docs.select(*[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(extra)], text_column(docs).alias("__t"), F.col("source").cast("string").alias("__s"), F.col("lang").cast("string").alias("__l"), F.col("n_chars").cast("long").alias("__n"))
    got = rows.mapInArrow(lean(run), schema + ", __v0 double, __v1 double, __v2 double, __v3 boolean")
    return got.toDF(*extra, *new)


def op6_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good and clean, by both views and together, and whether it is kept."""
    docs = documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
