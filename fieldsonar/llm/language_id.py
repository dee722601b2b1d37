"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is distributed: each task adds up its own counts of a language's buckets before anything is shuffled, in blocks,
and the model has a fixed number of buckets for each language. The log-probability matrix (buckets x languages floats)
is the only thing that is broadcast; its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, lean, quoted, summed_by

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: More languages than this are refused: the matrix must stay small enough to broadcast.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
UNKNOWN = "und"

_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter, 32 (a space) for all others."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, how many each text has, and which texts have a letter.

    Everything but letters becomes one space; n-grams with two spaces running are left out, and those of a text
    never reach into the next.
    """
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    c = _letters()[points]
    space = c == 32
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    c, doc, space = c[keep], doc[keep], space[keep]
    buckets, owners = [], []
    rolled = np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for k in ORDERS:
            if len(c) < k:
                continue
            rolled = (rolled[: len(c) - k + 1] ^ c[k - 1 :]) * _MUL[k - 1]
            rolled ^= rolled >> np.uint32(15)
            inside = doc[k - 1 :] == doc[: len(c) - k + 1]
            if k == 1:
                inside &= ~space
            buckets.append(((rolled * _MUL[2]) >> np.uint32(16))[inside])
            owners.append(doc[: len(c) - k + 1][inside])
    has = np.bincount(doc[~space], minlength=len(texts)) > 0
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    return bucket.astype(np.int64), owner, has


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log-probabilities (buckets x languages, the last row the priors).

    Counts cover every labelled row with text and language, repeated ones too; a null in either is no labelled row. The
    sums of at most MAX_LANGUAGES languages reach the driver, in blocks of bytes. Without rows there is no language.
    """

    def count(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        langs = part.column(1).to_pylist()
        bucket, owner, _ = features(part.column(0).to_pylist())
        names = sorted(set(langs))
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        number = {x: i for i, x in enumerate(names)}
        which = np.array([number[x] for x in langs])
        got = np.bincount(which[owner] * (BUCKETS + 1) + bucket, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), BUCKETS + 1)
        got[:, BUCKETS] = np.bincount(which, minlength=len(names))
        return dict(zip(names, got))

    rows = labelled.where(F.col(quoted(text)).isNotNull() & F.col(quoted(lang)).isNotNull()).select(F.col(quoted(text)).cast("string").alias("t"), F.col(quoted(lang)).cast("string").alias("l"))
    if len(found := rows.select("l").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r[0] for r in found)
    sums = summed_by(rows, count, BUCKETS + 1)
    table = np.zeros((BUCKETS + 1, len(langs)))
    for i, x in enumerate(langs):
        if x in sums:
            table[:, i] = sums.pop(x)
    if not langs:
        return [], table.astype(np.float32)
    grams, docs = table[:BUCKETS] + SMOOTHING, table[BUCKETS:] + 1
    return langs, np.log(np.vstack([grams / grams.sum(axis=0), docs / docs.sum()])).astype(np.float32)


def score(texts: list[str], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    bucket, owner, has = features(texts)
    total = np.empty((len(texts), len(langs)))
    for j in range(len(langs)):
        total[:, j] = np.bincount(owner, weights=table[:, j][bucket], minlength=len(texts)) + table[BUCKETS, j]
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, p, 0.0)


def language_id(docs: DataFrame, langs: list[str], table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, lang_pred and score.

    A null or empty text, or one without a letter, gets `und` and 0; so does every text where nothing was learned.
    Ties go to the language first in the alphabet. Repeated rows each give a row; other columns are left aside.
    """
    spark = docs.sparkSession
    if table.nbytes > (MAX_LANGUAGES * (BUCKETS + 1) * 4):
        raise ValueError("the model is too large to broadcast")
    shared = spark.sparkContext.broadcast((langs, table))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for part in chunks(batch, "t"):
                pred, p = score([x or "" for x in part.column(1).to_pylist()], names, matrix)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(p, pa.float64())], names=["k", "lang_pred", "score"])

    got = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t")).mapInArrow(lean(run), f"k {kind}, lang_pred string, score double")
    return got.withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    """Every fifth document, by a checksum of its id, is never learned from. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    langs, table = train(docs.where(~held_out()))
    return language_id(docs, langs, table).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
