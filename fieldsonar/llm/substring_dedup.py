"""Substring dedup by sliding sentence spans.

A run is several consecutive sentences: from each sentence on, and up to each sentence, the fewest that have
MIN_WORDS words (one sentence of LONG_SENTENCE words, which is as many, is a run by itself). All runs are hashed, to
128 bits of a cryptographic digest, and counted over all documents; sentences inside a run that was
there before, in a document with a lesser key or earlier in the same document, are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, code_points, documents, free_prefix, lean, quoted, text_column, written

MIN_WORDS = LONG_SENTENCE = 20
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _run_hashes(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A digest of 128 bits, as two numbers, of the words from a to b: of their own digests in order.

    A cryptographic hash, as texts are cut where digests agree: with polynomials modulo 2^64 patterned pages that differ
    had equal values under every base.
    """
    data = memoryview(np.ascontiguousarray(codes)).cast("B") if len(codes) else b""
    return np.frombuffer(b"".join(_digest(data[16 * x : 16 * y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64).reshape(-1, 2)


def sentence_runs(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each text: both hashes, start and end (code points) of its runs, whether the run was earlier in the text, and its sentences."""
    w = Words(texts, lower=True)
    n = len(w.starts)
    ids, words = w.ids()
    codes = np.frombuffer(b"".join(map(_digest, words.to_pylist())), np.uint64).reshape(-1, 2)[ids]
    # a sentence begins with a text, after a word that ends in a stop, and after a line break
    breaks = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(w.raw == 0x0A, out=breaks[1:])
    begins = np.ones(n, dtype=bool)
    if n > 1:
        begins[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[w.raw[w.ends[:-1] - 1]] | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
    at = np.append(np.flatnonzero(begins), n)  # first word of each sentence
    m = len(at) - 1
    owner = w.doc[at[:-1]] if m else np.zeros(0, np.int64)
    first = np.searchsorted(owner, np.arange(w.n_docs + 1))  # sentences of each text
    size = np.diff(at)

    own = np.arange(m)
    long = size >= LONG_SENTENCE
    end = np.maximum(np.searchsorted(at, at[:-1] + MIN_WORDS), own + np.where(long, 1, 2))
    fits = end <= first[owner + 1]
    begin = np.minimum(np.searchsorted(at, at[1:] - MIN_WORDS, side="right") - 1, own + 1 - np.where(long, 1, 2))
    back = begin >= first[owner]
    s = np.concatenate([own[fits], begin[back]])
    e = np.concatenate([end[fits], own[back] + 1])
    s, e = np.divmod(np.unique(s * (m + 1) + e), m + 1)

    a, b = at[s], at[e]
    digests = _run_hashes(codes, a, b)
    value, other = map(np.ascontiguousarray, digests.T)
    points = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(code_points(w.raw), out=points[1:])
    base = points[w.bounds[:-1]]
    doc = owner[s]
    same = pa.Array.from_buffers(pa.binary(16), len(s), [None, pa.py_buffer(digests)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    again = np.ones(len(s), dtype=bool)
    again[np.unique(doc * (len(s) + 1) + same, return_index=True)[1]] = False
    start, stop = points[w.starts[a]] - base[doc], points[w.ends[b - 1]] - base[doc]
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    out = []
    for i in range(w.n_docs):
        x, y = cut[i], cut[i + 1]
        out.append((value[x:y].view(np.int64), other[x:y].view(np.int64), start[x:y], stop[x:y], again[x:y], int(first[i + 1] - first[i])))
    return out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs that loses something: doc, text_hash, n_sentences, spans (start, end) and first_docs.

    Spans are in code points, sorted, merged where they overlap; first_docs are the documents that keep them. Rows with
    one key count as one document. Null and empty texts have no runs; a null key comes after all others; an empty
    table gives an empty one; other columns are left aside.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc {kind}, text_hash long, n_sentences int, runs array<struct<run:long,other:long,start:int,end:int,again:boolean>>"
    fields = pa.struct([("run", pa.int64()), ("other", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                got = sentence_runs(part.column(2))
                bounds = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(x[0]) for x in got], out=bounds[1:])
                cols = [np.concatenate([x[k] for x in got]) for k in range(5)]
                structs = pa.StructArray.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32, bool))], fields=list(fields))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[5] for x in got], pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), structs)], names=["doc", "text_hash", "n_sentences", "runs"])

    rows = docs.select(F.col(quoted(key)).alias("doc"), F.xxhash64(F.col(quoted(text))).alias("text_hash"), text_column(docs, text).alias("t"))
    table = written(rows.mapInArrow(lean(run), schema), "runs")
    flat = table.select("doc", "text_hash", "n_sentences", F.explode("runs").alias("r")).select("doc", "text_hash", "n_sentences", "r.*")
    # map-side sums first, so a run that a third of all documents have costs one row a task
    seen = flat.groupBy("run", "other").agg(F.count("*").alias("times"), F.min("doc").alias("first_doc")).where("times > 1").select("run", "other", "first_doc")
    # written, so that both sides of the join are plain exchanges and the planner can split a run that very many have
    seen = written(seen, "repeated-runs")
    again = flat.join(seen, ["run", "other"]).where(~F.col("doc").eqNullSafe(F.col("first_doc")) | F.col("again"))
    spans = again.groupBy("doc", "text_hash").agg(F.min("n_sentences").alias("n_sentences"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3)
            cut = found.offsets.to_numpy()
            flat = found.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            start, end = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
            # rows lie apart on one line, so a row's spans never reach the next
            far = np.maximum.accumulate((row << 32) + end)
            opens = np.ones(len(row), bool)
            opens[1:] = (row[1:] << 32) + start[1:] > far[:-1]
            at = np.flatnonzero(opens)
            last = np.append(at[1:], len(row))[: len(at)] - 1
            spans = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array((far[last] - (row[last] << 32)).astype(np.int32))], names=["start", "end"])
            bounds = np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(bounds), spans), batch.column(4)], names=["doc", "text_hash", "n_sentences", "spans", "first_docs"])

    return spans.select("doc", "text_hash", "n_sentences", "found", "first_docs").mapInArrow(lean(merge), f"doc {kind}, text_hash long, n_sentences int, spans array<struct<start:int,end:int>>, first_docs array<{kind}>")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the repeated spans cut out of the text; all other columns and rows stay as they are, whatever the columns' names."""
    own = free_prefix(docs)
    spans = repeated_spans(docs, key, text).select(F.col("doc").alias(own + "doc"), F.col("text_hash").alias(own + "hash"), F.col("spans").alias(own + "spans"))
    t = F.col(quoted(text))
    got = docs.join(spans, F.col(quoted(key)).eqNullSafe(F.col(own + "doc")) & (F.xxhash64(t) == F.col(own + "hash")), "left")
    n, at = len(docs.columns), docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x, gone in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                if gone:
                    edges = [0, *(e for s in gone for e in (s["start"], s["end"])), len(x)]
                    x = "".join(x[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(x)
            cols = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(n)])

    names = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(docs.columns))
    return got.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(own + "spans").alias("spans")).mapInArrow(lean(cut), names).toDF(*docs.columns)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses sentences: how many spans and characters, which, and the documents that keep them."""
    got = repeated_spans(documents(spark, sf_dir))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return got.select(F.col("doc").alias("doc_id"), "n_sentences", F.size("spans").cast("long").alias("n_removed_spans"), chars.alias("removed_chars"), text.alias("removed_spans"), F.col("first_docs").alias("first_doc_ids"))
