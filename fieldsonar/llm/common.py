"""Shared helpers: bounded Arrow chunks, sums over tasks, fits in a task and vectorised word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import made, new_path, remove, shared_dir, swept, written  # noqa: F401  for the operators

#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch, but for a single longer row.
BATCH_BYTES = 4_000_000
#: Bytes of a row that brings a part of a task's result to the driver: a long row would be several long arrays in its heap.
PIECE_BYTES = 1 << 18
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def free_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with, so that columns of our own cannot clash with theirs."""
    names, prefix = [c.lower() for df in frames for c in df.columns], "_own_"
    while any(c.startswith(prefix) for c in names):
        prefix = "_" + prefix
    return prefix


def in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What fit() makes of all rows, in one task: for numerical work on bounded rows, so that the driver holds the result alone.

    The rows must be bounded by a parameter of the caller's. A lost executor costs another try of that task. The result
    comes in rows of PIECE_BYTES at most.
    """
    most = PIECE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        result = fit(pa.Table.from_batches(got)) if got else fit(None)
        whole = pickle.dumps(result, protocol=5)
        for k, at in enumerate(range(0, len(whole), most)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([whole[at : at + most]], pa.binary())], names=["piece", "result"])

    found = rows.coalesce(1).mapInArrow(lean(run), "piece int, result binary").collect()
    if not found:
        return fit(None)
    whole = b"".join(r[1] for r in sorted(found, key=lambda r: r[0]))
    del found
    return pickle.loads(whole)


def text_column(df: DataFrame, name: str = "text"):
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each text's bounds in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most so many bytes together."""
    col = batch.column(batch.schema.get_field_index(column))
    _, bounds = bytes_of(col)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """All words `[^\\x20\\x09-\\x0D]+` of a chunk of texts, found on bytes without a loop over texts."""

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE) -> None:
        self.raw, self.bounds = bytes_of(texts)
        if lower:
            self.raw = _LOWER[self.raw]
        self.n_docs = len(texts)
        raw, bounds = self.raw, self.bounds
        self.is_word = ~separators[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0] = False
            before[1:] = self.is_word[:-1]
        self.starts = np.flatnonzero(self.is_word & (~before | edge[:-1]))
        after = np.empty(len(raw), dtype=bool)
        if len(raw):
            after[-1] = False
            after[:-1] = self.is_word[1:]
        self.ends = np.flatnonzero(self.is_word & (~after | edge[1:])) + 1
        #: words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def array(self) -> pa.Array:
        sizes = self.ends - self.starts
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        data = self.raw[self.is_word].tobytes()
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number and the distinct words."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    out = []
    with np.errstate(over="ignore"):
        for base in (_ROLL, pow(_ROLL, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_ROLL = 0x9E3779B97F4A7C15


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    return span_hashes(w.raw, (w.starts, w.ends))[0]


def span_hashes(raw: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the bytes of spans (starts, ends), from differences of one rolling sum over all bytes."""
    n = 1 << max(20, len(raw).bit_length())
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=total[1:])
        return [mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) for start, end in spans]


def encode(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Small equal numbers for equal values, and how many differ."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) on every element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(raw: np.ndarray) -> np.ndarray:
    """1 at each byte that begins a code point."""
    return (raw & 0xC0) != 0x80


def within(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between successive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def summed(rows: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], size: int, block: int = 1 << 12) -> np.ndarray:
    """Sums of `size` counters, to which count() adds what bounded slices of rows (text column t) have.

    Each task adds up its own; blocks of counters are then added in the executors, in a stream. The driver gets
    size / block rows of bytes, however large the table.
    """
    schema = "block int, counts array<long>"

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in chunks(batch, "t"):
                count(part, total)
        for at in range(0, size, block):
            if (own := total[at : at + block]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own], pa.list_(pa.int64()))], names=["block", "counts"])

    total = np.zeros(size, np.int64)
    for r in _added(rows.mapInArrow(lean(of_task), schema), "block int").collect():
        own = np.frombuffer(r["sums"], np.int64)
        total[r["block"] : r["block"] + len(own)] = own
    return total


def _added(parts: DataFrame, key: str) -> DataFrame:
    """Sums of the equally long arrays `counts` under each key (columns `name type, ...`), added in a stream; `sums` has them as bytes."""
    names = [k.split()[0] for k in key.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string()}[k.split()[1]] for k in key.split(", ")]
    n = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *at, own in zip(*(batch.column(i).to_pylist() for i in range(n)), batch.column(n)):
                values = own.values.to_numpy(zero_copy_only=False)
                if (mine := sums.get(tuple(at))) is None:
                    sums[tuple(at)] = values.astype(np.int64)
                else:
                    mine += values
        for at, own in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([x], kind) for x, kind in zip(at, kinds)), pa.array([own.tobytes()], pa.binary())], names=[*names, "sums"])

    return parts.select(*names, "counts").repartition(*names).mapInArrow(lean(add), f"{key}, sums binary")


def summed_by(rows: DataFrame, count: Callable[[pa.RecordBatch], dict[str, np.ndarray]], size: int, block: int = 1 << 13) -> dict[str, np.ndarray]:
    """As summed(), for several arrays of counters, each under its name. The driver gets the sums themselves, block by block."""
    schema = "name string, block int, counts array<long>"

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "t"):
                for name, own in count(part).items():
                    total[name] = total[name] + own if name in total else own
        for name, sums in total.items():
            for at in range(0, size, block):
                if (own := sums[at : at + block]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([own], pa.list_(pa.int64()))], names=["name", "block", "counts"])

    out: dict[str, np.ndarray] = {}
    for r in _added(rows.mapInArrow(lean(of_task), schema), "name string, block int").collect():
        own = np.frombuffer(r["sums"], np.int64)
        out.setdefault(r["name"], np.zeros(size, np.int64))[r["block"] : r["block"] + len(own)] = own
    return out


def tidy() -> None:
    """Give back memory that is free but held: Python's, Arrow's and the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same pass over batches; when a task ends, its worker, which serves later tasks, keeps no memory of it.

    The session's Arrow batches are bounded to BATCH_BYTES: as many rows as Spark sends by default may be any size.
    """
    conf = SparkSession.active().conf
    if int(conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return over


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
