"""A deterministic, sharded writer and a streaming reader of WARC archives.

Records are sorted by their key and payload digest and cut into shards of about SHARD_BYTES of payload, at places that
depend on the data alone: running sums of payload bytes in key order. A shard is one task, which writes its records
as gzip members in order and begins a new file once one has FILE_BYTES. Headers, lengths, digests and record ids are made
anew from the rows, so equal tables give equal files, byte for byte, whatever the cluster.

Committing. A task writes under `_temporary/<attempt>/` and hands over a row a file (where it is, what it shall be
called, size, records, SHA-256). Spark's own commit of that table of rows decides which attempt of a task counts. Files are
then renamed in tasks, which may run twice, and the manifest is written last: a folder without `manifest/_SUCCESS` is
no archive. What lost attempts left behind goes with `_temporary`.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import owned
from .common import lean, new_path, quoted, remove, written

#: Payload bytes of a shard, and the most shards: beyond, shards grow with the table.
SHARD_BYTES, MOST_SHARDS = 8_000_000, 50_000
#: Compressed bytes after which a file is closed.
FILE_BYTES = 1_000_000_000
#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 100
#: The date of all records, as the rows have none.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 20


@dataclass(frozen=True)
class Record:
    """One record as a reader sees it."""

    kind: str
    record_id: str
    refers_to: str | None
    url: str
    digest: str
    payload_bytes: int
    payload: bytes | None


def record_id(key: str | None, digest: str, ordinal: int) -> str:
    """An id of a row's key, payload and number among equal ones; a null key is told from every text."""
    return f"<urn:x-page:{'' if key is None else 'k' + quote(key, safe='')}:{digest}:{ordinal}>"


def key_of(rid: str) -> str | None:
    key = rid.strip("<>").split(":")[2]
    return unquote(key[1:]) if key else None


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _member(headers: list[tuple[str, str]], block: list[bytes]) -> bytes:
    """A record as a gzip member without a time stamp."""
    size = sum(map(len, block))
    head = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), f"Content-Length: {size}\r\n\r\n"])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([squeeze.compress(head.encode()), *map(squeeze.compress, block), squeeze.compress(b"\r\n\r\n"), squeeze.flush()])


def info_member(name: str) -> bytes:
    """The record that opens a file."""
    block = b"software: fieldsonar\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha256:{_sha256(block)}")], [block])


def page_member(key: str | None, url: str | None, payload: bytes, digest: str, ordinal: int, refers_to: str | None) -> bytes:
    """A response, or a revisit of the record refers_to, whose payload is left out; both tell the whole payload's size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = [http] if refers_to else [http, payload]
    whole = hashlib.sha256(http)
    if not refers_to:
        whole.update(payload)
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(key, digest, ordinal)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=-._~")), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{whole.hexdigest()}"),
    ]
    if refers_to:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers_to)]
    return _member(headers, block)


def _members(source) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    left, data = b"", source.read(_PIECE)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(data))
            data = b"" if inflate.eof else source.read(_PIECE)
        left = inflate.unused_data
        yield b"".join(parts)
        data = left or source.read(_PIECE)


def read_records(source) -> Iterator[Record]:
    """Responses and revisits of an open archive; a record whose length or digests do not hold raises ValueError."""
    for member in _members(source):
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1" or rest[-4:] != b"\r\n\r\n":
            raise ValueError("not a record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = memoryview(rest)[:-4]
        if len(block) != int(headers["Content-Length"]) or headers["WARC-Block-Digest"] != f"sha256:{_sha256(block)}":
            raise ValueError(f"length or block digest of {headers['WARC-Record-ID']}")
        if headers["WARC-Type"] not in ("response", "revisit"):
            continue
        http, _, _ = rest.partition(b"\r\n\r\n")
        size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
        digest, payload = headers["WARC-Payload-Digest"].removeprefix("sha256:"), None
        if headers["WARC-Type"] == "response":
            payload = block[len(http) + 4 :]
            if len(payload) != size or _sha256(payload) != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']}")
        yield Record(headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), headers["WARC-Target-URI"], digest, size, payload)


class _Shard:
    """Writes the files of one shard, in order, under a folder of this attempt."""

    def __init__(self, folder: str, shard: int, file_bytes: int) -> None:
        self.shard, self.most, self.n, self.stream, self.files = shard, file_bytes, 0, None, []
        self.attempt = f"_temporary/{uuid.uuid4().hex}"
        self.fs, self.top = pafs.FileSystem.from_uri(folder)

    def add(self, member_of, *args) -> None:
        if self.stream is None:
            self.name = f"shard-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.fs.create_dir(f"{self.top}/{self.attempt}", recursive=True)
            self.stream = self.fs.open_output_stream(f"{self.top}/{self.attempt}/{self.name}", compression=None)
            self.size, self.records, self.sha, self.n = 0, 0, hashlib.sha256(), self.n + 1
            self._put(info_member(self.name))
        self._put(member_of(*args))
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)
        self.sha.update(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.files.append((self.shard, self.name, f"{self.attempt}/{self.name}", self.size, self.records, self.sha.hexdigest()))
            self.stream = None


MANIFEST = "shard int, file string, written_as string, bytes long, records long, sha256 string"


def _bounds(rows: DataFrame, shard_bytes: int, most_shards: int) -> list:
    """The first key of each shard but the first, from running sums of payload bytes in key order. A row a shard reaches the driver.

    rows: key and n (bytes). All rows of one key are in one shard.
    """
    spark = rows.sparkSession
    sized = rows.groupBy("key").agg(F.sum("n").alias("n")).repartitionByRange("key").sortWithinPartitions("key")
    sized = written(sized.withColumn("part", F.spark_partition_id()), "warc-sizes")
    parts = sized.groupBy("part").agg(F.sum("n").alias("n"), F.min(F.struct("key")).alias("least")).collect()  # a row a partition
    if not parts:
        return []
    parts.sort(key=lambda r: (r["least"]["key"] is not None, r["least"]["key"]))
    before = np.cumsum([0, *(r["n"] for r in parts)]).tolist()
    size = max(shard_bytes, before[-1] // most_shards)
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(parts, before)], "part int, before long")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("key")) - F.col("n") + F.col("before")
    shards = sized.join(F.broadcast(starts), "part").withColumn("shard", F.floor(running / F.lit(size))).groupBy("shard").agg(F.min("key").alias("key"))
    found = sorted((r["shard"], r["key"]) for r in shards.where("key IS NOT NULL AND shard > 0").collect())
    remove(spark, sized)
    return [key for _, key in found]


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, most_shards: int = MOST_SHARDS) -> DataFrame:
    """Write one record for each row of pages into `folder`, which all executors reach; the manifest is returned.

    The payload is the column's UTF-8 bytes, null as empty. Of rows with equal payloads of REVISIT_BYTES or more the
    one with the smallest key (a null key comes first) is a response and the others revisit it; shorter ones are all
    responses. Rows with one key and payload are told apart by their order: one is the response. A null or odd address is
    written as about:blank or percent-encoded. An empty table gives a manifest without rows. Other columns are left
    aside. Keys are integers or strings.

    Payloads are shuffled once, to their shard; who revisits whom is worked out on digests, summed up in the tasks
    first, so a payload that a third of all rows have is no single task's work. A key's rows are in one shard.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"{key} is {kind}; integers and strings are taken")
    body = F.coalesce(F.col(quoted(payload)).cast("string"), F.lit(""))
    rows = pages.select(F.col(quoted(key)).alias("key"), F.col(quoted(url)).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256))).withColumn("n", F.octet_length("body").cast("long"))

    narrow = written(rows.select("key", "digest", "n"), "warc-digests")
    bounds = _bounds(narrow, shard_bytes, most_shards)
    shard = _shard_of(bounds, kind)
    long = narrow.where(F.col("n") >= REVISIT_BYTES)
    seen = long.groupBy("digest").agg(F.count("*").alias("times"), F.min(F.struct(F.col("key").isNotNull().alias("full"), "key")).alias("least")).where("times > 1")
    # written, so that both sides of the join are plain exchanges and a payload that very many have can be split
    seen = written(seen.select("digest", F.col("least.key").alias("refers"), F.lit(True).alias("known")), "warc-seen")
    revisits = long.join(seen, "digest").where(~F.col("key").eqNullSafe(F.col("refers"))).select("key", "digest", "refers").distinct()

    # a revisit's note comes before the rows it is about
    none = F.lit(None).cast("string")
    notes = revisits.select(shard.alias("shard"), "key", "digest", F.lit(0).alias("kind"), none.alias("url"), none.alias("body"), F.col("refers").cast("string").alias("refers"))
    full = rows.select(shard.alias("shard"), "key", "digest", F.lit(1).alias("kind"), "url", "body", none.alias("refers"))
    dealt = notes.unionByName(full).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, refers, ordinal, shard = None, None, None, 0, None
        for batch in batches:
            for shard, k, digest, note, at, text, target in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, digest) != now:
                    now, refers, ordinal = (k, digest), None, 0
                name, hexed = None if k is None else str(k), digest.hex()
                if not note:
                    refers = record_id(target, hexed, 0)
                    continue
                data = text.encode()
                if ordinal and refers is None and len(data) >= REVISIT_BYTES:
                    refers = record_id(name, hexed, 0)
                out = out or _Shard(folder, shard, file_bytes)
                out.add(page_member, name, at, data, hexed, ordinal, refers)
                ordinal += 1
        if out is not None:
            out.close()
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.files), types)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    meant = written(dealt.mapInArrow(lean(run), MANIFEST), "warc-meant")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, was in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # a second try finds the file where it shall be
                if fs.get_file_info(f"{top}/{was}").type != pafs.FileType.NotFound:
                    fs.move(f"{top}/{was}", f"{top}/{name}")
            yield batch

    meant.repartition(_tasks(meant), "shard").mapInArrow(lean(publish), MANIFEST).drop("written_as").write.parquet(f"{folder}/manifest")
    remove(spark, narrow, seen, meant)
    _drop_temporary(spark, folder)
    return spark.read.parquet(f"{folder}/manifest")


def _tasks(files: DataFrame) -> int:
    """Tasks that handle files: stated, as adaptive execution would merge them by the few bytes of their names."""
    return max(1, min(files.count(), 8 * files.sparkSession.sparkContext.defaultParallelism))


def _drop_temporary(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _shard_of(bounds: list, kind: str) -> Column:
    """How many bounds (sorted) are at or below the key: found among every step-th one, then within that step. A null key is in the first shard."""
    if not bounds:
        return F.col("key").isNull().cast("int") * 0
    step = math.isqrt(len(bounds)) + 1
    every, coarse = (F.from_json(F.lit(json.dumps(b)), f"array<{kind}>") for b in (bounds, bounds[::step]))
    at_or_below = lambda array: F.size(F.filter(array, lambda b: b <= F.col("key")))
    block = F.greatest(at_or_below(coarse) - 1, F.lit(0)) * step
    return F.when(F.col("key").isNull(), 0).otherwise(block + at_or_below(F.slice(every, block + 1, F.lit(step))))


SCHEMA = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of a committed archive: SCHEMA's columns, and the payload (bytes, null for revisits) if wanted.

    A file is read as a stream, a record at a time; lengths and digests are checked and a broken record fails the read.
    """
    schema = SCHEMA + (", payload binary" if payloads else "")
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, size = [], 0
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{top}/{name}", compression=None) as source:
                    found = 0
                    for r in read_records(source):
                        found += 1
                        own = (bytes(r.payload) if r.payload is not None else None,) if payloads else ()
                        rows.append((key_of(r.record_id), r.url, r.payload_bytes, r.digest, r.kind, r.refers_to and key_of(r.refers_to), *own))
                        size += len(own[0] or b"") if own else 0
                        if len(rows) >= 5000 or size > 4_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if found != n:
                        raise ValueError(f"{name} has {found} records, its manifest says {n}")
        if rows:
            yield batch_of(rows)

    files = spark.read.parquet(f"{folder}/manifest").select("file", "records")
    return files.repartition(_tasks(files), "file").mapInArrow(lean(run), schema)


def op12_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back from the archives: what each record says."""
    folder = owned(new_path(spark, "warc"))
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    got = read_warc(spark, folder)
    return got.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.payload_bytes >= 100 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p JOIN f USING (payload_digest)"""
