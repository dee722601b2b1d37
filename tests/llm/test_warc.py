from __future__ import annotations

import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pyarrow.fs as pafs
import pytest

from fieldsonar.llm import warc as W
from tests.llm.util import DATA

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(3)
    long = lambda n: "".join(rng.choice("abc <>é\r\n") for _ in range(n))
    copy, other = long(500), long(120)
    rows = [(i, f"https://a.example/{i}", long(rng.randrange(2000))) for i in range(150)]
    rows += [(200 + i, "https://b.example/ü x\r\nWARC-Type: response", copy) for i in range(60)] + [(170 - i, None, other) for i in range(9)]
    rows += [(300, "u", None), (301, "u", ""), (302, "u", ""), (303, "", "short"), (304, "u", "short"), (305, "u", "x" * 99), (306, "u", "x" * 99), (307, "u", "x" * 100), (308, "u", "x" * 100)]
    rows += [(309, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 9), (310, "u", "é" * 50), (311, "u", "é" * 50), (-5, "u", long(300_000))]
    # repeated rows, keys with two payloads, null keys
    return rows + rows[:3] + [(0, "again", long(300)), (1, "same payload", rows[1][2])] + [(None, "n", "n" * 200), (None, "n", "n" * 200), (400, "n", "n" * 200), (None, None, None)]


def plain(rows):
    low = lambda k: (k is not None, k or 0)
    data = sorted(((k, (t or "").encode()) for k, _, t in rows), key=lambda r: (low(r[0]), r[1]))
    first, out, done = {}, [], set()
    for k, d in data:
        first.setdefault(d, k)
    for k, d in data:
        again = len(d) >= 100 and d in done
        done.add(d)
        out.append((k, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", first[d] if again else None))
    return out


def table(spark, rows, parts=4):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("key", "digest", "shard", "body", "n")})


def read(spark, folder):
    return [(None if r.key is None else int(r.key), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in W.read_warc(spark, folder).collect()]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}/a"
    manifest = W.write_warc(table(spark, pages()), folder, shard_bytes=20_000, file_bytes=6_000).collect()
    return folder, manifest


def test_read_back(spark, archive):
    folder, _ = archive
    assert sorted(read(spark, folder), key=key) == sorted(plain(pages()), key=key)


def test_payloads_come_back(spark, archive):
    got = W.read_warc(spark, archive[0], payloads=True).collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes for r in got if r.record_type == "response")
    assert sorted({r.url for r in got if r.key in ("200", "170")}) == ["about:blank", "https://b.example/%C3%BC%20x%0D%0AWARC-Type:%20response"]
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_files(archive):
    folder, manifest = archive
    top = Path(folder.removeprefix("file://"))
    files = sorted(f.name for f in top.glob("*.warc.gz"))
    assert files == sorted(r.file for r in manifest) and len(files) > 12
    assert not (top / "_temporary").exists() and (top / "manifest/_SUCCESS").exists()
    assert len({r.shard for r in manifest}) > 4 and any(r.file.endswith("-00002.warc.gz") for r in manifest)
    ids, keys = [], []
    for r in sorted(manifest, key=lambda r: r.file):
        data = (top / r.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        text = gzip.decompress(data)  # any reader of gzip
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
        with pafs.LocalFileSystem().open_input_stream(str(top / r.file), compression=None) as f:
            own = [x.record_id for x in W.read_records(f)]
        assert len(own) == r.records
        ids += own
        keys += [W.key_of(x) for x in own]
    assert len(set(ids)) == len(ids) == len(pages())
    order = [(k is not None, int(k or 0)) for k in keys]
    assert order == sorted(order)  # by key over all files


def test_equal_tables_give_equal_files(spark, archive, tmp_path):
    folder = f"file://{tmp_path}/b"
    rows = pages()
    random.Random(1).shuffle(rows)
    again = W.write_warc(table(spark, rows, 7), folder, shard_bytes=20_000, file_bytes=6_000).collect()
    assert sorted((r.file, r.sha256) for r in again) == sorted((r.file, r.sha256) for r in archive[1])


def test_broken_archives_are_refused(spark, archive, tmp_path):
    top = Path(archive[0].removeprefix("file://"))
    data = next(f for f in sorted(top.glob("*.warc.gz"))).read_bytes()
    for broken in (data[: len(data) // 2], gzip.compress(gzip.decompress(data).replace(b"200 OK", b"200 KO", 1))):
        (tmp_path / "x").write_bytes(broken)
        with pytest.raises((ValueError, KeyError)), pafs.LocalFileSystem().open_input_stream(str(tmp_path / "x"), compression=None) as f:
            list(W.read_records(f))


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    assert W.write_warc(spark.createDataFrame([], SCHEMA), folder).collect() == []
    assert read(spark, folder) == []


def test_bounds(spark):
    rows = [(i % 97, b"", 100 + i % 7) for i in range(2000)] + [(None, b"", 5000)]
    got = W._bounds(spark.createDataFrame(rows, "key long, digest binary, n long").repartition(5), 10_000, 50)
    sums = {}
    for k, _, n in rows:
        sums[k] = sums.get(k, 0) + n
    at, want = 0, {}
    for k in sorted(sums, key=lambda k: (k is not None, k)):
        want.setdefault(at // 10_000, k)
        at += sums[k]
    assert got == [want[s] for s in sorted(want) if s]
    keys = spark.createDataFrame([(k,) for k in [None, *range(-2, 99)]], "key long")
    shard = {r.key: r.shard for r in keys.select("key", W._shard_of(got, "bigint").alias("shard")).collect()}
    assert shard == {k: 0 if k is None else sum(b <= k for b in got) for k in shard}


def test_query(spark):
    from fieldsonar.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got = QUERIES["op12_warc_writer"](spark, str(DATA)).toPandas()
    want = con.sql(ORACLE_SQL["op12_warc_writer"]).df()
    assert len(got) == len(want) > 0
    both = [x.astype(object).where(x.notna(), None).sort_values("page_id")[sorted(want.columns)].values.tolist() for x in (got, want)]
    assert both[0] == both[1]
