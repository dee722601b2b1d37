"""From files to files: scans, the localisation run, sinks, and the stream."""

from __future__ import annotations

import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsonar.operators import events
from fieldsonar.plans import localise
from fieldsonar.sources import ingest, sinks
from fieldsonar.sources.schemas import DETECTIONS, SOLUTIONS
from fieldsonar.streaming import sessions
from tests.test_audio import call, wav

HEAD = "DATE,TIME,LON,LAT,BAT,TEMP,HUMI,FILE,GAIN,SAMPLE RATE,CHANNEL,NOTE"
SITES = {1: ("1.91772W", "50.94279N"), 2: ("1.91834W", "50.94074N"), 3: ("1.92066W", "50.94221N"), 6: ("1.92444W", "50.93975N")}


@pytest.fixture(scope="module")
def field(tmp_path_factory):
    root = tmp_path_factory.mktemp("field")
    for n, (lon, lat) in SITES.items():
        d = root / f"Recorder {n} - 1004 to 1704"
        d.mkdir()
        rows = [f"04-13-2026,06:{40 + i}:00,{lon},{lat},4.1,12,80, r{n}_{i}.wav ,1,48000,2,\"a, note\"" for i in range(3)] + [f"04-13-2026,07:00:00,{lon},{lat},,,,  ,,,,", f"04-13-2026,07:00:00,{lon},{lat},,,,gone.wav,,,,"]
        (d / "info.txt").write_text("﻿" + "\n".join([HEAD, *rows]) + "\n", encoding="utf-8")
        for i in range(3):
            (d / f"r{n}_{i}.wav").write_bytes(wav(call(4 * n + i - 20), 4))
    (root / "Recorder 9 without").mkdir()
    (root / "Recorder 9 without" / "x.wav").write_bytes(b"x")
    (root / "Other").mkdir()
    (root / "Other" / "info.txt").write_text(HEAD + "\n")
    (root / "species_list.txt").write_text("bird\n\n")
    return root


def detector(channel, rate, allowed, confidence, overlap):
    return [(0.0, 3.0, "bird", 0.8)]


def test_scans(spark, field):
    meta, files = ingest.metadata(spark, str(field)), ingest.recorder_files(spark, str(field), "*.wav")
    assert meta.count() == 5 * len(SITES) and {r.NOTE for r in meta.collect()} == {"a, note", None}
    assert meta.where(F.col("DATE") == "04-13-2026").count() == 5 * len(SITES)
    named = ingest.named_recordings(meta)
    assert named.count() == 4 * len(SITES) and ingest.present(named, files).count() == 3 * len(SITES)
    assert [r.wav_file for r in ingest.missing(named, files).collect()] == ["gone.wav"] * len(SITES)
    assert [r[0] for r in ingest.folders_without_metadata(files, meta).collect()] == ["Recorder 9 without"]
    assert [r[0] for r in ingest.species(spark, f"{field}/species_list.txt").collect()] == ["bird"]
    with pytest.raises(FileNotFoundError, match="nothing.csv.*none.csv"):
        ingest.require_inputs(spark, [f"{field}/nothing.csv", f"{field}/species_list.txt", f"{field}/none.csv"])


def test_run_from_recordings_to_calls(spark, field, tmp_path):
    found = localise.detect_calls(spark, str(field), detector, f"{field}/species_list.txt")
    assert found.columns == DETECTIONS.names and found.count() == 3 * len(SITES)
    assert sinks.write_csv(found, f"{tmp_path}/a", one_file=True, skip_empty=True)
    assert not sinks.write_csv(found.limit(0), f"{tmp_path}/none", skip_empty=True)
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        out = localise.localise(spark, [f"{tmp_path}/a"], f"{tmp_path}/out")
        solved = out["solutions"].collect()
        assert out["solutions"].columns == SOLUTIONS.names and len(solved) > 0 and all(r.n_sites == 4 for r in solved)
        assert out["sites"].count() == len(SITES) and out["offsets"].count() == 0 and out["diagnostics"].count() == 11
        assert {r.improvement for r in out["diagnostics"].collect()} == {0}
        first = out["members"].first()
        assert first.source_file.endswith(".csv") and first.event_time.minute == 40
        assert out["members"].select(F.date_format("event_time", "HH:mm").alias("h")).first().h == "06:40"
        again = localise.localise(spark, [f"{tmp_path}/a"], calibrate=True)
        assert again["offsets"].count() == len(SITES) - 1 and again["diagnostics"].count() == 11 + len(SITES) - 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    part = next((tmp_path / "out" / "offsets").glob("part-*"))
    assert next(csv.reader(part.open()))[0] == "reference_site_id"  # a header alone
    page = (tmp_path / "out" / "sites_map.html").read_text()
    assert "Recorder 1" in page and "tile.openstreetmap.org" in page
    back = spark.read.csv(f"{tmp_path}/out/solutions", header=True, schema=SOLUTIONS, positiveInf="Infinity")
    assert {r.branch_bits for r in back.collect()} == {r.branch_bits for r in solved}
    with pytest.raises(ValueError, match="Europe/London"):
        ingest.prepared(ingest.detections(spark, [f"{tmp_path}/a"]))


def test_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿recorder_folder,tdoa_ms,extra\nRecorder 1,0.5,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("tdoa_ms,recorder_folder\n0.25,Recorder 2\n")
    got = ingest.detections(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert {(r.recorder_folder, r.tdoa_ms, r.extra, r.source_file) for r in got.collect()} == {("Recorder 1", 0.5, "x", "a.csv"), ("Recorder 2", 0.25, None, "b.csv")}


def test_union_and_maps(spark):
    a, b = spark.createDataFrame([(1.0, "x")], "tdoa_ms double, zeta string"), spark.createDataFrame([("f", 2)], "wav_file string, alpha int")
    assert sinks.union_by_name([a, b]).columns == ["wav_file", "tdoa_ms", "zeta", "alpha"]
    none = spark.createDataFrame([], "lon double, lat double")
    with pytest.raises(ValueError):
        sinks.site_map_html(none, none, none)


def test_stream_of_sessions(spark, tmp_path):
    start = dt.datetime(2026, 4, 13, 6)
    times = [0, 5, 20, 31, 35, 70, 72, 500]
    rows = [("k", i % 3, start + dt.timedelta(seconds=s), 0.1) for i, s in enumerate(times)]
    schema = "key string, site_id int, event_time timestamp, tdoa_ms double"
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    spark.createDataFrame([("k", 1, start + dt.timedelta(hours=2), 0.1), ("k", 1, start + dt.timedelta(hours=2), 0.001)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = sessions.anchored_counts(sessions.usable_detections(stream, late="1 minute"), 30.0, "key")
    q = counts.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.table("sessions").collect(), key=lambda r: r.anchor)
    batch = spark.createDataFrame([(r[2], r[1]) for r in rows], "event_time timestamp, site_id int").select(F.unix_micros("event_time").alias("t"), "site_id")
    want = sorted((r.anchor, r.n) for r in events.anchored_sessions(batch, 30_000_000).groupBy("anchor").agg(F.count("*").alias("n")).collect())
    epoch = int(start.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert [(int((r.anchor - start).total_seconds() * 1e6) + epoch, r.n_detections) for r in got] == want


def test_metadata_as_a_csv_reader_has_it(spark, tmp_path):
    d = tmp_path / "Recorder 5"
    d.mkdir()
    many = [f"X{i}" for i in range(60)]
    head = ",".join(["FILE", "NOTE", *many])
    rows = ["a.wav,\"two\nlines, \"\"quoted\"\"\"," + ",".join(map(str, range(60))), "", "b.wav,short"]
    (d / "info.txt").write_bytes(("\ufeff" + "\r\n".join([head, *rows])).encode())
    got = {r.FILE: r for r in ingest.metadata(spark, str(tmp_path)).collect()}
    assert got["a.wav"].NOTE == 'two\nlines, "quoted"' and got["a.wav"].others == {f"X{i}": str(i) for i in range(60)}
    assert got["b.wav"].NOTE == "short" and got["b.wav"].others == {} and got["b.wav"].DATE is None


def test_summary(spark):
    """Counts taken while a table is written."""
    from pyspark.sql import Observation

    solved = spark.createDataFrame([(0, 2, True, True), (1, 3, True, False), (2, 2, False, False), (3, 5, True, True)], "event_id long, n_sites int, triangulation_success boolean, quality_pass boolean")
    for rows, share in ((solved, 2 / 3), (solved.limit(0), None)):
        seen = Observation()
        localise.observed_solutions(rows, seen).write.format("noop").mode("overwrite").save()
        got = {r.measure: r.value for r in localise.summary(spark, seen).collect()}
        assert got["quality_share"] == share
    seen = Observation()
    localise.observed_solutions(solved, seen).write.format("noop").mode("overwrite").save()
    got = {r.measure: r.value for r in localise.summary(spark, seen).collect()}
    assert got == {"candidate_events": 4, "events_of_2_sites": 2, "events_of_3_sites": 1, "events_of_more_sites": 1, "located": 3, "not_located": 1, "quality_pass": 2, "quality_share": 2 / 3}


def test_large_layers_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PAGE_ROWS", 3)
    place = spark.range(3).selectExpr("id AS site_id", "'Recorder ' || id AS label", "1L AS n_detections", "id / 10 AS lon", "double(50 + id) AS lat")
    page = sinks.site_map_html(place, spark.range(4).selectExpr("id AS det_id"), spark.range(2).selectExpr("id AS event_id"))
    assert '"left_out": ["bearings"]' in page and "Recorder 2" in page and '"bounds": [[50.0, 0.0], [52.0, 0.2]]' in page


def test_command_line(spark, field, tmp_path, monkeypatch):
    from fieldsonar import __main__ as command

    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "own_detector.py").write_text("def detect(channel, rate, allowed, confidence, overlap):\n    return [(0.0, 3.0, 'bird', 0.8)]\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        command.main(["detect", str(field), "--detector", "own_detector:detect", "--out", f"{tmp_path}/found"], spark)
        command.main(["localise", f"{tmp_path}/found", "--out", f"{tmp_path}/out"], spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spark.read.csv(f"{tmp_path}/found", header=True).count() == 3 * len(SITES)
    told = {r.measure: float(r.value) for r in spark.read.csv(f"{tmp_path}/out/summary", header=True).collect() if r.value}
    assert told["detections_read"] == 3 * len(SITES) >= told["detections"] > 0 and told["sites"] == len(SITES) and told["blocks_with_events"] > 0
    assert (tmp_path / "out" / "sites_map.html").exists()
