"""The two entry points: recordings to detections, and detections to located calls with diagnostics and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import audio, events, mapping, sites, solver, timejoin
from ..sources import ingest, sinks
from ..sources.schemas import DIAGNOSTICS, METADATA_COLUMNS, OFFSETS, SOLUTIONS
from ..storage import written

#: Paths that are broadcast to the contents of recordings: some tens of MB at most.
MOST_PATHS = 200_000


def detect_calls(spark: SparkSession, root: str, detector: audio.Detector, species_list: str | None = None) -> DataFrame:
    """Delays and bearings of all calls that a detector finds in both channels of the recordings under root.

    Recorder folders without metadata, rows without a file name and missing files drop out; ingest has each as a table
    for the log.
    """
    listed = frozenset(r[0] for r in ingest.species(spark, species_list).collect()) if species_list else None
    files = ingest.recorder_files(spark, root, "*.[wW][aA][vV]")
    found = written(ingest.present(ingest.named_recordings(ingest.metadata(spark, root)), files), "recordings")
    wavs = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(root)
    wanted = found.select("path", "recorder_folder", "wav_file").distinct()
    # a list of few paths goes to the contents; with more, the contents are dealt out by path
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_PATHS else wanted.hint("merge")
    got = audio.calls(wavs.select("path", "content").join(wanted, "path"), detector, listed).drop("too_short")
    others = sorted(r[0] for r in found.select(F.explode(F.map_keys("others"))).distinct().collect())
    meta = found.select("recorder_folder", "wav_file", *[F.col(f"`{c}`") for c in METADATA_COLUMNS], *[F.col("others")[c].alias(c) for c in others if c not in got.columns])
    return sinks.union_by_name([got.join(meta, ["recorder_folder", "wav_file"])])


def with_places(prepared: DataFrame, table: DataFrame) -> DataFrame:
    """Detections with canonical positions, from the table of sites, and the operators' working columns."""
    return sites.with_sites(prepared, table, check=False).withColumns(
        {
            "abs_tdoa_ms": F.abs("tdoa_ms"),
            "corrected_event_time": F.col("event_time"),
            "t": F.unix_micros("event_time"),
            "block": F.col("recording_block_key"),
            "time_block": F.date_format("recording_start", "yyyy-MM-dd_HH:mm"),
            # of columns as read, not of projected ones: the optimizer would carry those into every join on it
            "row_id": F.xxhash64(*[F.col(c) for c in ("source_file", "recorder_folder", "wav_file", "birdnet_start_s", "birdnet_end_s", "peak_time_s", "tdoa_ms")]),
        }
    )


def calibrated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections with clocks corrected by the median difference to the busiest site, and the offsets."""
    offsets = timejoin.clock_offsets(rows)
    out = timejoin.with_offsets(rows, offsets).withColumn("corrected_event_time", F.timestamp_micros("t_corrected"))
    return out.drop("t").withColumnRenamed("t_corrected", "t"), offsets


def no_offsets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OFFSETS)


def diagnostics(raw: DataFrame, corrected: DataFrame, offsets: DataFrame, reference_site: int | None = None) -> DataFrame:
    """Window sweep and pair offsets in one table; raw and corrected have row_id, site_id and t."""
    both = raw.select("row_id", "site_id", F.col("t").alias("raw")).join(corrected.select("row_id", F.col("t").alias("fixed")), "row_id")
    sweep = events.window_sweep(both, S.WINDOW_SWEEP_SECONDS, "raw", "fixed")
    ref = raw.agg(F.min("site_id").cast("int").alias("r")) if reference_site is None else raw.sparkSession.createDataFrame([(reference_site,)], "r int")
    sweep = sweep.crossJoin(F.broadcast(ref)).withColumnRenamed("r", "reference_site_id").withColumn("diagnostic_type", F.lit("window_sweep"))
    pairs = offsets.withColumn("diagnostic_type", F.lit("pair_offset"))
    out = sweep.unionByName(pairs, allowMissingColumns=True)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in DIAGNOSTICS.fields]).orderBy(F.desc("diagnostic_type"), "window_seconds", "other_site_id")


def observed_solutions(solved: DataFrame, seen: Observation) -> DataFrame:
    """The solutions, whose counts `seen` gets when they are written."""
    return solved.observe(
        seen,
        F.count(F.lit(1)).alias("candidate_events"),
        *[F.count_if(F.col("n_sites") == n).alias(f"events_of_{n}_sites") for n in (2, 3)],
        F.count_if(F.col("n_sites") > 3).alias("events_of_more_sites"),
        F.count_if("triangulation_success").alias("located"),
        F.count_if(~F.col("triangulation_success")).alias("not_located"),
        F.count_if("quality_pass").alias("quality_pass"),
    )


def summary(spark: SparkSession, *seen: Observation) -> DataFrame:
    """What a run reports, one row each: measure and value. The counts were taken while tables were written, so they cost no scan.

    Also the share that passes of the located events, null without any.
    """
    counts: dict[str, float | None] = {k: float(v) for o in seen for k, v in o.get.items()}
    if "located" in counts:
        counts["quality_share"] = counts["quality_pass"] / counts["located"] if counts["located"] else None
    return spark.createDataFrame(list(counts.items()), "measure string, value double")


def localise(spark: SparkSession, paths: list[str], out: str | None = None, calibrate: bool = False) -> dict[str, DataFrame]:
    """All tables of a run: sites, offsets, diagnostics, members, solutions, summary; written as CSV, with a map, under `out`.

    Detections, sites, members and solutions are worked out and written once, in the shared folder, and read from there
    by whatever needs them.
    """
    read, kept, of_sites, of_blocks, of_members, of_events = (Observation(n) for n in ("read", "kept", "sites", "blocks", "members", "events"))
    count = F.count(F.lit(1))
    scanned = ingest.detections(spark, paths).observe(read, count.alias("detections_read"))
    prepared = written(ingest.prepared(scanned).observe(kept, count.alias("detections")), "detections")
    table = written(sites.site_summary(prepared).observe(of_sites, count.alias("sites")), "sites")
    rows = written(with_places(prepared, table), "placed")
    corrected, offsets = calibrated(rows) if calibrate else (rows, no_offsets(spark))
    offsets = written(offsets, "offsets")
    members = written(events.build_events(corrected, seen=of_blocks).observe(of_members, count.alias("event_members")), "members")
    solved = written(observed_solutions(solver.solve(members), of_events), "solutions").orderBy("event_id")
    result = {
        "sites": table.orderBy("site_id"),
        "offsets": offsets,
        "diagnostics": diagnostics(rows, corrected, offsets),
        "members": members.drop("t", "block", "time_block", "row_id").orderBy("event_id", "corrected_event_time"),
        "solutions": solved.select(*SOLUTIONS.names),
        "summary": summary(spark, read, kept, of_sites, of_blocks, of_members, of_events),
    }
    if out:
        for name, df in result.items():
            sinks.write_csv(df, f"{out}/{name}", one_file=True)
        page = sinks.site_map_html(mapping.site_records(table), mapping.bearing_lines(corrected), mapping.call_records(result["solutions"]))
        sinks.write_text(spark, page, f"{out}/sites_map.html")
    return result
