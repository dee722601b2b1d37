"""Scans: recorder folders, metadata files, recordings, detection files and the species list."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import projection, scalars
from ..settings import FIELD_TIMEZONE, TDOA_THRESHOLD_MS
from .schemas import DETECTIONS, METADATA, METADATA_COLUMNS

#: Folders that are never recorders.
NOT_RECORDERS = ("System Volume Information",)


def _folder(path):
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def _name(path):
    return F.url_decode(F.regexp_extract(path, r"([^/]+)$", 1))


def recorder_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, recorder_folder, file for files right under `Recorder*` folders of root; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    rows = found.select("path", _folder(F.col("path")).alias("recorder_folder"), _name(F.col("path")).alias("file"))
    return rows.where(F.col("recorder_folder").startswith("Recorder") & ~F.col("recorder_folder").isin(*NOT_RECORDERS))


def _plain(column):
    """A column name or value without a byte order mark."""
    return F.regexp_replace(column, "^﻿", "")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all info.txt files: recorder_folder, row_no, the listed columns, and `others`, all further columns by name.

    A file is read as a CSV reader does: quoted values may hold commas, quotes and line breaks; a byte order mark and
    blank lines are dropped; every value is text, an empty one null. Columns go by their names in each file's header, so files may order
    them differently, lack some or have any number of others. A row with fewer values than the header has nulls.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "info.txt").option("recursiveFileLookup", "true").load(root)
    found = raw.select(_folder(F.col("path")).alias("recorder_folder"), "content").where(F.col("recorder_folder").startswith("Recorder"))
    kinds = ", ".join(f"`{c}` string" for c in METADATA_COLUMNS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, content in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (r for r in csv.reader(io.StringIO((content or b"").decode("utf-8-sig", "replace"), newline="")) if any(x.strip() for x in r))
                header = [h.strip() for h in next(lines, [])]
                rows = [dict(zip(header, r)) for r in lines]
                if rows:
                    others = [[(k, r[k] or None) for k in dict.fromkeys(header) if k in r and k not in METADATA_COLUMNS] for r in rows]
                    cols = [pa.array([folder] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), *(pa.array([r.get(c) or None for r in rows], pa.string()) for c in METADATA_COLUMNS), pa.array(others, pa.map_(pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["recorder_folder", "row_no", *METADATA_COLUMNS, "others"])

    return found.mapInArrow(read, f"recorder_folder string, row_no int, {kinds}, others map<string,string>")


def folders_without_metadata(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Recorder folders that have recordings and no metadata, for the log."""
    return files.select("recorder_folder").distinct().join(meta.select("recorder_folder").distinct(), "recorder_folder", "left_anti")


def named_recordings(meta: DataFrame) -> DataFrame:
    """Metadata rows with a file name that is not blank, trimmed to wav_file."""
    return meta.withColumn("wav_file", F.trim(F.coalesce("FILE", F.lit("")))).where("wav_file != ''")


def present(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Recordings whose file is there, with its path."""
    return recordings.join(files.select("recorder_folder", F.col("file").alias("wav_file"), "path"), ["recorder_folder", "wav_file"])


def missing(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Recordings whose file is not there, for the log."""
    return recordings.join(files.select("recorder_folder", F.col("file").alias("wav_file")), ["recorder_folder", "wav_file"], "left_anti")


def species(spark: SparkSession, path: str) -> DataFrame:
    """Allowed species, one a line."""
    return spark.read.text(path).select(F.trim(_plain(F.col("value"))).alias("species")).where("species != ''").distinct()


def allowed(detections: DataFrame, listed: DataFrame, column: str = "species") -> DataFrame:
    """Detections of listed species; a species list is a short file, and the planner broadcasts it by its size."""
    return detections.join(listed.withColumnRenamed("species", column), column, "left_semi")


def require_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Fail, naming every missing path, before anything is read."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    absent = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            absent.append(p)
    if absent:
        raise FileNotFoundError("missing inputs: " + ", ".join(absent))


def detections(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of all detection files with the file they came from; columns by name, all files in one scan."""
    require_inputs(spark, paths)
    headers = {p: spark.read.csv(p, header=True, encoding="UTF-8").columns for p in paths}
    frames = []
    for names in dict.fromkeys(tuple(h) for h in headers.values()):
        same = [p for p in paths if tuple(headers[p]) == names]
        kinds = {f.name: f.dataType for f in DETECTIONS.fields}
        clean = [n.lstrip("﻿") for n in names]
        schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in clean])
        rows = spark.read.csv(same, header=True, schema=schema, nanValue="nan", positiveInf="inf", enforceSchema=True)
        frames.append(rows.withColumn("source_file", F.col("_metadata.file_name")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def prepared(rows: DataFrame, least_ms: float = TDOA_THRESHOLD_MS) -> DataFrame:
    """Usable detections with site, coordinates, times and grid position. The session's zone must be the field's.

    The delay filter comes before all parsing and projecting. Text that cannot be parsed is an error, as a silent null
    would drop calls.
    """
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone != FIELD_TIMEZONE:
        raise ValueError(f"spark.sql.session.timeZone is {zone}; local times need {FIELD_TIMEZONE}")
    kept = rows.where(scalars.usable_tdoa(F.col("tdoa_ms"), least_ms))
    start = scalars.recording_start(F.col("DATE"), F.col("TIME"), strict=True)
    kept = kept.withColumns({"site_id": scalars.recorder_number(F.col("recorder_folder")), "lon_deg": scalars.coordinate(F.col("LON")), "lat_deg": scalars.coordinate(F.col("LAT")), "recording_datetime": start})
    kept = projection.with_grid(kept, F.col("lon_deg"), F.col("lat_deg"))
    return kept.withColumns(
        {
            "recording_start": F.col("recording_datetime"),
            "recording_block_key": scalars.block_key(F.col("recording_datetime")),
            "event_time": scalars.plus_seconds(F.col("recording_datetime"), F.col("peak_time_s")),
        }
    )


assert METADATA.names == list(METADATA_COLUMNS)
