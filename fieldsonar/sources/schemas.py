"""Schemas of all tables that are read or written; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """A schema from `name type` pairs; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


#: Recorder metadata: every value is text.
METADATA_COLUMNS = ("DATE", "TIME", "LON", "LAT", "BAT", "TEMP", "HUMI", "FILE", "GAIN", "SAMPLE RATE", "CHANNEL", "NOTE")
METADATA = T.StructType([T.StructField(c, T.StringType()) for c in METADATA_COLUMNS])

RESULT = _struct(
    "wav_file string, birdnet_start_s double, birdnet_end_s double, peak_time_s double, gcc_start_s double, gcc_end_s double, "
    "tdoa_ms double, lag_samples double, bearing_1_deg double, bearing_2_deg double, detected_by string"
)
#: Order of a detections file.
DETECTIONS = T.StructType([T.StructField("recorder_folder", T.StringType()), *METADATA.fields, *RESULT.fields])

SITES = _struct("site_id int, n_detections long, n_unique_locations long, canonical_easting_m double, canonical_northing_m double, canonical_lon_deg double, canonical_lat_deg double")

#: branch_bits is text: read as a number it would lose its leading zeros.
SOLUTIONS = _struct(
    "event_id long, n_sites int, event_time_min timestamp, event_time_max timestamp, triangulation_success boolean, quality_pass boolean, "
    "solution_easting_m double, solution_northing_m double, solution_lon_deg double, solution_lat_deg double, branch_bits string, "
    "objective double, rms_residual_deg double, geometry_score double, branch_margin double, chosen_bearings_deg string"
)

OFFSETS = _struct(
    "reference_site_id int, other_site_id int, n_matches long, median_delta_s_other_minus_ref double, mad_delta_s double, "
    "p10_delta_s double, p90_delta_s double, applied_correction_s double"
)
DIAGNOSTICS = _struct(
    "diagnostic_type string, window_seconds double, multi_site_events_raw long, multi_site_events_offset_corrected long, improvement long, "
    "reference_site_id int, other_site_id int, n_matches long, median_delta_s_other_minus_ref double, mad_delta_s double, "
    "p10_delta_s double, p90_delta_s double, applied_correction_s double"
)
