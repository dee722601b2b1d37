"""Scalar macros on columns: parsing, time, angles, bearings, weights and quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S


def usable_tdoa(tdoa_ms: Column, least_ms: float = S.TDOA_THRESHOLD_MS) -> Column:
    """A delay of some size; null and NaN are not usable."""
    return ~F.isnan(tdoa_ms) & (F.abs(tdoa_ms) >= F.lit(least_ms))


def recorder_number(folder: Column, strict: bool = True) -> Column:
    """The number in `Recorder <n> ...`. Strict: no number is an error; else null."""
    number = F.expr("try_cast(null as int)") if folder is None else F.nullif(F.regexp_extract(folder, r"Recorder\s+(\d+)", 1), F.lit("")).try_cast("int")
    if not strict:
        return number
    return F.coalesce(number, F.raise_error(F.concat(F.lit("no recorder number in: "), F.coalesce(folder, F.lit("null")))).cast("int"))


def coordinate(value: Column, strict: bool = True) -> Column:
    """Degrees of a text such as 1.92444W: trimmed, the last letter N, S, E or W in either case; S and W negative."""
    text = F.trim(value)
    size = F.char_length(text)
    side = F.upper(F.substring(text, size, F.lit(1)))
    degrees = F.substring(text, F.lit(1), size - 1).try_cast("double")
    signed = F.when(side.isin("W", "S"), -degrees).when(side.isin("E", "N"), degrees)
    got = F.when(F.char_length(value) >= 2, signed)
    if not strict:
        return got
    return F.coalesce(got, F.raise_error(F.concat(F.lit("not a coordinate: "), F.coalesce(value, F.lit("null")))).cast("double"))


def recording_start(date: Column, time: Column, ntz: bool = False, strict: bool = False) -> Column:
    """Start of a recording from its date, month first and else day first, and time. Null (or an error) if neither fits."""
    parse = lambda fmt: F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(fmt))
    both = F.when(date.isNotNull() & time.isNotNull(), F.coalesce(parse("M-d-yyyy H:m:s"), parse("d-M-yyyy H:m:s")))
    if ntz:
        both = both.cast("timestamp_ntz")
    if not strict:
        return both
    return F.coalesce(both, F.raise_error(F.concat(F.lit("not a date and time: "), F.concat_ws(" ", date, time))).cast("timestamp"))


def block_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH:mm:ss")


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH:mm")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    """Absolute time so many seconds later, to the microsecond (half to even)."""
    return F.timestamp_micros(F.unix_micros(ts) + F.rint(seconds * 1e6).cast("long"))


def wrap_degrees(angle: Column) -> Column:
    """The angle in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def bearing_between(from_x: Column, from_y: Column, x: Column, y: Column) -> Column:
    """Bearing of a point, clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x - from_x, y - from_y)) + 360.0, F.lit(360.0))


def tdoa_weight(abs_tdoa_ms: Column) -> Column:
    """Weight of a detection: rises with the delay between two limits, never under a least weight."""
    share = (abs_tdoa_ms - S.TDOA_THRESHOLD_MS) / (S.TDOA_WEIGHT_HIGH_MS - S.TDOA_THRESHOLD_MS)
    return F.greatest(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(S.MIN_WEIGHT))


def _broadside(tau_s: Column, spacing: float, speed: float) -> Column:
    return F.degrees(F.acos(F.greatest(F.least(tau_s * speed / spacing, F.lit(1.0)), F.lit(-1.0))))


def bearing_1(tau_s: Column, spacing: float = S.MIC_SPACING_M, speed: float = S.SPEED_OF_SOUND_M_S) -> Column:
    return F.pmod(90.0 - _broadside(tau_s, spacing, speed), F.lit(360.0))


def bearing_2(tau_s: Column, spacing: float = S.MIC_SPACING_M, speed: float = S.SPEED_OF_SOUND_M_S) -> Column:
    return F.pmod(90.0 + _broadside(tau_s, spacing, speed), F.lit(360.0))


def joined_bearings(bearings: Column) -> Column:
    """Text of an array of bearings, three decimals each, between bars."""
    return F.array_join(F.transform(bearings, lambda b: F.format_string("%.3f", b)), "|")


def channels_text(channels: Column) -> Column:
    return F.array_join(F.array_sort(channels), ",")


def quality_pass(rms_deg: Column, geometry: Column, n_sites: Column, margin: Column) -> Column:
    """Small residual, bearings that cross well and, from three sites on, a clear best branch."""
    good = (rms_deg <= S.MAX_RMS_DEG) & (geometry >= S.MIN_GEOMETRY_SCORE)
    return good & ((n_sites < 3) | (margin >= S.MIN_BRANCH_MARGIN))


def geometry_score(bearings: Column) -> Column:
    """Least |sin| of the angle between any two bearings of an array; 0 with fewer than two."""
    indexed = F.transform(bearings, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    crossing = lambda x: F.transform(F.filter(indexed, lambda y: y["i"] > x["i"]), lambda y: F.abs(F.sin(F.radians(wrap_degrees(y["b"] - x["b"])))))
    return F.coalesce(F.array_min(F.flatten(F.transform(indexed, crossing))), F.lit(0.0))


def mapped_rank(index: Column, anchors: Column, others: Column) -> Column:
    """Position among `others` rows that corresponds to position `index` of `anchors` rows (from 0; half to even)."""
    share = index / F.when(anchors > 1, anchors - 1).cast("double")
    return F.when((anchors <= 1) | (others <= 1), F.lit(0)).otherwise(F.rint(share * (others - 1)).cast("int"))
