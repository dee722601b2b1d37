"""Detections made from the driver's event stream, alike in Spark and in SQL, so that every operator has rows to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.timejoin import micros

#: Positions of the six sites (easting, northing).
SITE_POSITIONS = {
    1: (405877.2241577801, 115930.96270176416),
    2: (405833.91696353175, 115702.94238304385),
    3: (405670.7350641857, 115866.23779697344),
    4: (405623.2001221257, 115639.32681127204),
    5: (405478.2778005708, 115815.99241150077),
    6: (405405.43492317986, 115592.39495217375),
}

HOUR_US = 3_600_000_000


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero: the last bits of trigonometric functions differ between engines."""
    return F.round(c, places) + 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, site_id, t and block (hour number), peak_time_s, tdoa_ms, bearings and positions of every event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    rows = e.select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 6 + 1).cast("int").alias("site_id"),
        micros(F.col("ts")).alias("t"),
        "event_type",
        "user_id",
        (F.col("event_id") * 37 % 671 - 335).cast("int").alias("k"),
    )
    tau = F.col("tdoa_ms") / 1000.0
    rows = rows.withColumns({"block": F.floor(F.col("t") / F.lit(HOUR_US)).cast("long"), "tdoa_ms": F.col("k") / 768.0})
    rows = rows.withColumns({"peak_time_s": (F.col("t") - F.col("block") * F.lit(HOUR_US)) / 1e6, "abs_tdoa_ms": F.abs("tdoa_ms"), "bearing_1_deg": scalars.bearing_1(tau), "bearing_2_deg": scalars.bearing_2(tau)})
    # six sites: a lookup in the expression costs no join
    place = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in SITE_POSITIONS.values()]), F.col("site_id"))
    return rows.withColumns({"canonical_easting_m": place(0), "canonical_northing_m": place(1)})


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where(scalars.usable_tdoa(F.col("tdoa_ms")))


_PLACES = ", ".join(f"({s}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for s, (x, y) in SITE_POSITIONS.items())

#: The same rows in DuckDB, as common table expressions: places, det, good.
SQL = f"""places(site_id, sx, sy) AS (VALUES {_PLACES}),
det0 AS (SELECT event_id AS row_id, CAST(user_id % 6 + 1 AS INTEGER) AS site_id, epoch_us(ts) AS t, event_type, user_id,
  CAST(event_id * 37 % 671 - 335 AS INTEGER) AS k FROM events),
det1 AS (SELECT *, t // {HOUR_US} AS block, k / 768.0::DOUBLE AS tdoa_ms FROM det0),
det2 AS (SELECT *, (t - block * {HOUR_US}) / 1e6::DOUBLE AS peak_time_s, abs(tdoa_ms) AS abs_tdoa_ms,
  degrees(acos(greatest(least(tdoa_ms / 1000.0::DOUBLE * 343.0::DOUBLE / 0.15::DOUBLE, 1.0), -1.0))) AS phi FROM det1),
det AS (SELECT d.*, (90 - phi) - 360 * floor((90 - phi) / 360) AS bearing_1_deg, (90 + phi) - 360 * floor((90 + phi) / 360) AS bearing_2_deg,
  sx AS canonical_easting_m, sy AS canonical_northing_m FROM det2 d JOIN places USING (site_id)),
good AS (SELECT * FROM det WHERE abs(tdoa_ms) >= 0.025)"""
