"""Location of events: every choice of one of two bearings a site, robust fits, rejection, and the best branch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import projection, scalars
from .bearing_fit import Bearings, fit
from .branch_search import best_two

#: Up to so many sites all branches are fitted, many events at once; beyond, a search finds the two best ones.
FITTED_WHOLE = 8
#: Branches that are fitted at once.
BRANCHES = 1 << 14


def branch_costs(members: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row an event and branch: event_id, n_sites, branch, branch_bits, bearings, and its Huber cost, weighted RMS residual and geometry score at a point.

    The sites of an event, by id, are the bits of the branch number, the first the highest; 0 takes bearing_1. The point
    is given by columns of the members, alike for all of an event. Each site's two terms are worked out once; branches
    grow site by site from those they share their first bits with, so a branch costs one addition and not one a site.
    """
    predicted = scalars.bearing_between(F.col("canonical_easting_m"), F.col("canonical_northing_m"), x, y)
    weight = scalars.tdoa_weight(F.col("abs_tdoa_ms"))

    def terms(bearing: str, bit: str) -> Column:
        r = scalars.wrap_degrees(F.col(bearing) - predicted)
        z = F.col("w") * F.pow(r / S.ORIENTATION_SIGMA_DEG, 2)
        return F.struct(F.lit(bit).alias("bit"), F.col(bearing).alias("bearing"), (F.when(z <= 1, z).otherwise(2 * F.sqrt(z) - 1) * 0.5).alias("cost"), (F.col("w") * r * r).alias("square"))

    site = F.struct("site_id", "w", F.array(terms("bearing_1_deg", "0"), terms("bearing_2_deg", "1")).alias("either"))
    events = members.withColumn("w", weight).groupBy("event_id").agg(F.sort_array(F.collect_list(site)).alias("sites"), F.sum("w").alias("weight"))
    root = F.array(F.struct(F.lit("").alias("bits"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("square"), F.lit(1.0).alias("apart"), F.array().cast("array<double>").alias("bearings")))

    def grown(branch: Column, term: Column) -> Column:
        least = F.aggregate(branch["bearings"], branch["apart"], lambda acc, b: F.least(acc, F.abs(F.sin(F.radians(term["bearing"] - b)))))
        return F.struct(
            F.concat(branch["bits"], term["bit"]).alias("bits"), (branch["cost"] + term["cost"]).alias("cost"), (branch["square"] + term["square"]).alias("square"), least.alias("apart"),
            F.concat(branch["bearings"], F.array(term["bearing"])).alias("bearings"),
        )

    leaves = F.aggregate("sites", root, lambda acc, s: F.flatten(F.transform(acc, lambda branch: F.transform(s["either"], lambda term: grown(branch, term)))))
    each = events.select("event_id", F.size("sites").alias("n_sites"), "weight", F.posexplode(leaves).alias("branch", "b"))
    rms = F.sqrt(F.col("b.square") / F.col("weight"))
    apart = F.when(F.col("n_sites") > 1, F.col("b.apart")).otherwise(0.0)
    return each.select("event_id", "n_sites", "branch", F.col("b.bits").alias("branch_bits"), F.col("b.bearings").alias("bearings"), F.col("b.cost").alias("objective"), rms.alias("rms_residual_deg"), apart.alias("geometry_score"))


def weights_of(abs_tdoa_ms: np.ndarray) -> np.ndarray:
    share = (abs_tdoa_ms - S.TDOA_THRESHOLD_MS) / (S.TDOA_WEIGHT_HIGH_MS - S.TDOA_THRESHOLD_MS)
    return np.maximum(np.clip(share, 0.0, 1.0), S.MIN_WEIGHT)


@dataclass
class Located:
    """Best branches of events, one entry an event; nothing is known of an event whose `found` is false."""

    found: np.ndarray
    x: np.ndarray
    y: np.ndarray
    #: The branch, a row an event: 0 or 1 a site.
    branch: np.ndarray
    objective: np.ndarray
    rms: np.ndarray
    geometry: np.ndarray
    margin: np.ndarray
    #: Bearings that the branch takes, a row an event, by site.
    bearings: np.ndarray


def locate(sx: np.ndarray, sy: np.ndarray, one: np.ndarray, two: np.ndarray, abs_tdoa_ms: np.ndarray, whole: int = FITTED_WHOLE) -> Located:
    """The best branches of events with equally many sites, each a row of the arrays (event, site).

    Each fit starts at the mean of its sites, in a box about them. Fits that have not converged, or lie too far from a
    site, are out; so are all of an event of two sites whose fits disagree. Of the others the least loss wins, the first
    branch of equal ones. Events of up to `whole` sites have all branches of all events in one batch of fits; those of
    more are searched one by one, with the same result.
    """
    events, n = sx.shape
    weight = weights_of(abs_tdoa_ms)
    if n > max(whole, 2):
        each = [_searched(*rows) for rows in zip(sx, sy, one, two, weight)]
        found, bits, best, least, following = (np.array([e[k] for e in each]) for k in range(5))
    else:
        found, bits, best, least, following = _all_fitted(sx, sy, one, two, weight)
    taken = np.where(bits == 1, two, one)
    off = Bearings(sx, sy, weight, taken, 1.0).off(best)
    rms = np.sqrt((weight * off**2).sum(axis=1) / weight.sum(axis=1))
    i, j = np.triu_indices(n, 1)
    crossing = np.abs(np.sin(np.radians(taken[:, i] - taken[:, j]))).min(axis=1) if n > 1 else np.zeros(events)
    with np.errstate(invalid="ignore"):
        margin = following - least
    return Located(found, best[:, 0], best[:, 1], bits, least, rms, crossing, margin, taken)


def _fits(sx: np.ndarray, sy: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, loss, and whether the fit holds, of problems with given bearings."""
    problem = Bearings(sx, sy, weight, chosen, S.ORIENTATION_SIGMA_DEG)
    low, high = (np.stack([f(sx, axis=1) + pad, f(sy, axis=1) + pad], axis=1) for f, pad in ((np.min, -S.MAX_DISTANCE_M), (np.max, S.MAX_DISTANCE_M)))
    at, cost, done = fit(problem, np.stack([sx.mean(axis=1), sy.mean(axis=1)], axis=1), low, high)
    return at, cost, done & (np.hypot(at[:, :1] - sx, at[:, 1:] - sy) <= S.MAX_DISTANCE_M).all(axis=1)


def _all_fitted(sx: np.ndarray, sy: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """found, bits, point, cost and next cost of events, from fits of all branches."""
    events, n = sx.shape
    count = 1 << n
    bit = np.arange(count)[:, None] >> np.arange(n - 1, -1, -1) & 1
    spread = lambda m: np.repeat(m, count, axis=0)
    chosen = np.where(bit[None] == 1, two[:, None], one[:, None]).reshape(-1, n)
    at, cost, holds = _fits(spread(sx), spread(sy), spread(weight), chosen)
    ok = holds.reshape(events, count)
    at, cost = at.reshape(events, count, 2), np.where(ok, cost.reshape(events, count), np.inf)
    found = ok.any(axis=1)
    if n == 2:
        apart = np.hypot(*np.moveaxis(at[:, :, None] - at[:, None], 3, 0))
        found &= ~((apart > S.UNIQUENESS_TOLERANCE_M) & ok[:, :, None] & ok[:, None]).any(axis=(1, 2))
    branch = cost.argmin(axis=1)
    row = np.arange(events)
    least = cost[row, branch]
    cost[row, branch] = np.inf
    return found, bit[branch], at[row, branch], least, cost.min(axis=1)


def _searched(sx: np.ndarray, sy: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> tuple:
    """As _all_fitted(), of one event, by a search."""

    def fitted(choices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = lambda v: np.repeat(v[None], len(choices), axis=0)
        return _fits(same(sx), same(sy), same(weight), np.where(choices == 1, two, one))

    got = best_two(sx, sy, one, two, weight, fitted)
    return (True, *got) if got else (False, np.zeros(len(sx), np.int8), np.zeros(2), np.inf, np.inf)


_FIT = "solution_easting_m double, solution_northing_m double, branch_bits string, objective double, rms_residual_deg double, geometry_score double, branch_margin double, bearings array<double>"


def solve(members: DataFrame) -> DataFrame:
    """One row an event with the columns of the solutions table and the array `bearings`; failures keep only their id,
    number of sites and the two flags.

    Events are gathered as arrays of their sites first (one row a site), so solving is a narrow pass and any
    number of events shares a batch.
    """
    site = F.struct("site_id", "canonical_easting_m", "canonical_northing_m", "bearing_1_deg", "bearing_2_deg", "abs_tdoa_ms")
    events = members.groupBy("event_id").agg(
        F.count_distinct("site_id").cast("int").alias("n_sites"), F.min("event_time").alias("event_time_min"), F.max("event_time").alias("event_time_max"), F.sort_array(F.collect_list(site)).alias("sites")
    )
    # little data and much work: a fixed number of tasks, which adaptive execution does not merge by their bytes
    spark = members.sparkSession
    events = events.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "event_id")
    lead = ["event_id", "n_sites", "event_time_min", "event_time_max"]
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIT.split(", ")]
        for batch in batches:
            sites = batch.column(4)
            flat, count = sites.flatten(), np.diff(sites.offsets.to_numpy())
            first = sites.offsets.to_numpy()[:-1] - sites.offsets.to_numpy()[0]
            values = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(1, 6)]
            for n in np.unique(count).tolist():
                rows = np.flatnonzero(count == n)
                together = max(1, BRANCHES >> min(n, FITTED_WHOLE))
                for lo in range(0, len(rows), together):
                    some = rows[lo : lo + together]
                    got = locate(*(v[first[some][:, None] + np.arange(n)] for v in values))
                    none = ~got.found
                    cols = [pa.array(v, pa.float64(), mask=none) for v in (got.x, got.y)]
                    cols.append(pa.array([None if x else "".join(map(str, b)) for x, b in zip(none, got.branch.tolist())], pa.string()))
                    cols += [pa.array(v, pa.float64(), mask=none) for v in (got.objective, got.rms, got.geometry, got.margin)]
                    cols.append(pa.array([None if x else b for x, b in zip(none, got.bearings.tolist())], pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(some)) for i in range(4)), *cols], names=[*lead, *names])

    fits = events.mapInArrow(run, f"{kinds}, {_FIT}")
    fits = projection.with_lon_lat(fits, F.col("solution_easting_m"), F.col("solution_northing_m"), "solution_lon_deg", "solution_lat_deg")
    solved = F.col("branch_bits").isNotNull()
    good = scalars.quality_pass(F.col("rms_residual_deg"), F.col("geometry_score"), F.col("n_sites"), F.col("branch_margin"))
    only = lambda c: F.when(solved, c)
    return fits.select(
        "event_id",
        "n_sites",
        only(F.col("event_time_min")).alias("event_time_min"),
        only(F.col("event_time_max")).alias("event_time_max"),
        solved.alias("triangulation_success"),
        F.coalesce(good, F.lit(False)).alias("quality_pass"),
        "solution_easting_m",
        "solution_northing_m",
        "solution_lon_deg",
        "solution_lat_deg",
        "branch_bits",
        "objective",
        "rms_residual_deg",
        "geometry_score",
        "branch_margin",
        only(scalars.joined_bearings(F.col("bearings"))).alias("chosen_bearings_deg"),
        "bearings",
    )
