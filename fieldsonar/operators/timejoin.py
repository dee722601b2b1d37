"""Joins by nearest time, and what is computed from their differences. Times are microseconds (long) throughout."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import MAX_PAIR_DELTA_SECONDS
from ..storage import written
from .quantiles import quantiles


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400_000_000)
    second = F.extract(F.lit("SECOND"), ts) * 1_000_000
    return day + F.hour(ts).cast("long") * F.lit(3_600_000_000) + F.minute(ts).cast("long") * F.lit(60_000_000) + second.cast("long")


def nearest(a: DataFrame, b: DataFrame, by: list[str], tolerance_s: float, t: str = "t", payload: list[str] | None = None, bucket_s: float | None = None) -> DataFrame:
    """Each row of `a` with the row of `b` nearest in time, earlier or later, no further than the tolerance (inclusive).

    Adds t_b, delta_us (b less a) and b's payload columns; rows without such a b are dropped. Of two equally near the
    earlier is taken; of equal times in b that with the least payload. Both sides meet in one sorted pass: the last b
    up to each a, and, in descending order, the first b after it. Time is cut into buckets so that one long series
    spreads over tasks; b's rows within the tolerance of a bucket's edge are also in the next bucket.
    """
    payload = payload or []
    reach = int(round(tolerance_s * 1e6))
    width = max(int((bucket_s or 0) * 1e6), 4 * reach, 1)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    pay = F.struct(F.col(t).alias("t"), *[F.col(c) for c in payload])
    right = b.groupBy(*by, t).agg(F.min(pay).alias("b"))
    right = right.select(*by, F.explode(F.array_distinct(F.array(bucket(F.col(t) - reach), bucket(F.col(t)), bucket(F.col(t) + reach)))).alias("bucket"), F.col(t).alias("at"), "b")
    row = F.struct(*[F.col(c) for c in a.columns])
    left = a.select(*by, bucket(F.col(t)).alias("bucket"), F.col(t).alias("at"), row.alias("a"))
    both = left.unionByName(right, allowMissingColumns=True)
    part = Window.partitionBy(*by, "bucket")
    to_now = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("b", ignorenulls=True).over(to_now(part.orderBy("at")))
    after = F.last("b", ignorenulls=True).over(to_now(part.orderBy(F.col("at").desc())))
    found = both.withColumns({"before": before, "after": after}).where("a is not null")
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("at"))
    pick = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    found = found.withColumn("b", pick).where(F.col("b").isNotNull() & (F.abs(F.col("b.t") - F.col("at")) <= reach))
    return found.select("a.*", F.col("b.t").alias("t_b"), (F.col("b.t") - F.col("at")).alias("delta_us"), *[F.col(f"b.{c}").alias(f"{c}_b") for c in payload])


#: Rows whose partners are looked for at once, in one pass over a bucket.
SWEPT_ROWS = 100_000


def pairs_within(rows: DataFrame, tolerance_s: float, payload: list[str] | None = None, site: str = "site_id", t: str = "t") -> DataFrame:
    """Each row with the nearest row of every greater site that has one within the tolerance (inclusive).

    The columns of rows but the site, site_a and site_b, t_b, delta_us (b less a) and the other row's payload, `<name>_b`.
    Of two equally near the earlier is taken; of equal times that with the least payload. Rows without a site or time
    have no partners.

    All pairs of sites meet in one sweep: rows are dealt once into buckets of time, and those within the tolerance of
    an edge also into the next bucket, to be found but not to look. A bucket streams in order of time; what is held is
    the stretch that is looked at and a tolerance on both sides of it, whatever the number of sites.
    """
    payload, reach = payload or [], int(round(tolerance_s * 1e6))
    width = max(4 * reach, 1)
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    columns = list(names.values())
    at, of_site, pay = columns.index(names[t]), columns.index(names[site]), [columns.index(names[c]) for c in payload]
    plain = rows.where(F.col(t).isNotNull() & F.col(site).isNotNull()).toDF(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    when = F.col(names[t])
    dealt = plain.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(when), bucket(when - reach), bucket(when + reach)))))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", names[t], *[names[c] for c in payload])
    spec = ", ".join([*(f"{c} {kinds[c]}" for c in columns), f"site_b {kinds[names[site]]}", "t_b long", *(f"p{i} {kinds[columns[i]]}" for i in pay)])

    def look(table: pa.Table, own: slice) -> Iterator[pa.RecordBatch]:
        """The partners of some rows of a table in order of time."""
        batch = table.combine_chunks().to_batches()[0]
        times, coded = batch.column(at).to_numpy(), batch.column(of_site).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        sites = coded.dictionary
        order = np.argsort(pc.array_sort_indices(sites).to_numpy())  # a site's place in the order of sites
        place = order[code]
        mine, my_times, my_place = np.arange(own.start, own.stop), times[own], place[own]
        for b in range(1, len(sites)):
            there = np.flatnonzero(place == b)
            there = there[np.append(True, np.diff(times[there]) > 0)]  # of equal times the first has the least payload
            looking = np.flatnonzero(my_place < b)
            if not len(looking):
                continue
            theirs, now = times[there], my_times[looking]
            after = np.searchsorted(theirs, now)
            before = np.where((after < len(theirs)) & (theirs[np.minimum(after, len(theirs) - 1)] == now), after, after - 1)
            far = np.iinfo(np.int64).max
            gap_before = np.where(before >= 0, now - theirs[np.maximum(before, 0)], far)
            gap_after = np.where(after < len(theirs), theirs[np.minimum(after, len(theirs) - 1)] - now, far)
            partner = there[np.where(gap_before <= gap_after, np.maximum(before, 0), np.minimum(after, len(theirs) - 1))]
            near = np.flatnonzero(np.minimum(gap_before, gap_after) <= reach)
            if len(near):
                left, right = batch.take(pa.array(mine[looking[near]])), batch.take(pa.array(partner[near]))
                cols = [*(left.column(i) for i in range(len(columns))), right.column(of_site), right.column(at), *(right.column(i) for i in pay)]
                yield pa.RecordBatch.from_arrays(cols, names=[*columns, "site_b", "t_b", *(f"p{i}" for i in pay)])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # of one bucket: rows within reach of those that are still to look
        now = None

        def step(last: bool) -> Iterator[pa.RecordBatch]:
            """Look from the rows whose partners are all here; keep what others may need."""
            nonlocal held, looked
            times = held.column(at).to_numpy()
            # later rows may still come at the last time here
            ready = len(times) if last else int(np.searchsorted(times, times[-1] - reach))
            low, high = now * width, (now + 1) * width
            begin, end = max(looked, int(np.searchsorted(times, low))), min(ready, int(np.searchsorted(times, high)))
            for lo in range(begin, end, SWEPT_ROWS):
                hi = min(end, lo + SWEPT_ROWS)
                a, b = int(np.searchsorted(times, times[lo] - reach)), int(np.searchsorted(times, times[hi - 1] + reach, side="right"))
                yield from look(held.slice(a, b - a), slice(lo - a, hi - a))
            done = max(looked, ready)
            keep = int(np.searchsorted(times, times[min(done, len(times) - 1)] - reach)) if not last else len(times)
            held, looked = held.slice(keep), done - keep

        looked = 0
        for batch in batches:
            key = batch.column(len(columns)).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if now is not None and int(key[a]) != now:
                    yield from step(True)
                    held, looked = None, 0
                now = int(key[a])
                piece = pa.Table.from_batches([batch.slice(a, b - a).select(columns)])
                held = piece if held is None else pa.concat_tables([held, piece])
                if held.num_rows - looked >= 2 * SWEPT_ROWS:
                    yield from step(False)
        if now is not None:
            yield from step(True)

    found = dealt.select(*columns, "bucket").mapInArrow(sweep, spec)
    keep = [F.col(names[c]).alias(c) for c in rows.columns if c != site]
    return found.select(*keep, F.col(names[site]).alias("site_a"), "site_b", "t_b", (F.col("t_b") - F.col(names[t])).alias("delta_us"), *[F.col(f"p{i}").alias(f"{c}_b") for i, c in zip(pay, payload)])


def pair_candidates(rows: DataFrame, max_delta_s: float = MAX_PAIR_DELTA_SECONDS, payload: list[str] | None = None, site: str = "site_id") -> DataFrame:
    """For each pair of sites, the lesser site's rows with the greater site's nearest row and the absolute seconds between."""
    return pairs_within(rows, max_delta_s, payload, site).withColumn("delta_s", F.abs("delta_us") / 1e6)


def pair_alignment(rows: DataFrame, max_delta_s: float = MAX_PAIR_DELTA_SECONDS, site: str = "site_id") -> DataFrame:
    """Pairs of sites with the number, median, greatest and least of their nearest differences; best supported first.

    No match at all gives an empty table.
    """
    got = written(pair_candidates(rows.select(site, "t"), max_delta_s, site=site).select("site_a", "site_b", F.abs("delta_us").alias("us")), "pair-deltas")
    stats = quantiles(got, ["site_a", "site_b"], "us", {"median_delta_s": 0.5, "max_delta_s": 1.0, "min_delta_s": 0.0}, 1e6).withColumnRenamed("n", "n_matches")
    return stats.orderBy(F.desc("n_matches"), "median_delta_s", "site_a", "site_b")


def pair_matrix(alignment: DataFrame, sites: list[int]) -> DataFrame:
    """Square table of matches: one row and one column a site, 0 on the diagonal and where nothing matched."""
    both = alignment.select("site_a", "site_b", "n_matches").unionByName(alignment.select(F.col("site_b").alias("site_a"), F.col("site_a").alias("site_b"), "n_matches"))
    base = alignment.sparkSession.createDataFrame([(s,) for s in sites], "site_a int")
    wide = both.groupBy("site_a").pivot("site_b", sites).agg(F.sum("n_matches"))
    return base.join(wide, "site_a", "left").na.fill(0).withColumnRenamed("site_a", "site_id")


def robust_spread(deltas: DataFrame, by: list[str], value: str = "delta_us", unit: float = 1e6) -> DataFrame:
    """Per group: n_matches, median, median absolute deviation, 10th and 90th percentile (linear interpolation), of a value in units (integers) or doubles."""
    names = {"median_delta_s_other_minus_ref": 0.5, "p10_delta_s": 0.1, "p90_delta_s": 0.9}
    deltas = written(deltas.select(*by, value), "deltas")
    median = quantiles(deltas, by, value, names, unit)
    center = median.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("median_delta_s_other_minus_ref").alias("center"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by])
    off = deltas.join(center, same).select(*by, F.abs(F.col(value) / F.lit(unit) - F.col("center")).alias("off"))
    spread = quantiles(off, by, "off", {"mad_delta_s": 0.5}).drop("n")
    return median.join(spread, by).select(*by, F.col("n").alias("n_matches"), "median_delta_s_other_minus_ref", "mad_delta_s", "p10_delta_s", "p90_delta_s")


def clock_offsets(rows: DataFrame, block: str = "time_block", max_delta_s: float = MAX_PAIR_DELTA_SECONDS) -> DataFrame:
    """Per site but the reference, what to add to its clock: the median difference to the reference site, negated.

    The reference is the site with most rows, then the least id. Only rows of one minute block are compared. A site
    without matches has no correction (0) and null spreads.
    """
    counts = rows.groupBy("site_id").agg(F.count("*").alias("n"))
    ref = counts.agg(F.min_by("site_id", F.struct((-F.col("n")).alias("n"), "site_id")).alias("reference_site_id"))
    marked = rows.select("site_id", F.col(block).alias("time_block"), "t").crossJoin(F.broadcast(ref))  # one row
    others = counts.select(F.col("site_id").alias("other_site_id")).crossJoin(F.broadcast(ref)).where("other_site_id != reference_site_id")
    # reference rows go to every other site that has rows in the block
    here = marked.where("site_id != reference_site_id").select(F.col("site_id").alias("other_site_id"), "time_block", "t")
    blocks = here.select("other_site_id", "time_block").distinct()
    base = marked.where("site_id = reference_site_id").select("time_block", "t").join(blocks, "time_block")
    stats = robust_spread(nearest(base, here, ["other_site_id", "time_block"], max_delta_s), ["other_site_id"])
    out = others.join(stats, "other_site_id", "left")
    median = F.coalesce("median_delta_s_other_minus_ref", F.lit(0.0))
    return out.select("reference_site_id", "other_site_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), median.alias("median_delta_s_other_minus_ref"), "mad_delta_s", "p10_delta_s", "p90_delta_s", (F.lit(0.0) - median).alias("applied_correction_s"))


def with_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows with clock_offset_s (0 for sites without one) and the corrected time t_corrected."""
    table = offsets.select(F.col("other_site_id").alias("site_id"), F.col("applied_correction_s").alias("clock_offset_s"))
    out = rows.join(table, "site_id", "left").withColumn("clock_offset_s", F.coalesce("clock_offset_s", F.lit(0.0)))
    return out.withColumn("t_corrected", F.col("t") + F.rint(F.col("clock_offset_s") * 1e6).cast("long"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which the summed weight reaches half of the group's."""
    summed = rows.groupBy(*by, value).agg(F.sum(weight).alias("w"))  # equal values first: less to sort
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.groupBy(*by).agg(F.sum(weight).alias("total"))
    run = summed.withColumn("upto", F.sum("w").over(order)).join(total, by)
    # sums of doubles may end a hair under half
    return run.where(F.col("upto") >= F.col("total") * 0.5 - 1e-12).groupBy(*by).agg(F.min(value).alias("weighted_median"))
