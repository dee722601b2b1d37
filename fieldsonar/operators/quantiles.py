"""Exact quantiles of groups of any size, by distributed selection.

Values become longs that sort as they do. Rows are counted by group and the upper bits of that long, in tasks first; the
counts say in which bin a wanted rank lies and how many rows lie below it. Only rows of such bins are counted again, by
the next bits, until a bin is one value; once no such bin has more than BINS rows all other bits are looked at
together. What is shuffled and held is at most BINS counts of a group, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..storage import remove, written

#: Counts of a group that a round may make, a power of two: that many bits are looked at in a round.
BINS = 1 << 18
_REST = np.int64((1 << 63) - 1)


def _turned(bits: np.ndarray) -> np.ndarray:
    """A double's bits as a long in the order of doubles, and back."""
    return np.where(bits < 0, bits ^ _REST, bits)


@F.pandas_udf(LongType())
def ordered_bits(value: pd.Series) -> pd.Series:
    return pd.Series(_turned((value.to_numpy(np.float64) + 0.0).view(np.int64)))


@F.pandas_udf(DoubleType())
def from_ordered_bits(bits: pd.Series) -> pd.Series:
    return pd.Series(_turned(bits.to_numpy(np.int64)).view(np.float64))


def _same(by: list[str], suffix: str) -> Column:
    out = F.lit(True)
    for c in by:
        out &= F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))
    return out


def _between(x: Column, at: Callable[[Column], Column]) -> Column:
    """The value at a place between two ranks, of which at() gives the values."""
    below, above = F.floor(x).cast("long"), F.ceil(x).cast("long")
    a, b = at(below), at(above)
    return F.when((below == above) | (a == b), a).otherwise((above - x) * a + (x - below) * b)


def _of_counts(table: DataFrame, by: list[str], shares: dict[str, float], real: bool, unit: float) -> DataFrame:
    """Quantiles of a written table of few values, from one round of counts; the table is deleted."""
    counts = table.groupBy(*by, "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = from_ordered_bits(F.col("v")) if real else F.col("v") / F.lit(unit)
    counts = counts.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy(*by))}).withColumn("x", value)
    ranks = [f(F.lit(float(p)) * (F.col("n") - 1)).cast("long") for p in shares.values() for f in (F.floor, F.ceil)]
    here = [F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("c")), F.col("x"))).alias(f"_x{i}") for i, r in enumerate(ranks)]
    got = counts.groupBy(*by).agg(F.max("n").alias("n"), *here)
    ends = {name: iter((F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"))) for i, name in enumerate(shares)}
    made = [_between(F.lit(float(p)) * (F.col("n") - 1), lambda _, name=name: next(ends[name])).alias(name) for name, p in shares.items()]
    result = written(got.select(*by, "n", *made), "quantiles")
    remove(table.sparkSession, table)
    return result


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], unit: float = 1.0) -> DataFrame:
    """Per group: `n` values that are neither null nor NaN, and for each name its share's quantile, with linear interpolation.

    The values are doubles, or integers, which count in `unit`s. Groups without a value are left out; a null group is a
    group.
    """
    kind = rows.schema[value].dataType.simpleString()
    real = kind in ("double", "float")
    v = F.col(value)
    kept = rows.where(v.isNotNull() & ~F.isnan(v)) if real else rows.where(v.isNotNull())
    seen = Observation()
    count = F.count(F.lit(1))
    table = kept.select(*by, (ordered_bits(v) if real else v.cast("long")).alias("v"))
    table = written(table.observe(seen, count.alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "values")
    if seen.get["n"] <= BINS:  # no group has more rows: the first round looks at all bits
        return _of_counts(table, by, shares, real, unit)
    groups = written(table.groupBy(*by).agg(F.count("*").alias("n")), "value-groups")
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]))
    targets = groups.select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("outer"), F.lit(0).cast("long").alias("below"))
    made: list[DataFrame] = []
    low, high, most = seen.get["low"], seen.get["high"], groups.agg(F.max("n")).first()[0]
    # signed shifts keep the order, so bits above those in which any two values differ say nothing
    shift = (low ^ high).bit_length() if (low < 0) == (high < 0) else max(low.bit_length(), high.bit_length())
    outer = F.lit(0).cast("long")
    while True:
        before, shift = shift, 0 if most <= BINS else max(0, shift - BINS.bit_length() + 1)
        source = table
        if made:
            bins = targets.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("outer").alias("outer_of")).distinct()
            source = table.join(bins, _same(by, "_of") & (F.shiftright("v", before) == F.col("outer_of")), "left_semi")
            outer = F.shiftright("v", before)
        counts = source.groupBy(*by, outer.alias("outer"), F.shiftright("v", shift).alias("bin")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*by, "outer").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("upto", upto).select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("outer").alias("outer_of"), "bin", "c", "upto")
        inside = F.col("rank") - F.col("below")
        here = _same(by, "_of") & (F.col("outer") == F.col("outer_of")) & (inside < F.col("upto")) & (inside >= F.col("upto") - F.col("c"))
        found = targets.select(*by, "rank", "outer", "below").join(counts, here).select(*by, "rank", F.col("bin").alias("outer"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "c")
        targets = written(found, "ranks")
        made.append(targets)
        if shift == 0:
            break
        most = targets.agg(F.max("c")).first()[0]
    exact = from_ordered_bits(F.col("outer")) if real else F.col("outer") / F.lit(unit)
    by_rank = targets.select(*[F.col(c).alias(f"{c}_of") for c in by], "rank", exact.alias("x")).groupBy(*[f"{c}_of" for c in by]).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    out = groups.join(by_rank, _same(by, "_of"))
    at = lambda rank: F.col("at")[rank]
    result = written(out.select(*by, "n", *[_between(x, at).alias(name) for name, x in place.items()]), "quantiles")
    remove(rows.sparkSession, table, groups, *made)
    return result
