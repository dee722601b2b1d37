"""Connected components of an edge table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import remove, written


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and sum, which are observed meanwhile and cost no scan."""
    seen = Observation()
    table = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return table, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (columns a and b): the label is the least node of its component.

    Each round is written to the shared folder, so its lineage stays short. The rounds are of the order of the
    logarithm of the nodes; a round without a change ends the loop. A null end is no edge; loops and repeated edges
    change nothing; an empty table gives an empty one. The table is a written one (see remove()).
    """
    now, before = _written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        # large star: the neighbours above a node go to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its neighbours below go to the least of these
        below = large.where("a != b").distinct()
        low = below.groupBy("a").agg(F.min("b").alias("m"))
        small = below.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new = _written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        remove(now.sparkSession, now)
        now = after
        if new == before:
            break
        before = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
