"""Events: candidates by rank within a block, their ranking and ids, and what anchored sessions tell of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import mapped_rank
from ..settings import MAX_EVENTS_PER_BLOCK, MIN_SITES_PER_EVENT
from ..storage import remove, written
from .numbering import numbered
from .sessions import anchored_sessions, multi_site_events


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their position (rank, from 0) among those of their block and site: by time, then larger delay, then row_id."""
    order = Window.partitionBy("block", "site_id").orderBy("peak_time_s", F.desc("abs_tdoa_ms"), "row_id")
    return rows.withColumn("rank", F.row_number().over(order) - 1)


def candidates(rows: DataFrame, min_sites: int = MIN_SITES_PER_EVENT) -> DataFrame:
    """Members of all candidates: block, anchor_idx, n_sites and the row's columns.

    A block's anchor is its site with most rows, then the least id. Each row of it makes one candidate with the row of
    corresponding rank of every other site. rows has block, site_id, peak_time_s, abs_tdoa_ms, t and row_id.

    A row knows from its block's counts for which candidates it is wanted: a short stretch about rank / n of the anchor's rows,
    of which those whose rank is mapped to its own count. So rows are dealt once, by block and site, and meet one row a site.
    """
    counts = rows.groupBy("block", "site_id").agg(F.count("*").cast("int").alias("n"))
    anchor = F.min_by("site_id", F.struct((-F.col("n")).alias("n"), "site_id"))
    blocks = counts.groupBy("block").agg(F.count("*").cast("int").alias("n_sites"), F.max("n").alias("anchor_count"), anchor.alias("anchor")).where(F.col("n_sites") >= min_sites)
    # no broadcast: what compresses to little in a shuffle may be much in memory; ranked rows are dealt and sorted for this join already
    placed = ranked(rows).join(counts.join(blocks, "block").hint("merge"), ["block", "site_id"])
    last, n, rank = F.col("anchor_count") - 1, F.col("n"), F.col("rank")
    step = last / (n - 1)
    low, high = F.floor((rank - 0.5) * step) - 1, F.ceil((rank + 0.5) * step) + 1
    near = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, last).cast("int"))
    own = F.when(F.col("site_id") == F.col("anchor"), F.array(rank)).when(n == 1, F.sequence(F.lit(0), last))
    own = own.otherwise(F.filter(near, lambda i: mapped_rank(i, F.col("anchor_count"), n) == rank))
    return placed.withColumn("anchor_idx", F.explode(own)).drop("rank", "n", "anchor_count", "anchor")


def best_candidates(members: DataFrame, most: int = MAX_EVENTS_PER_BLOCK, exclusive: bool = False) -> DataFrame:
    """The first candidates of each block: block, anchor_idx, candidate_id, score, first_t.

    By sites, then summed delay (to nine decimals, so that the order of adding cannot matter), then time, then anchor.
    Exclusive: a candidate with a row that a better chosen one has is passed over.
    """
    score = F.round(F.sum("abs_tdoa_ms"), 9)
    each = members.groupBy("block", "anchor_idx").agg(F.max("n_sites").alias("n_sites"), score.alias("score"), F.min("t").alias("first_t"), F.sort_array(F.collect_list("row_id")).alias("ids"))
    order = Window.partitionBy("block").orderBy(F.desc("n_sites"), F.desc("score"), "first_t", "anchor_idx")
    each = each.withColumn("place", F.row_number().over(order) - 1)
    if not exclusive:
        return each.where(F.col("place") < most).select("block", "anchor_idx", F.col("place").alias("candidate_id"), "n_sites", "score", "first_t")

    each = written(each, "candidates")
    chosen = exclusive_choice(each.select("block", "place", F.explode("ids").alias("row_id")), most)
    place = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    got = each.join(chosen, ["block", "place"]).withColumn("candidate_id", place)
    return got.where(F.col("candidate_id") < most).select("block", "anchor_idx", "candidate_id", "n_sites", "score", "first_t")


def exclusive_choice(claims: DataFrame, most: int) -> DataFrame:
    """Which claims (block, place; a row for each row_id they need) hold when each in turn, by place, is passed over if a row is taken: block, place.

    In turn is what rounds side by side give as well: a claim that is first for every row it needs holds, whatever else
    does, and then those it shares a row with fall. A block's places after its `most`-th held one are left out.
    """
    spark, claims, held = claims.sparkSession, written(claims, "claims"), None
    while True:
        first = F.min("place").over(Window.partitionBy("block", "row_id"))
        holds = F.min((F.col("first") == F.col("place")).cast("int")).over(Window.partitionBy("block", "place"))
        # a claim falls if a row of it is held by another
        marked = claims.withColumn("first", first).withColumn("holds", holds)
        falls = F.max("holds").over(Window.partitionBy("block", "row_id"))
        marked = written(marked.withColumn("falls", falls), "claims-marked")
        new = marked.where("holds = 1").select("block", "place").distinct()
        held = written(new if held is None else held.unionByName(new), "claims-held")
        last = held.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("place"))).where(F.col("n") == most).select("block", F.col("place").alias("last"))
        fallen = marked.where("falls = 1").select("block", "place").distinct()
        left = marked.select("block", "place", "row_id").join(fallen, ["block", "place"], "left_anti").join(last, "block", "left").where(F.col("last").isNull() | (F.col("place") < F.col("last"))).drop("last")
        remaining = written(left, "claims")
        remove(spark, claims, marked)
        claims = remaining
        if claims.isEmpty():
            return held


def event_ids(best: DataFrame) -> DataFrame:
    """Candidates with dense ids from 0, by block and candidate: a running sum over blocks in ranges, then its places. best is written, and worked out once."""
    best = written(best, "best-candidates")
    start = numbered(best.groupBy("block").agg(F.count("*").alias("size")), "block", "start", "size").drop("size")
    return best.join(start, "block").withColumn("event_id", (F.col("start") + F.col("candidate_id")).cast("long")).drop("start")


def build_events(rows: DataFrame, most: int = MAX_EVENTS_PER_BLOCK, min_sites: int = MIN_SITES_PER_EVENT, exclusive: bool = False, seen: Observation | None = None) -> DataFrame:
    """Event members: the columns of rows, with event_id; one row an event and site. `seen` gets how many blocks have events."""
    members = written(candidates(rows, min_sites), "candidate-members")
    best = best_candidates(members, most, exclusive)
    if seen is not None:
        best = best.observe(seen, F.count_if(F.col("candidate_id") == 0).alias("blocks_with_events"))
    ids = event_ids(best).select("block", "anchor_idx", "event_id")
    return members.join(ids, ["block", "anchor_idx"]).select(*rows.columns, "event_id")


def strongest(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row of each group: that with the largest delay, then the least row_id."""
    order = Window.partitionBy(*by).orderBy(F.desc("abs_tdoa_ms"), "row_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def window_sweep(rows: DataFrame, widths_s: tuple[float, ...], raw: str, corrected: str, min_sites: int = MIN_SITES_PER_EVENT) -> DataFrame:
    """Multi-site events for each width, by raw and by corrected times, and their difference. Rows are sorted once by each time, for all widths."""
    both = rows.select("site_id", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col(raw).alias("t")), F.struct(F.lit("corrected").alias("kind"), F.col(corrected).alias("t")))).alias("x")).select("site_id", "x.*")
    widths = {int(w * 1e6): float(w) for w in widths_s}
    counts = multi_site_events(both, tuple(widths), ["kind"], min_sites)
    wide = counts.groupBy("width_us").pivot("kind", ["raw", "corrected"]).agg(F.max("n_events"))
    seconds = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])[F.col("width_us")]
    return wide.select(seconds.alias("window_seconds"), F.col("raw").alias("multi_site_events_raw"), F.col("corrected").alias("multi_site_events_offset_corrected"), (F.col("corrected") - F.col("raw")).alias("improvement"))


def provisional_events(rows: DataFrame, width_us: int, most: int = 10) -> DataFrame:
    """The sessions with most sites: anchor, n_sites, sites, first_t, last_t; ties by anchor."""
    sessions = anchored_sessions(rows.select("site_id", "t"), width_us)
    each = sessions.groupBy("anchor").agg(F.count_distinct("site_id").alias("n_sites"), F.array_sort(F.collect_set("site_id")).alias("sites"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return each.orderBy(F.desc("n_sites"), "anchor").limit(most)
