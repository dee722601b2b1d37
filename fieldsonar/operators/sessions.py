"""Anchored sessions: the first time of a group is an anchor, and so is each first time more than a width after the last anchor.

The rule looks sequential: where a session begins depends on all before. But what a stretch of sorted times does to the
last anchor before it is a map with few steps, from the incoming anchor to the outgoing one, and maps can be composed.
Rows are sorted into ranges, one task each. A task cuts its range into pieces and works out each piece's map and,
as it goes, the map of all pieces before it in the range. The maps of whole ranges of one group (one row a range) are applied one
after the other, which gives each range's incoming anchor, and from it every piece finds its own by itself. So an unbroken
stretch of any length runs in as many tasks as it has ranges: one shuffle, and one table of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import MIN_SITES_PER_EVENT
from ..storage import written

#: Rows of a piece.
PIECE_ROWS = 20_000
#: The anchor before the first time of a group: earlier than any time and width.
BEFORE = -(1 << 62)


class AnchorMap:
    """From an incoming anchor a to the outgoing one: `out[j]` for the first j with entry[j] > a + width, else a itself."""

    def __init__(self, width: int, entry: np.ndarray | None = None, out: np.ndarray | None = None, most: int | None = None) -> None:
        none = np.zeros(0, np.int64)
        self.width, self.entry, self.out = width, none if entry is None else entry, none if out is None else out
        #: An incoming anchor and the width together are at most this; later entries are never met.
        self.most = most

    @classmethod
    def of_times(cls, width: int, t: np.ndarray) -> AnchorMap:
        """The map of a stretch of sorted times, all at or after the incoming anchor."""
        step = np.searchsorted(t, t + width, side="right")
        last = np.where(step < len(t), step, np.arange(len(t)))  # the last anchor, by doubling the steps
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        entries = t[: np.searchsorted(t, t[0] + width, side="right") + 1]
        return cls(width, entries, t[last[: len(entries)]], int(t[0]) + width)._merged()

    def _merged(self) -> AnchorMap:
        """Neighbouring entries with one outcome are one step."""
        keep = np.ones(len(self.out), bool)
        keep[:-1] = self.out[1:] != self.out[:-1]
        return AnchorMap(self.width, self.entry[keep], self.out[keep], self.most)

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.entry, anchors + self.width, side="right")
        within = at < len(self.entry)
        return np.where(within, self.out[np.minimum(at, len(self.out) - 1)], anchors) if len(self.out) else anchors

    def then(self, following: AnchorMap) -> AnchorMap:
        """This map and then another: what passes here unchanged still meets the other's later entries."""
        most = following.most if self.most is None else self.most
        low = np.searchsorted(following.entry, self.entry[-1], side="right") if len(self.entry) else 0
        high = np.searchsorted(following.entry, most, side="right") + 1 if not len(self.entry) or self.entry[-1] <= most else low
        new = slice(low, max(low, high))
        return AnchorMap(self.width, np.concatenate([self.entry, following.entry[new]]), np.concatenate([following(self.out), following.out[new]]), most)._merged()


def anchors_of(t: np.ndarray, width: int, incoming: int) -> np.ndarray:
    """The anchor of each of a stretch of sorted times, given the last anchor before it."""
    step = np.searchsorted(t, t + width, side="right").tolist()
    starts, at = [], int(np.searchsorted(t, incoming + width, side="right"))
    while at < len(t):
        starts.append(at)
        at = step[at]
    out = np.full(len(t), BEFORE, np.int64)
    out[starts] = t[starts]
    return np.maximum(np.maximum.accumulate(out), incoming)


def _runs(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where stretches of equal values in all columns begin, and n."""
    ends = [pc.run_end_encode(c).run_ends.to_numpy() for c in columns]
    return np.unique(np.concatenate([[0, n], *ends])).astype(np.int64) if n else np.zeros(1, np.int64)


def pieces(rows: DataFrame, widths: tuple[int, ...], by: list[str], t: str) -> tuple[DataFrame, dict[str, str]]:
    """The sorted rows in pieces (`rows`, of structs), each with the map before it, for its first group, and the incoming anchor.

    Also the columns' names in the structs. Maps and anchors are lists by width.
    """
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    keys, columns = [names[c] for c in by], list(names.values())
    plain = rows.toDF(*columns)
    ordered = plain.repartitionByRange(*keys, names[t]).sortWithinPartitions(*keys, names[t])
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    key_spec = ", ".join(f"{k} {kinds[k]}" for k in keys)
    spec = f"range int, lead boolean, entries array<array<long>>, outs array<array<long>>, rows array<struct<{', '.join(f'{c}: {kind}' for c, kind in kinds.items())}>>"
    at, own = columns.index(names[t]), [columns.index(k) for k in keys]
    longs = pa.list_(pa.list_(pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces without keys; the range's first and last group, which other ranges may have rows of too, end with their own map and keys."""
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size, now, lead, maps, schema = 0, None, True, [AnchorMap(w) for w in widths], None

        def out(of_group: bool, lead: bool, maps: list[AnchorMap], table: pa.Table | None) -> pa.RecordBatch:
            heads = [pa.array([v if of_group else None], schema.field(i).type) for v, i in zip(now, own)]
            lists = [pa.array([[m.entry for m in maps]], longs), pa.array([[m.out for m in maps]], longs)]
            if table is None:
                body = pa.nulls(1, pa.list_(pa.struct([pa.field(c, schema.field(i).type) for i, c in enumerate(columns)])))
            else:
                structs = pa.StructArray.from_arrays([table.column(i).combine_chunks() for i in range(table.num_columns)], names=columns)
                body = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
            return pa.RecordBatch.from_arrays([*heads, pa.array([task], pa.int32()), pa.array([lead]), *lists, body], names=[*keys, "range", "lead", "entries", "outs", "rows"])

        def ended(starts: list[int], table: pa.Table) -> tuple[list[list[AnchorMap]], list[AnchorMap]]:
            """Maps of the first group of a piece and of the last one, at its end; groups begin at `starts`, the first one may have begun before."""
            times = table.column(at).to_numpy()
            edges = [*starts, len(times)]
            first = [m.then(AnchorMap.of_times(w, times[: edges[1]])) for m, w in zip(maps, widths)]
            return first, first if len(starts) == 1 else [AnchorMap.of_times(w, times[edges[-2] :]) for w in widths]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, maps, lead, now
            table = pa.Table.from_batches(held)
            starts = _runs([table.column(i).combine_chunks() for i in own], size)[:-1].tolist()
            group = tuple(table.column(i)[0].as_py() for i in own)
            if now is not None and group != now:  # the group before ended with its piece
                if lead:
                    yield out(True, True, maps, None)
                lead, maps = False, [AnchorMap(w) for w in widths]
            now = group
            yield out(False, lead, maps, table)
            first, last = ended(starts, table)
            if len(starts) > 1:
                if lead:
                    yield out(True, True, first, None)
                lead, now = False, tuple(table.column(i)[starts[-1]].as_py() for i in own)
            maps, held, size = last, [], 0

        for batch in batches:
            schema, a = batch.schema, 0
            while a < batch.num_rows:
                n = min(batch.num_rows - a, PIECE_ROWS - size)
                held.append(batch.slice(a, n))
                a, size = a + n, size + n
                if size == PIECE_ROWS:
                    yield from flush()
        if size:
            yield from flush()
        if now is not None:
            yield out(True, lead, maps, None)

    table = written(ordered.mapInArrow(cut, f"{key_spec}, {spec}" if keys else spec), "session-pieces")
    groups = table.where("rows IS NULL").select(F.lit(0).alias("one"), *keys, "range", "lead", "entries", "outs")

    def apply_in_turn(_: tuple, whole: pa.Table) -> pa.Table:
        """The incoming anchors of the ranges that a group goes on in: each range's map is applied to what the ranges before give."""
        order = np.argsort(whole.column("range").to_numpy(), kind="stable")
        now, found = [BEFORE] * len(widths), []
        for i in order.tolist():
            found.append(now)
            now = _applied(widths, whole.column("entries")[i].as_py(), whole.column("outs")[i].as_py(), now)
        taken = whole.take(pa.array(order))
        return pa.table([taken.column("range"), taken.column("lead"), pa.array(found, pa.list_(pa.int64()))], names=["of_range", "of_lead", "incoming"])

    incoming = groups.groupBy("one", *keys).applyInArrow(apply_in_turn, "of_range int, of_lead boolean, incoming array<long>")
    # a row a range
    incoming = F.broadcast(incoming.where("of_lead"))
    return table.where("rows IS NOT NULL").join(incoming, (F.col("range") == F.col("of_range")) & F.col("lead"), "left").select("entries", "outs", "rows", "incoming"), names


def _applied(widths: tuple[int, ...], entries: list, outs: list, anchors: list[int]) -> list[int]:
    return [int(AnchorMap(w, np.array(e, np.int64), np.array(o, np.int64))(np.array([a]))[0]) for w, e, o, a in zip(widths, entries, outs, anchors)]


class _Piece:
    """The rows of a piece, its groups, and their anchors at once: groups are laid on one line, too far apart to share a session."""

    def __init__(self, batch: pa.RecordBatch, i: int, own: list[int], at: int, widths: tuple[int, ...]) -> None:
        self.columns = batch.column("rows")[i].values.flatten()
        self.t = self.columns[at].to_numpy()
        self.starts = _runs([self.columns[k] for k in own], len(self.t))[:-1]
        self.group = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.t))))
        before = batch.column("incoming")[i].as_py() or [BEFORE] * len(widths)
        self.before = dict(zip(widths, _applied(widths, batch.column("entries")[i].as_py(), batch.column("outs")[i].as_py(), before)))

    def anchors(self, width: int) -> np.ndarray:
        first, last = self.t[self.starts], self.t[np.append(self.starts[1:], len(self.t)) - 1]
        room = (last - first + width + 1)[:-1]
        shift = (np.concatenate([[0], np.cumsum(room)]) + first[0] - first)[self.group]
        return anchors_of(self.t + shift, width, self.before[width]) - np.where(self.group > 0, shift, 0)


def anchored_sessions(rows: DataFrame, width_us: int, by: list[str] | None = None, t: str = "t") -> DataFrame:
    """Rows with their session's anchor time, `anchor`. Rows without a time are left out; a null group is a group."""
    by = by or []
    kept = rows.where(F.col(t).isNotNull())
    table, names = pieces(kept, (width_us,), by, t)
    columns = list(names.values())
    at, own = columns.index(names[t]), [columns.index(names[c]) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = _Piece(batch, i, own, at, (width_us,))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(piece.anchors(width_us))], names=[*columns, "anchor"])

    spec = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return table.mapInArrow(run, f"{spec}, anchor long").toDF(*rows.columns, "anchor")


def multi_site_events(rows: DataFrame, widths_us: tuple[int, ...], by: list[str], min_sites: int = MIN_SITES_PER_EVENT) -> DataFrame:
    """How many anchored sessions have so many sites: by, width_us, n_events. rows has by, site_id and t.

    All widths are worked out in one pass over the sorted rows. Sessions within a piece are counted there; only those
    that reach over a piece's edges leave it, as their sites.
    """
    kept = rows.select(*by, "site_id", "t").where(F.col("t").isNotNull())
    table, names = pieces(kept, widths_us, by, "t")
    keys, columns = [names[c] for c in by], list(names.values())
    at, of_site, own = columns.index(names["t"]), columns.index(names["site_id"]), [columns.index(k) for k in keys]
    kinds = {names[f.name]: f.dataType.simpleString() for f in kept.schema.fields}
    site_kind = kinds[names["site_id"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = _Piece(batch, i, own, at, widths_us)
                coded = piece.columns[of_site].dictionary_encode()
                sites, count = coded.indices.fill_null(-1).to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
                known, group = sites >= 0, piece.group  # a null site is none
                parts: list[list] = [[], [], [], [], []]
                for w in widths_us:
                    anchors = piece.anchors(w)
                    begins = np.ones(len(anchors), bool)
                    begins[1:] = (anchors[1:] != anchors[:-1]) | (group[1:] != group[:-1])
                    number, row = np.cumsum(begins) - 1, np.flatnonzero(begins)
                    session, site = np.divmod(np.unique((number * count + sites)[known]), count)
                    enough = np.bincount(session, minlength=len(row)) >= min_sites
                    # the first session may have begun before the piece and the last one may go on
                    edge = np.isin(np.arange(len(row)), [0, len(row) - 1])
                    inner = np.bincount(group[row], weights=enough & ~edge, minlength=len(piece.starts)).astype(np.int64)
                    some = edge[session]
                    for part, whole, reaching in zip(parts, (piece.starts, np.full(len(inner), w), None, None, inner), (row[session[some]], np.full(some.sum(), w), anchors[row][session[some]], site[some], np.zeros(some.sum(), np.int64))):
                        part += [*(whole.tolist() if whole is not None else [None] * len(inner)), *reaching.tolist()]
                at_row, width, anchor, site, n = parts
                cols = [piece.columns[k].take(pa.array(at_row, pa.int64())) for k in own]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (width, anchor)), coded.dictionary.take(pa.array(site, pa.int64())), pa.array(n, pa.int64())], names=[*keys, "width_us", "anchor", "site_id", "n"])

    spec = "".join(f"{k} {kinds[k]}, " for k in keys) + f"width_us long, anchor long, site_id {site_kind}, n long"
    parts = table.mapInArrow(run, spec)
    sessions = parts.groupBy(*keys, "width_us", "anchor").agg(F.sum("n").alias("n"), F.count_distinct("site_id").alias("n_sites"))
    whole = F.when(F.col("anchor").isNull(), F.col("n")).otherwise((F.col("n_sites") >= min_sites).cast("long"))
    return sessions.groupBy(*keys, "width_us").agg(F.sum(whole).alias("n_events")).toDF(*by, "width_us", "n_events")
