"""Anchored sessions over a stream: the same windows as the batch operator, closed when the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import usable_tdoa


def usable_detections(stream: DataFrame, time: str = "event_time", late: str = "10 minutes") -> DataFrame:
    """The delay filter on a stream, with a watermark."""
    return stream.where(usable_tdoa(F.col("tdoa_ms"))).withWatermark(time, late)


def anchored_counts(stream: DataFrame, width_s: float, key: str, time: str = "event_time") -> DataFrame:
    """Per key, finished sessions: key, anchor, last, n_detections, n_sites.

    stream has a watermark on `time`. Rows are held until the watermark has passed the session they may belong to, so
    late rows within it count. State is the rows of open sessions; a key's rows must be spread by choosing the key.
    """
    width = pd.Timedelta(seconds=width_s)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:
            held += list(zip(f[time].astype("int64").tolist() if f[time].dtype.kind == "i" else (f[time].astype("datetime64[us]").astype("int64")).tolist(), f["site_id"].tolist()))
        held.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        wide = int(width.total_seconds() * 1e6)
        out = []
        while held and held[0][0] + wide < mark:
            anchor = held[0][0]
            mine = [h for h in held if h[0] - anchor <= wide]
            held = held[len(mine) :]
            out.append((keys[0], anchor, mine[-1][0], len(mine), len({s for _, s in mine})))
        if held:
            state.update(([h[0] for h in held], [int(h[1]) for h in held]))
            state.setTimeoutTimestamp(max((held[0][0] + wide) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            cols = list(zip(*out))
            yield pd.DataFrame({key: cols[0], "anchor": pd.to_datetime(cols[1], unit="us"), "last": pd.to_datetime(cols[2], unit="us"), "n_detections": cols[3], "n_sites": cols[4]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "site_id", time).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, anchor timestamp, last timestamp, n_detections long, n_sites long", "times array<long>, sites array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )
