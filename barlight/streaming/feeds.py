"""Streaming forms: latest request per window, windowed counts with late data, and a sliding match."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_totals(events: DataFrame, at: str, by: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and totals per key and tumbling or sliding window; rows later than ``late`` are dropped."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    rows = events.withWatermark(at, late).groupBy(window.alias("w"), by)
    return rows.agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "events", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by)
    return rows.agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "events")


def distinct_items(items: DataFrame, key: str, at: str, late: str = "3 days") -> DataFrame:
    """Items once per key, remembering keys as long as ``late``: state doesn't grow with the stream."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_state(log: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Per batch, the state of each key after its last row so far (update mode)."""
    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, best = state.get if state.exists else (-1, "")
        for f in frames:
            top = f.loc[f[order].idxmax()]
            if top[order] > place:
                place, best = int(top[order]), str(top[status])
        state.update((place, best))
        yield pd.DataFrame({key: [k[0]], "line_no": [place], "status": [best]})

    kind = dict(log.dtypes)[key]
    return log.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, line_no bigint, status string", "place bigint, status string", "update", GroupStateTimeout.NoTimeout)


def preceding_matches(events: DataFrame, items: DataFrame, on: str, event_at: str, item_at: str, hours: int = 72) -> DataFrame:
    """Stream-stream join of events with items of the same key at most ``hours`` before them.

    Both sides have watermarks, so buffered rows are dropped once no partner can come.
    """
    e = events.withWatermark(event_at, "1 hour")
    i = items.withWatermark(item_at, "1 hour").withColumnRenamed(on, "_on")
    near = (F.col(item_at) < F.col(event_at)) & (F.col(item_at) >= F.col(event_at) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return e.join(i, (F.col(on) == F.col("_on")) & near).drop("_on")
