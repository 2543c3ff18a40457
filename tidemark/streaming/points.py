"""Sessions and gap-closed visits of point events on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_point_sessions(events: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """(key, start, last, n) of a stream of point events, emitted once the watermark passes a session's end.

    Built-in session windows: state holds open sessions only, late events within ``lateness`` merge, later
    ones are dropped. In append mode a session comes out once.
    """
    w = events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap))
    return w.agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("session_window")


def stream_first_per_key(rows: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """The first row of each key on a stream; a repeat within ``lateness`` is dropped."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
