"""Inactivity sessions by keyed state and event-time timers.

State holds the open sessions of each entity of each recording. An ordered update opens a session, or extends
one and so resets its inactivity timeout; when the watermark passes a session's timeout the timer emits
its final start, end and number of visits. Two updates that arrive in another order, or that bridge two open
sessions, give the same result, as long as they are not later than ``allowed_lateness`` behind the newest event.

As a call into Python costs more than a session, sessions of a hash of recordings share a state; its timer is
that of the session first due. There are BUCKETS of these for each shuffle partition, so that a state is a
small part of a task's data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.storage import scratch_path
from tidemark.operators.intervals import _running_max

BUCKETS = 64
#: The closing mark's group, which no recording has.
_MARK = -(1 << 62)
_OUT = "group_id bigint, entity bigint, start_us bigint, end_us bigint, n_visits bigint"
_STATE = "recording array<bigint>, entity array<bigint>, day array<bigint>, start array<bigint>, stop array<bigint>, n array<bigint>"


def merge_sessions(sessions: np.ndarray, gap_us: int) -> np.ndarray:
    """Joins rows (recording, entity, day, start, stop, n) of one recording, entity and day whose starts are at most ``gap_us`` after the latest end so far."""
    if not len(sessions):
        return sessions.reshape(-1, 6)
    s = sessions[np.lexsort(sessions.T[3::-1])]
    other = np.r_[True, (s[1:, :3] != s[:-1, :3]).any(axis=1)]
    # the latest end so far within a day may run on over sessions, as a later session begins beyond it
    far = _running_max(s[:, 4], other)
    first = np.nonzero(other | np.r_[True, s[1:, 3] - far[:-1] > gap_us])[0]
    out = s[first].copy()
    out[:, 4] = np.maximum.reduceat(s[:, 4], first)
    out[:, 5] = np.add.reduceat(s[:, 5], first)
    return out


def _handler(gap_us: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = np.array(state.get, dtype=np.int64).T.reshape(-1, 6) if state.exists else np.zeros((0, 6), np.int64)
        if not state.hasTimedOut:
            news = [f[["group_id", "entity", "day", "start_us", "end_us"]].to_numpy(np.int64) for f in frames]
            now = merge_sessions(np.concatenate([now, *[np.c_[x, np.ones(len(x), np.int64)] for x in news]]), gap_us)
        # a timer is due once no event at or before the watermark can extend the session any more
        timeout = (now[:, 4] + gap_us) // 1000
        due = timeout < state.getCurrentWatermarkMs()
        left = now[~due]
        if len(left):
            state.update(tuple(left[:, i].tolist() for i in range(6)))
            state.setTimeoutTimestamp(max(int(timeout[~due].min()) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if due.any():
            yield pd.DataFrame(now[due][:, [0, 1, 3, 4, 5]], columns=["group_id", "entity", "start_us", "end_us", "n_visits"])

    return run


def session_timers(events: DataFrame, gap_us: int, allowed_lateness: str = "1 day") -> DataFrame:
    """Sessions of a stream of (group_id, entity, day, event_key, start_us, end_us).

    An ``event_key`` counts once. A session ends where the next start is more than ``gap_us`` after its
    latest end; a gap of just ``gap_us`` continues it. Sessions never cross a ``day``.
    """
    keyed = events.withColumn("at", F.timestamp_micros("start_us")).withWatermark("at", allowed_lateness)
    once = keyed.dropDuplicatesWithinWatermark(["event_key"])
    buckets = BUCKETS * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = once.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandasWithState(_handler(gap_us), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(spark: SparkSession, visits_path: str, gap_us: int) -> DataFrame:
    """Runs ``session_timers`` over all visits delivered so far and flushes it: (video_id, person_id, start_us, end_us, n_visits).

    A visit counts if its person, date and bounds are not null, it does not end before it starts and
    is_staff is false. A closing mark far in the future follows the visits, so that every timer fires.
    The sink's table and the stream's checkpoint lie in the shared folder; a lost executor's tasks and
    state are restored from there. Without visits the result is empty.

    All files are one micro-batch, so that no visit is late, whatever the order they were written in.
    """
    from tidemark.functions.time import epoch_us

    at = scratch_path(spark, "sessions")
    mark = spark.range(1).select(
        F.lit(_MARK).cast("bigint").alias("group_id"), F.lit(-1).cast("bigint").alias("entity"), F.lit(0).cast("bigint").alias("day"),
        F.lit("end").alias("event_key"), F.lit(7258118400000000).alias("start_us"), F.lit(7258118400000000).alias("end_us"),
    )
    mark.write.parquet(f"{at}/mark")
    schema = spark.read.parquet(visits_path).schema
    # as a glob of one match, since a stream's plain path has to be a folder
    visits = (
        spark.readStream.schema(schema)
        .parquet(f"{visits_path[:-1]}[{visits_path[-1]}]")
        .where("person_id is not null and visit_date is not null and left_at >= entered_at and not is_staff and video_id is not null")
        .select(
            F.col("video_id").cast("bigint").alias("group_id"),
            F.col("person_id").cast("bigint").alias("entity"),
            F.unix_date("visit_date").cast("bigint").alias("day"),
            F.concat(F.lit("v:"), "event_key").alias("event_key"),
            epoch_us(F.col("entered_at")).alias("start_us"),
            epoch_us(F.col("left_at")).alias("end_us"),
        )
    )
    marks = spark.readStream.schema(mark.schema).parquet(f"{at}/mark")
    stream = session_timers(visits.unionByName(marks), gap_us).where(f"group_id <> {_MARK}")
    # state on the executors' disks, so that it may outgrow their memory
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{at}/out")
        .option("checkpointLocation", f"{at}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    out = spark.read.schema(_OUT).parquet(f"{at}/out")
    return out.select(F.col("group_id").alias("video_id"), F.col("entity").alias("person_id"), "start_us", "end_us", "n_visits")
