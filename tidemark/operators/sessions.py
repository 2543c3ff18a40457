"""Visits from observations, and sessions from visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us


def close_by_gap(frames: DataFrame, observed: DataFrame, frame_key: str, track_key: str, seq: str, ts_us: str, max_missing_us: int) -> DataFrame:
    """(frame_key, track_key, visit_no, first_us, last_us, n): a track's visits in a stream of frames.

    A frame first updates the tracks it shows and then closes those unseen for more than the limit; so a
    track that comes back starts a new visit iff the frame before had already closed it.
    """
    w = Window.partitionBy(frame_key).orderBy(seq)
    before = frames.select(frame_key, seq, F.lag(ts_us).over(w).alias("_before"))
    t = Window.partitionBy(frame_key, track_key).orderBy(seq)
    rows = observed.join(before, [frame_key, seq]).withColumn("_last", F.lag(ts_us).over(t))
    new = F.col("_last").isNull() | (F.col("_before") - F.col("_last") > max_missing_us)
    rows = rows.withColumn("visit_no", F.sum(new.cast("bigint")).over(t))
    return rows.groupBy(frame_key, track_key, "visit_no").agg(F.min(ts_us).alias("first_us"), F.max(ts_us).alias("last_us"), F.count("*").alias("n"))


def first_per_event(visits: DataFrame) -> DataFrame:
    """One row per ``event_key``, that of the smallest id; repeated rows collapse."""
    w = Window.partitionBy("event_key").orderBy("id")
    return visits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_visits(visits: DataFrame, gap_us: int, keys: bool = False) -> DataFrame:
    """Sessions of visits: a row per session with bounds, frames, count, estimate flag, duration and key; with ``keys`` also its ``event_keys``.

    Staff visits do not count. Visits without person are sessions of their own. Others go by recording
    and person in the order of entry frame (nulls last) and id; the next visit continues a session if it has
    the session's date, both are known, and it begins at most ``gap_us`` after the latest end in the
    session. As that end restarts with each session, and the frames' order need not be that of time, this
    is a fold; it runs in the JVM over the visits of one person in one recording, which the recording bounds.
    """
    v = first_per_event(visits).where(~F.coalesce("is_staff", F.lit(False)))
    v = v.withColumn("_in", epoch_us(F.col("entered_at"))).withColumn("_out", epoch_us(F.col("left_at")))
    v = v.withColumn("_date", F.coalesce("visit_date", F.to_date("entered_at")))
    known = v.where("person_id is not null")
    item = F.struct(
        F.col("entry_frame_index").isNull().alias("z"), F.col("entry_frame_index").alias("f"), F.col("id").cast("bigint").alias("id"), F.col("_date").alias("d"), F.col("_in").alias("a"), F.col("_out").alias("b")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("no"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("bigint").alias("far"), F.array().cast("array<struct<id:bigint,no:bigint>>").alias("out"))

    def step(s, x):
        same = F.coalesce((x.d == s.d) & (x.a - s.far <= gap_us), F.lit(False))
        no = F.when(same, s.no).otherwise(s.no + 1)
        far = F.when(same, F.greatest(s.far, x.b)).otherwise(x.b)
        return F.struct(no.alias("no"), x.d.alias("d"), far.alias("far"), F.concat(s.out, F.array(F.struct(x.id.alias("id"), no.alias("no")))).alias("out"))

    folded = known.groupBy("video_id", "person_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda s: s.out).alias("out"))
    numbers = folded.select(F.explode("out").alias("x")).select(F.col("x.id").alias("id"), F.col("x.no").alias("_no"))
    numbered = known.join(numbers, "id").unionByName(v.where("person_id is null").withColumn("_no", -F.col("id").cast("bigint")))
    out = numbered.groupBy("video_id", "person_id", "_no").agg(
        F.min("_date").alias("visit_date"),
        F.min("entered_at").alias("entered_at"),
        F.max("left_at").alias("left_at"),
        F.min("entry_frame_index").alias("entry_frame_index"),
        F.max("exit_frame_index").alias("exit_frame_index"),
        F.count("*").alias("segments_count"),
        F.bool_or("time_is_estimated").alias("time_is_estimated"),
        F.array_sort(F.collect_list("event_key")).alias("_keys"),
        (F.max("_out") - F.min("_in")).alias("_us"),
    )
    key = F.concat(F.lit("session_"), F.sha2(F.array_join("_keys", "|"), 256))
    out = out.withColumn("session_key", key).withColumn("duration_us", F.when(F.col("_us") >= 0, F.col("_us"))).drop("_us", "_no")
    return out.withColumnRenamed("_keys", "event_keys") if keys else out.drop("_keys")


def point_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, last, n) of point events; a gap of just ``gap`` continues a session."""
    return events.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("session_window")


def even_sample(rows: DataFrame, key: str, order: str, value: str, size: int = 20) -> DataFrame:
    """(key, pos, value): at most ``size`` of each key's rows, evenly spaced from first to last, half-even rounded."""
    w = Window.partitionBy(key)
    r = rows.select(key, order, value, (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(float(size - 1))).cast("int"))
    at = F.when(F.col("_n") <= size, F.col("_i")).otherwise(F.array_position(spread, F.col("_i")) - 1)
    return r.withColumn("pos", at.cast("bigint")).where("pos >= 0").select(key, "pos", value)
