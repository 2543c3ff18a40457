"""A recording's clock from several readings: consensus, calibration and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consensus(readings: DataFrame, key: str, start_us: str, offset: str, tolerance_us: int, min_consistent: int) -> DataFrame:
    """(key, n_consistent, spread_us, start_us, offset): per key the largest set of readings whose implied starts lie within the tolerance.

    Sets of one size go by smaller spread, then smaller first offset, then earlier start. The set's reading nearest to its median
    stands for it, of equally near ones that of the smaller offset. Keys without a set of ``min_consistent`` have nulls.
    """
    w = Window.partitionBy(key).orderBy(start_us).rangeBetween(-tolerance_us, 0)
    sets = readings.where(F.col(start_us).isNotNull()).select(
        key, F.col(start_us).alias("_end"), F.count("*").over(w).alias("_n"), (F.col(start_us) - F.min(start_us).over(w)).alias("_spread"), F.min(offset).over(w).alias("_first")
    )
    best = sets.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_spread", "_first", "_end")).alias("_b"))
    best = best.select(F.col(key).alias("_key"), (-F.col("_b.n")).alias("n_consistent"), F.col("_b._spread").alias("spread_us"), F.col("_b._end").alias("_end"))
    members = readings.join(best, F.col(key) == F.col("_key")).where(F.col(start_us).between(F.col("_end") - F.col("spread_us"), F.col("_end")))
    middle = members.groupBy(key, "n_consistent", "spread_us").agg(F.median(start_us).alias("_m"), F.collect_list(F.struct(start_us, offset)).alias("_r"))
    near = F.array_min(F.transform("_r", lambda r: F.struct(F.abs(r[start_us] - F.col("_m")).alias("d"), r[offset].alias("o"), r[start_us].alias("s"))))
    ok = F.col("n_consistent") >= min_consistent
    return middle.withColumn("_c", near).select(key, "n_consistent", "spread_us", F.when(ok, F.col("_c.s")).alias("start_us"), F.when(ok, F.col("_c.o")).alias("offset"))


def calibrated_us(ts_us: Column, ref_ts_us: Column, ref_clock_us: Column, end_ts_us: Column, end_clock_us: Column) -> Column:
    """Clock time of media time: linear between two anchors, at scale one without the second."""
    scale = F.when((end_ts_us > ref_ts_us) & (end_clock_us > ref_clock_us), (end_clock_us - ref_clock_us) / (end_ts_us - ref_ts_us)).otherwise(F.lit(1.0))
    return ref_clock_us + F.rint((ts_us - ref_ts_us) * scale).cast("bigint")


def end_status(difference_us: Column, valid_us: int, calibrated_us_: int) -> Column:
    """valid, calibrated or mismatch by the size of the end's difference; unavailable without one."""
    d = F.abs(difference_us)
    return F.when(d.isNull(), "unavailable").when(d <= valid_us, "valid").when(d <= calibrated_us_, "calibrated").otherwise("mismatch")


def anchor_start_us(ref_clock_us: Column, ref_ts_us: Column) -> Column:
    """When a recording started, by an anchor: its clock time less its media time; null for a negative media time."""
    return F.when(ref_ts_us >= 0, ref_clock_us - ref_ts_us)


def anchor_end_us(ref_clock_us: Column, ref_ts_us: Column, duration_us: Column) -> Column:
    """When a recording of this length ended, by an anchor; null for a negative length."""
    return F.when(duration_us >= 0, anchor_start_us(ref_clock_us, ref_ts_us) + duration_us)


def enrich_visits(visits: DataFrame, entry_us: str, exit_us: str, ref_ts_us: str, ref_clock_us: str, estimated: str, end_ts_us: Column | None = None, end_clock_us: Column | None = None) -> DataFrame:
    """Visits on the camera's clock: adds ``entered_us``, ``left_us``, ``duration_us``, ``visit_day`` (days since 1970) and ``time_is_estimated``.

    Entry and exit are media times, mapped by one anchor or two. A visit without either, or that ends before it begins, or a
    recording without anchor, has nulls.
    """
    none = F.lit(None).cast("bigint")
    at = lambda c: calibrated_us(F.col(c), F.col(ref_ts_us), F.col(ref_clock_us), none if end_ts_us is None else end_ts_us, none if end_clock_us is None else end_clock_us)
    ok = (F.col(entry_us) >= 0) & (F.col(exit_us) >= F.col(entry_us)) & F.col(ref_clock_us).isNotNull()
    entered, left = F.when(ok, at(entry_us)), F.when(ok, at(exit_us))
    out = visits.withColumn("entered_us", entered).withColumn("left_us", left)
    out = out.withColumn("duration_us", F.col("left_us") - F.col("entered_us")).withColumn("visit_day", F.floor(F.col("entered_us") / 86_400_000_000))
    return out.withColumn("time_is_estimated", F.coalesce(F.col(estimated), F.lit(False)))


def attempt_json(attempt: DataFrame, requested_s: str, frame: str, ts_s: str, raw_text: str, clock_us: str) -> DataFrame:
    """Adds ``attempt``: one reading of the clock as JSON, nulls kept; it succeeded if it was read as a time."""
    iso = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss")
    start = F.col(clock_us) - F.rint(F.col(ts_s) * 1e6).cast("bigint")
    body = F.struct(
        F.col(requested_s).alias("requested_offset_seconds"), F.col(frame).alias("frame_index"), F.col(ts_s).alias("timestamp_seconds"), F.col(raw_text).alias("raw_text"),
        iso(F.col(clock_us)).alias("parsed_datetime"), iso(start).alias("recorded_start_at"), F.col(clock_us).isNotNull().alias("succeeded"),
    )
    return attempt.withColumn("attempt", F.to_json(body, {"ignoreNullFields": "false"}))


def usable_end(status: Column) -> Column:
    """Whether an end's status lets its anchor be used: valid or calibrated."""
    return F.coalesce(status.isin("valid", "calibrated"), F.lit(False))
