"""Queries: stored records, links and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us
from tidemark.operators import matching as M
from tidemark.operators import records as R
from tidemark.operators import sessions as S
from tidemark.plans.matching import TILL_CTE, till_matches
from tidemark.sources.files import video_metadata
from tidemark.sources.tables import read_table


def staff_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's upper half stored first under placeholder names, then the whole registry brought in."""
    clean = R.clean_staff(read_table(spark, sf_dir, "staff_registry"))
    old = clean.where("staff_key >= 'cashier_0200'").withColumn("full_name", F.lit("placeholder"))
    extra = spark.range(1).select(F.lit("cashier_9999").alias("staff_key"), F.lit("stored only").alias("full_name"), F.lit(None).cast("string").alias("position"))
    return R.upsert(old.unionByName(extra), clean, "staff_key")


def video_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_metadata(read_table(spark, sf_dir, "videos").select("video_id", "fps", "frame_count")).select("video_id", "duration_us")


def anchor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame of each of six start offsets in every recording that has one."""
    v = read_table(spark, sf_dir, "videos").select("video_id", "fps", "frame_count", F.explode(F.array(*[F.lit(float(x)) for x in (0, 2, 5, 10, 20, 30)])).alias("offset_s"))
    return v.select("video_id", "offset_s", R.anchor_frame(F.col("offset_s"), F.col("fps"), F.col("frame_count")).alias("frame")).where("frame is not null")


def manual_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times typed by hand: right ones, some with another weekday, some with a missing part."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(epoch_us(F.col("ts"))).alias("ts"))
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MM-dd-yyyy EEE HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "MM-dd-yyyy "), F.date_format(F.col("ts") + F.expr("interval 1 day"), "EEE"), F.date_format("ts", " HH:mm:ss"))).otherwise(F.date_format("ts", "MM-dd-yyyy EEE HH:mm"))
    return e.select("event_id", R.manual_start_us(text).alias("start_us"))


def anchor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    start, source = R.resolve_anchor(F.when(i % 5 != 0, i * 1000), i % 4, 2, F.when(i % 3 == 0, i * 7), i % 7 != 0)
    return read_table(spark, sf_dir, "events").select("event_id", start.alias("start_us"), source.alias("source"))


def _counted_and_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    visits = read_table(spark, sf_dir, "visits")
    return S.first_per_event(visits).where("not coalesce(is_staff, false)"), S.merge_visits(visits, 90_000_000, keys=True)


def visit_session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted visit, linked to its merged session."""
    return R.link_visits(*_counted_and_sessions(spark, sf_dir))


def visit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of guests without a known person, linked to their sessions among all merged sessions."""
    visits, sessions = _counted_and_sessions(spark, sf_dir)
    return R.link_visits(visits.where("person_id is null"), sessions)


def visit_link_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of linked visits that are not loaded, and of counted visits without a session."""
    return R.link_violations(*_counted_and_sessions(spark, sf_dir))


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches left once every tenth session is deleted."""
    kept = read_table(spark, sf_dir, "visit_sessions").where("id % 10 <> 0").select(F.col("id").alias("visit_session_id"))
    return R.delete_cascade(till_matches(spark, sf_dir).select("visit_session_id", "receipt_id"), kept, "visit_session_id")


def visit_unlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits' recordings, nulled where the recording is deleted."""
    videos = read_table(spark, sf_dir, "videos").where("video_id % 10 <> 0").select("video_id")
    visits = read_table(spark, sf_dir, "visits").dropDuplicates(["id"]).select("id", "video_id")
    return R.delete_cascade(visits, videos, "video_id", "set_null")


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored receipts against a later delivery in which some changed, some are new and some gone: one row of counts."""
    r = read_table(spark, sf_dir, "receipts").dropDuplicates(["id"]).select("id", "amount")
    new = r.where("id % 11 <> 0").select(F.when(F.col("id") % 13 == 0, -F.col("id")).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"))
    return R.status_counts(M.sync_diff(r, new, "id", ["amount"]))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    old = F.create_map(F.lit("a"), i.cast("string"), F.lit("b"), F.lit("old"))
    new = F.when(i % 3 != 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), (i % 5).cast("string")))
    m = R.merge_json(old, new)
    return read_table(spark, sf_dir, "events").select("event_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in "abc"])


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts per day of the project's zone, three hours ahead of UTC all year."""
    r = read_table(spark, sf_dir, "receipts").dropDuplicates(["id"]).where("closed_at is not null")
    day = F.floor(R.local_time(epoch_us(F.col("closed_at")), "Europe/Moscow") / 86_400_000_000)
    return r.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        staff_upsert, video_durations, anchor_frames, manual_starts, anchor_resolution, visit_links, visit_session_links, visit_link_assertions, match_cascade, visit_unlink, sync_counts, metadata_merge, local_days,
    )
}
_STAFF = r"""
WITH t AS (SELECT CAST(trim(id_staff) AS INT) AS i, nullif(trim(regexp_replace(first_name, '\s+', ' ', 'g')), '') AS a, nullif(trim(regexp_replace(last_name, '\s+', ' ', 'g')), '') AS b,
  lower(nullif(trim(regexp_replace(job_position, '\s+', ' ', 'g')), '')) AS position FROM staff_registry WHERE regexp_full_match(trim(id_staff), '[0-9]{1,9}')),
c AS (SELECT 'cashier_' || CASE WHEN i > 9999 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 4, '0') END AS staff_key, nullif(concat_ws(' ', a, b), '') AS full_name, position FROM t WHERE i > 0)
SELECT * FROM c UNION ALL SELECT 'cashier_9999', 'stored only', NULL
"""
ORACLE = {
    "staff_upsert": _STAFF,
    "video_durations": "SELECT video_id, CASE WHEN fps > 0 AND frame_count > 0 THEN CAST(round_even(frame_count / fps * 1e6::DOUBLE, 0) AS BIGINT) END AS duration_us FROM videos",
    "anchor_frames": "SELECT * FROM (SELECT video_id, o AS offset_s, CASE WHEN fps > 0 AND CAST(round_even(o * fps, 0) AS BIGINT) < frame_count THEN CAST(round_even(o * fps, 0) AS BIGINT) END AS frame FROM videos, (SELECT unnest([0, 2, 5, 10, 20, 30])::DOUBLE AS o)) WHERE frame IS NOT NULL",
    "manual_starts": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(date_trunc('second', ts)) END AS start_us FROM events",
    "anchor_resolution": """
SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 4 >= 2 AND event_id % 5 <> 0 THEN event_id * 1000 WHEN event_id % 3 = 0 THEN event_id * 7 END AS start_us,
  CASE WHEN event_id % 7 <> 0 AND event_id % 4 >= 2 AND event_id % 5 <> 0 THEN 'ocr' WHEN event_id % 3 = 0 THEN 'manual' ELSE 'manual_required' END AS source FROM events""",
    "visit_links": "SELECT event_key, 'session_' || sha256(event_key) AS session_key FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY id) AS k FROM visits) WHERE k = 1 AND person_id IS NULL AND NOT coalesce(is_staff, false)",
    "visit_unlink": "SELECT DISTINCT id, CASE WHEN video_id % 10 <> 0 AND video_id IN (SELECT video_id FROM videos) THEN video_id END AS video_id FROM visits",
    "sync_counts": """
WITH r AS (SELECT DISTINCT ON (id) id, amount FROM receipts ORDER BY id),
n AS (SELECT CASE WHEN id % 13 = 0 THEN -id ELSE id END AS id, CASE WHEN id % 7 = 0 THEN amount + 1 ELSE amount END AS amount FROM r WHERE id % 11 <> 0)
SELECT count(*) FILTER (r.id IS NULL) AS "create", count(*) FILTER (r.id IS NOT NULL AND n.id IS NOT NULL AND r.amount IS DISTINCT FROM n.amount) AS "update",
  count(*) FILTER (r.id IS NOT NULL AND n.id IS NOT NULL AND r.amount IS NOT DISTINCT FROM n.amount) AS unchanged, count(*) FILTER (n.id IS NULL) AS "delete" FROM r FULL JOIN n ON r.id = n.id""",
    "metadata_merge": "SELECT event_id, CAST(event_id AS VARCHAR) AS a, CASE WHEN event_id % 3 <> 0 THEN 'new' ELSE 'old' END AS b, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 5 AS VARCHAR) END AS c FROM events",
    "local_days": "SELECT (epoch_us(closed_at) + 10800000000) // 86400000000 AS day, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM receipts ORDER BY id) WHERE closed_at IS NOT NULL GROUP BY 1",
    "match_cascade": TILL_CTE + "SELECT visit_session_id, receipt_id FROM n WHERE visit_session_id % 10 <> 0",
}
