"""Queries: the report views over whole tables, with receipts matched by till and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reports as R
from tidemark.plans.matching import TILL_CTE, till_matches
from tidemark.sources.tables import read_table


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "visit_sessions")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "receipts")


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "faces").drop("embedding").dropDuplicates(["id"])


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with the day they started, where the text begins with a date in ISO form."""
    day = F.when(F.col("recorded_start_at").rlike(r"\A\d{4}-\d{2}-\d{2}[T ]"), F.try_to_date(F.substring("recorded_start_at", 1, 10)))
    return read_table(spark, sf_dir, "videos").select("video_id", "filename", day.alias("start_day"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.session_links(_sessions(spark, sf_dir), read_table(spark, sf_dir, "visits"))


def _metrics(spark: SparkSession, sf_dir: str, per_day: bool) -> DataFrame:
    profiles = R.person_profiles(_faces(spark, sf_dir))
    out = R.metrics(_sessions(spark, sf_dir), till_matches(spark, sf_dir), _receipts(spark, sf_dir), profiles, _videos(spark, sf_dir), per_day)
    return _money(out, "revenue", "matched_revenue")


def _money(df: DataFrame, *names: str) -> DataFrame:
    """Amounts as doubles at the very end, after exact decimal sums."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


_DAILY = (
    "day", "visits", "timed", "estimated", "missing_time", "identified", "unique_persons", "male", "female", "unknown_gender", "average_age", "unknown_age", "receipts", "matched_receipts", "coverage",
    "revenue", "matched_revenue", "ambiguous_matches",
)
_PEOPLE = ("unique_persons", "male", "female", "unknown_gender", "average_age", "unknown_age", "visits", "identified", "receipts", "matched_receipts", "coverage", "revenue", "matched_revenue")
_QUALITY = ("day", "visits", "timed", "estimated", "missing_time", "identified", "ambiguous_matches", "receipts", "matched_receipts", "coverage")


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, True).select(*_DAILY)


def total_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general summary; runs are those that delivered visits."""
    runs = read_table(spark, sf_dir, "visits").agg(F.count_distinct("processing_run_id").alias("finished_runs"))
    return _metrics(spark, sf_dir, False).crossJoin(runs)


def people_summary_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's persons and receipts, and the total's, which are computed anew."""
    days = _metrics(spark, sf_dir, True).select(F.col("day").cast("string").alias("day"), *_PEOPLE)
    return days.unionByName(_metrics(spark, sf_dir, False).select(F.lit("total").alias("day"), *_PEOPLE))


def receipt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(R.receipt_summary(_receipts(spark, sf_dir), till_matches(spark, sf_dir), _sessions(spark, sf_dir), _links(spark, sf_dir)), "amount")


def visit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.session_summary(_sessions(spark, sf_dir), till_matches(spark, sf_dir), _receipts(spark, sf_dir), _videos(spark, sf_dir), _links(spark, sf_dir), _faces(spark, sf_dir))
    return _money(out, "amount")


def person_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = R.person_profiles(_faces(spark, sf_dir))
    persons = read_table(spark, sf_dir, "persons").drop("face_embedding")
    return _money(R.person_registry(persons, _sessions(spark, sf_dir), till_matches(spark, sf_dir), _receipts(spark, sf_dir), profiles, _videos(spark, sf_dir)), "amount")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _metrics(spark, sf_dir, True).select(*_QUALITY)
    cover = R.face_coverage(_sessions(spark, sf_dir), _videos(spark, sf_dir), _links(spark, sf_dir), _faces(spark, sf_dir))
    return day.join(cover, "day", "left").select(*_QUALITY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("with_face", "with_eligible_face")])


def report_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face shown for each visit."""
    return R.report_face(_faces(spark, sf_dir), "visit_id")


QUERIES = {f.__name__: f for f in (daily_metrics, total_metrics, people_summary_with_total, receipt_summary, visit_summary, person_registry, quality_report, report_faces)}

# n (TILL_CTE) are the matches; each part below is written from the meaning of the views, not from the operators
_BASE = (
    TILL_CTE
    + """, face AS (SELECT DISTINCT ON (id) * FROM faces ORDER BY id),
ranked AS (SELECT *, coalesce(is_best, false) AS rb, coalesce(is_identity_reference, false) AS rr, coalesce(CASE WHEN isnan(identity_quality_score) THEN 0 ELSE identity_quality_score END, 0) AS ri,
  coalesce(CASE WHEN isnan(quality_score) THEN 0 ELSE quality_score END, 0) AS rq FROM face),
pool AS (SELECT f.* FROM ranked f WHERE person_id IS NOT NULL AND CASE
  WHEN EXISTS (SELECT 1 FROM face x WHERE x.person_id = f.person_id AND x.is_identity_reference) THEN coalesce(f.is_identity_reference, false)
  WHEN EXISTS (SELECT 1 FROM face x WHERE x.person_id = f.person_id AND x.is_identity_eligible) THEN coalesce(f.is_identity_eligible, false) ELSE true END),
votes AS (SELECT person_id, gender, count(*) AS c, round(sum(ri), 6) AS w FROM pool WHERE gender IN ('m', 'f') GROUP BY 1, 2),
elected AS (SELECT person_id, gender FROM votes QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY c DESC, w DESC, gender) = 1),
prof AS (SELECT p.person_id, max(e.gender) AS gender, round(median(p.age_estimate), 4) AS age FROM pool p LEFT JOIN elected e ON e.person_id = p.person_id GROUP BY 1),
vday AS (SELECT video_id, CASE WHEN regexp_matches(recorded_start_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]') THEN TRY_CAST(substr(recorded_start_at, 1, 10) AS DATE) END AS start_day, filename FROM videos),
sess AS (SELECT v.*, coalesce(v.visit_date, (SELECT min(x.visit_date) FROM visit_sessions x WHERE x.video_id = v.video_id), (SELECT min(start_day) FROM vday d WHERE d.video_id = v.video_id)) AS day FROM visit_sessions v),
rec AS (SELECT DISTINCT ON (id) *, CAST(closed_at AS DATE) AS day FROM receipts ORDER BY id),
link AS (SELECT v.id AS visit_id, min(s.id) AS session_id, any_value(v.track_id) AS track_id, any_value(v.time_is_estimated) AS est
  FROM (SELECT DISTINCT ON (id) * FROM visits ORDER BY id) v JOIN visit_sessions s ON s.video_id = v.video_id AND s.person_id = v.person_id AND v.entered_at >= s.entered_at AND v.entered_at <= s.left_at GROUP BY 1),
made AS (SELECT s.id, CASE WHEN s.entered_at IS NULL OR s.left_at IS NULL THEN 'none' WHEN bool_or(coalesce(l.est, false)) THEN 'manual' ELSE 'clock' END AS dating,
  coalesce(string_agg(CAST(l.visit_id AS VARCHAR), ', ' ORDER BY l.visit_id), '') AS visit_ids, coalesce(string_agg(CAST(l.track_id AS VARCHAR), ', ' ORDER BY l.visit_id), '') AS track_ids
  FROM sess s LEFT JOIN link l ON l.session_id = s.id GROUP BY s.id, s.entered_at, s.left_at),
sface AS (SELECT l.session_id, f.* FROM link l JOIN ranked f ON f.visit_id = l.visit_id QUALIFY row_number() OVER (PARTITION BY l.session_id ORDER BY rb DESC, rr DESC, ri DESC, rq DESC, f.id) = 1)
"""
)

_PER_DAY = """, days AS (SELECT day FROM sess WHERE day IS NOT NULL UNION SELECT day FROM rec WHERE day IS NOT NULL),
sday AS (SELECT day, count(*) AS visits, count(*) FILTER (entered_at IS NOT NULL AND left_at IS NOT NULL) AS timed, count(*) FILTER (entered_at IS NOT NULL AND left_at IS NOT NULL AND time_is_estimated) AS estimated,
  count(*) FILTER (entered_at IS NULL OR left_at IS NULL) AS missing_time, count(person_id) AS identified FROM sess GROUP BY 1),
pday AS (SELECT day, count(*) AS unique_persons, count(*) FILTER (gender = 'm') AS male, count(*) FILTER (gender = 'f') AS female, count(*) FILTER (gender IS NULL) AS unknown_gender, round(avg(age), 4) AS average_age,
  count(*) FILTER (age IS NULL) AS unknown_age FROM (SELECT DISTINCT day, person_id FROM sess WHERE person_id IS NOT NULL) d LEFT JOIN prof USING (person_id) GROUP BY 1),
rday AS (SELECT day, count(*) AS receipts, count(*) FILTER (id IN (SELECT receipt_id FROM n)) AS matched_receipts, CAST(sum(amount) AS DOUBLE) AS revenue, CAST(sum(amount) FILTER (id IN (SELECT receipt_id FROM n)) AS DOUBLE) AS matched_revenue FROM rec GROUP BY 1),
uday AS (SELECT r.day, count(*) AS ambiguous_matches FROM n JOIN rec r ON r.id = n.receipt_id WHERE n.is_ambiguous GROUP BY 1),
daily AS (SELECT d.day, coalesce(visits, 0) AS visits, coalesce(timed, 0) AS timed, coalesce(estimated, 0) AS estimated, coalesce(missing_time, 0) AS missing_time, coalesce(identified, 0) AS identified,
  coalesce(unique_persons, 0) AS unique_persons, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(unknown_gender, 0) AS unknown_gender, average_age, coalesce(unknown_age, 0) AS unknown_age,
  coalesce(receipts, 0) AS receipts, coalesce(matched_receipts, 0) AS matched_receipts, round(CASE WHEN receipts > 0 THEN 100.0::DOUBLE * matched_receipts / receipts ELSE 0 END, 4) AS coverage,
  coalesce(revenue, 0) AS revenue, coalesce(matched_revenue, 0) AS matched_revenue, coalesce(ambiguous_matches, 0) AS ambiguous_matches
  FROM days d LEFT JOIN sday s ON s.day = d.day LEFT JOIN pday p ON p.day = d.day LEFT JOIN rday r ON r.day = d.day LEFT JOIN uday u ON u.day = d.day)
"""
_TOTAL = """, everyone AS (SELECT DISTINCT person_id FROM sess WHERE person_id IS NOT NULL), known AS (SELECT person_id, gender, age FROM everyone LEFT JOIN prof USING (person_id)),
takes AS (SELECT receipt_id, count(*) AS c FROM n GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM sess) AS visits, (SELECT count(*) FROM sess WHERE entered_at IS NOT NULL AND left_at IS NOT NULL) AS timed,
  (SELECT count(*) FROM sess WHERE entered_at IS NOT NULL AND left_at IS NOT NULL AND time_is_estimated) AS estimated, (SELECT count(*) FROM sess WHERE entered_at IS NULL OR left_at IS NULL) AS missing_time,
  (SELECT count(person_id) FROM sess) AS identified, (SELECT count(*) FROM known) AS unique_persons, (SELECT count(*) FROM known WHERE gender = 'm') AS male, (SELECT count(*) FROM known WHERE gender = 'f') AS female,
  (SELECT count(*) FROM known WHERE gender IS NULL) AS unknown_gender, (SELECT count(*) FROM known WHERE age IS NULL) AS unknown_age, (SELECT round(avg(age), 4) FROM known) AS average_age,
  (SELECT count(*) FROM rec) AS receipts, (SELECT count(*) FROM takes) AS matched_receipts, (SELECT count(*) FROM n) AS match_rows, (SELECT count(*) FROM n WHERE is_ambiguous) AS ambiguous_matches,
  (SELECT count(*) FROM takes WHERE c > 1) AS multi_visit_receipts, (SELECT round(avg(duration_seconds), 4) FROM sess) AS average_duration,
  (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM rec) AS revenue, (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM rec JOIN takes ON takes.receipt_id = rec.id) AS matched_revenue,
  round(CASE WHEN (SELECT count(*) FROM rec) > 0 THEN 100.0::DOUBLE * (SELECT count(*) FROM takes) / (SELECT count(*) FROM rec) ELSE 0 END, 4) AS coverage,
  least((SELECT min(day) FROM sess), (SELECT min(day) FROM rec)) AS period_start, greatest((SELECT max(day) FROM sess), (SELECT max(day) FROM rec)) AS period_end,
  (SELECT count(DISTINCT video_id) FROM videos) AS videos, (SELECT count(DISTINCT processing_run_id) FROM visits) AS finished_runs)
"""
_P = ", ".join(_PEOPLE)

ORACLE = {
    "daily_metrics": _BASE + _PER_DAY + "SELECT * FROM daily",
    "total_metrics": _BASE + _TOTAL + "SELECT * FROM total",
    "people_summary_with_total": f"{_BASE}{_PER_DAY}{_TOTAL}SELECT CAST(day AS VARCHAR) AS day, {_P} FROM daily UNION ALL SELECT 'total' AS day, {_P} FROM total",
    "receipt_summary": _BASE + """, t AS (SELECT n.receipt_id, count(*) AS sessions, string_agg(CAST(n.visit_session_id AS VARCHAR), ', ' ORDER BY n.visit_session_id) AS session_ids, min(distance_us) AS nearest_us,
  bool_or(is_ambiguous) AS is_ambiguous, bool_or(is_group_match) AS is_group_match FROM n GROUP BY 1),
who AS (SELECT receipt_id, string_agg(CAST(person_id AS VARCHAR), ', ' ORDER BY person_id) AS person_ids FROM (SELECT DISTINCT n.receipt_id, s.person_id FROM n JOIN sess s ON s.id = n.visit_session_id WHERE s.person_id IS NOT NULL) GROUP BY 1),
how AS (SELECT receipt_id, string_agg(dating, ', ' ORDER BY dating) AS dating FROM (SELECT DISTINCT n.receipt_id, m.dating FROM n JOIN made m ON m.id = n.visit_session_id) GROUP BY 1)
SELECT r.id AS receipt_id, external_receipt_id, r.day, opened_at, closed_at, epoch_us(closed_at) - epoch_us(opened_at) AS service_us, CAST(amount AS DOUBLE) AS amount, tt, table_number, sessions IS NOT NULL AS matched,
  coalesce(sessions, 0) AS sessions, coalesce(person_ids, '') AS person_ids, coalesce(session_ids, '') AS session_ids, coalesce(dating, '') AS dating, nearest_us, coalesce(is_ambiguous, false) AS is_ambiguous,
  coalesce(sessions, 0) > 1 AS several_sessions, coalesce(is_group_match, false) AS is_group_match, source_file
FROM rec r LEFT JOIN t ON t.receipt_id = r.id LEFT JOIN who ON who.receipt_id = r.id LEFT JOIN how ON how.receipt_id = r.id""",
    "visit_summary": _BASE + """SELECT s.id AS visit_session_id, s.person_id, s.day, s.entered_at, s.left_at, s.duration_seconds, s.entry_frame_index, s.exit_frame_index, m.dating, s.video_id, d.filename, s.segments_count,
  m.visit_ids, m.track_ids, coalesce(f.is_identity_eligible, false) AS face_eligible, f.identity_quality_score AS face_quality, f.gender, f.age_estimate AS age, coalesce(r.external_receipt_id, '') AS receipts,
  CAST(r.amount AS DOUBLE) AS amount, n.distance_us, coalesce(n.is_ambiguous, false) AS is_ambiguous, coalesce(n.is_group_match, false) AS is_group_match, coalesce(s.time_is_estimated, false) AS time_is_estimated, s.session_key
FROM sess s JOIN made m ON m.id = s.id LEFT JOIN vday d ON d.video_id = s.video_id LEFT JOIN sface f ON f.session_id = s.id LEFT JOIN n ON n.visit_session_id = s.id LEFT JOIN rec r ON r.id = n.receipt_id""",
    "person_registry": _BASE + """, a AS (SELECT person_id, count(*) AS sessions, count(DISTINCT day) AS days FROM sess GROUP BY 1),
b AS (SELECT person_id, count(*) AS receipts, sum(amount) AS amount FROM (SELECT DISTINCT s.person_id, n.receipt_id FROM n JOIN sess s ON s.id = n.visit_session_id) t JOIN rec ON rec.id = t.receipt_id GROUP BY 1),
c AS (SELECT person_id, count(*) AS reference_faces, string_agg(DISTINCT coalesce(nullif(pose_category, ''), 'unknown'), ', ' ORDER BY coalesce(nullif(pose_category, ''), 'unknown')) AS poses FROM face WHERE is_identity_reference GROUP BY 1)
SELECT p.id AS person_id, gender, age, first_seen_at, last_seen_at, coalesce(days, 0) AS days, coalesce(sessions, 0) AS sessions, coalesce(receipts, 0) AS receipts, CAST(coalesce(amount, 0) AS DOUBLE) AS amount,
  coalesce(reference_faces, 0) AS reference_faces, coalesce(poses, '') AS poses, external_person_key
FROM (SELECT DISTINCT ON (id) * FROM persons ORDER BY id) p LEFT JOIN prof ON prof.person_id = p.id LEFT JOIN a ON a.person_id = p.id LEFT JOIN b ON b.person_id = p.id LEFT JOIN c ON c.person_id = p.id""",
    "quality_report": _BASE + _PER_DAY + """, c AS (SELECT s.day, count(*) AS with_face, count(*) FILTER (f.is_identity_eligible) AS with_eligible_face FROM sess s JOIN sface f ON f.session_id = s.id GROUP BY 1)
SELECT d.day, visits, timed, estimated, missing_time, identified, ambiguous_matches, receipts, matched_receipts, coverage, coalesce(with_face, 0) AS with_face, coalesce(with_eligible_face, 0) AS with_eligible_face
FROM daily d LEFT JOIN c ON c.day = d.day""",
    "report_faces": _BASE + "SELECT visit_id, id AS face_id FROM ranked WHERE visit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY rb DESC, rr DESC, ri DESC, rq DESC, id) = 1",
}
