"""Queries: receipts matched to sessions, sessions from visits, synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import amount
from tidemark.functions.time import epoch_us
from tidemark.operators import matching as M
from tidemark.operators import sessions as S
from tidemark.sources.tables import read_table

MINUTE_US = 60_000_000


def event_pairs(spark: SparkSession, sf_dir: str, after_us: int = MINUTE_US) -> DataFrame:
    """Candidates (session_id, receipt_id, distance_us): purchases are receipts, other events sessions of ten minutes; the window ends ``after_us`` past it."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", epoch_us(F.col("ts")).alias("t"))
    sessions = e.where("event_type <> 'purchase'").select(F.col("event_id").alias("session_id"), F.col("t").alias("lo"), (F.col("t") + 10 * MINUTE_US).alias("left_us"))
    receipts = e.where("event_type = 'purchase'").select(F.col("event_id").alias("receipt_id"), F.col("t").alias("closed_us"))
    pairs = M.interval_join(sessions, receipts, F.col("lo"), F.col("left_us") + after_us, F.col("closed_us"), 15 * MINUTE_US)
    return pairs.select("session_id", "receipt_id", F.abs(F.col("closed_us") - F.col("left_us")).alias("distance_us"))


def till_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(visit_session_id, receipt_id, distance_us, candidates, is_ambiguous, is_group_match) by till and time."""
    sessions = read_table(spark, sf_dir, "visit_sessions").where("entered_at is not null and left_at is not null")
    videos = read_table(spark, sf_dir, "videos").select("video_id", "camera_name")
    cameras = read_table(spark, sf_dir, "cameras").select("camera_name", "tt", "table_number")
    left = sessions.join(videos, "video_id").join(cameras, "camera_name")
    left = left.select(F.col("id").alias("visit_session_id"), "tt", "table_number", epoch_us(F.col("entered_at")).alias("lo"), epoch_us(F.col("left_at")).alias("left_us"))
    right = read_table(spark, sf_dir, "receipts").dropDuplicates(["id"]).select(F.col("id").alias("receipt_id"), "tt", "table_number", epoch_us(F.col("closed_at")).alias("closed_us"))
    pairs = M.interval_join(left, right, F.col("lo"), F.col("left_us") + MINUTE_US, F.col("closed_us"), 5 * MINUTE_US, ["tt", "table_number"])
    best = M.nearest_match(pairs, "visit_session_id", "receipt_id", F.abs(F.col("closed_us") - F.col("left_us")))
    return M.group_flags(best, "receipt_id")


def receipt_range_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir)


def receipt_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_match(event_pairs(spark, sf_dir), "session_id", "receipt_id", F.col("distance_us"))


def receipt_group_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_flags(receipt_nearest_match(spark, sf_dir), "receipt_id").select("session_id", "receipt_id", "is_group_match")


def receipt_till_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till_matches(spark, sf_dir)


def receipt_match_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the matches change as the window grows by nine minutes: sessions per status."""
    old = M.nearest_match(event_pairs(spark, sf_dir), "session_id", "receipt_id", F.col("distance_us"))
    new = M.nearest_match(event_pairs(spark, sf_dir, 10 * MINUTE_US), "session_id", "receipt_id", F.col("distance_us"))
    return M.sync_diff(old, new, "session_id", ["receipt_id", "distance_us", "is_ambiguous"]).groupBy("status").agg(F.count("*").alias("n"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "visits")


def visit_session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_visits(_visits(spark, sf_dir), 90_000_000).where("person_id is not null")


def visit_session_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.merge_visits(_visits(spark, sf_dir), 90_000_000).where("person_id is null")
    return out.select("session_key", "video_id", "visit_date", "segments_count", "duration_us")


def session_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions stored by gap 90 s against desired ones by 30 s: keys per status."""
    old, new = (S.merge_visits(_visits(spark, sf_dir), g).select("session_key", "segments_count", "visit_date") for g in (90_000_000, 30_000_000))
    return M.sync_diff(old, new, "session_key", ["segments_count", "visit_date"]).groupBy("status").agg(F.count("*").alias("n"))


def visit_gap_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of tracks (users) in frames (all events) of four recordings; visits shorter than 15 s are dropped."""
    e = read_table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("video_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("track_id"), epoch_us(F.col("ts")).alias("ts_us"))
    v = S.close_by_gap(e.select("video_id", "seq", "ts_us"), e, "video_id", "track_id", "seq", "ts_us", 4 * 3600 * 1_000_000)
    return v.where("last_us - first_us >= 15000000")


def session_window_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", F.timestamp_micros(epoch_us(F.col("ts"))).alias("ts"))
    s = S.point_sessions(e, "user_id", "ts", "4 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def observation_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id")
    return S.even_sample(e.withColumn("v", F.col("event_id")), "user_id", "event_id", "v").select("user_id", "pos", F.col("v").alias("event_id"))


def receipt_ingest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written as a shop writes amounts, and read again."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    text = F.concat(F.regexp_replace((F.col("c") / 100).cast("bigint").cast("string"), r"(?<=\d)(?=(\d{3})+$)", " "), F.lit(","), F.lpad((F.col("c") % 100).cast("string"), 2, "0"), F.lit(" ₽"))
    return o.select("o_orderkey", amount(text).cast("double").alias("amount"))


def receipt_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of receipts_stage whose id receipts lacks, the first row of each id."""
    stage = read_table(spark, sf_dir, "receipts_stage").select("external_receipt_id", "stage_id", "tt")
    have = read_table(spark, sf_dir, "receipts").select("external_receipt_id")
    return M.insert_new(have, stage, "external_receipt_id", [F.col("stage_id")])


def file_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts by SHA-256, the first document of each."""
    d = read_table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return d.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest order of each customer and status, with nulls equal, as the lookup of a run by its key and range."""
    o = read_table(spark, sf_dir, "orders").withColumn("range_end", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7))
    want = o.where("o_orderkey % 50 = 0").select("o_custkey", F.col("range_end").alias("want_end"), F.col("o_orderkey").alias("asked"))
    have = o.where(F.col("o_orderstatus").isin("O", "F")).select("o_custkey", "range_end", "o_orderkey")
    hit = want.join(have, (want.o_custkey == have.o_custkey) & F.col("want_end").eqNullSafe(F.col("range_end")))
    return hit.groupBy("asked").agg(F.max("o_orderkey").alias("found"))


def input_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations per check: null or repeated keys and dangling references. Repeats count rows beyond the first."""
    def repeats(table: str, key: str) -> DataFrame:
        t = read_table(spark, sf_dir, table)
        return t.agg((F.count(key) - F.count_distinct(key)).alias("n")).select(F.lit(f"{table}.{key} repeated").alias("check"), "n")

    def nulls(table: str, key: str) -> DataFrame:
        return read_table(spark, sf_dir, table).agg(F.count_if(F.col(key).isNull()).alias("n")).select(F.lit(f"{table}.{key} null").alias("check"), "n")

    visits, videos = read_table(spark, sf_dir, "visits"), read_table(spark, sf_dir, "videos")
    loose = visits.where("video_id is not null").join(videos, "video_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("visits.video_id dangling").alias("check"), "n")
    out = loose
    for part in (repeats("customer", "c_custkey"), repeats("visits", "event_key"), repeats("staff_registry", "id_staff"), nulls("staff_registry", "job_position"), nulls("receipts", "tt")):
        out = out.unionByName(part)
    return out


_PAIRS = """
WITH s AS (SELECT event_id AS session_id, ts AS lo, ts + INTERVAL 600 SECOND AS left_at FROM events WHERE event_type <> 'purchase'),
r AS (SELECT event_id AS receipt_id, ts AS closed_at FROM events WHERE event_type = 'purchase'),
p AS (SELECT session_id, receipt_id, abs(epoch_us(closed_at) - epoch_us(left_at)) AS distance_us FROM s JOIN r ON closed_at BETWEEN lo AND left_at + INTERVAL {after} SECOND),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY distance_us, receipt_id) AS k, count(*) OVER (PARTITION BY session_id) AS candidates FROM p),
n AS (SELECT session_id, receipt_id, distance_us, candidates, candidates > 1 AS is_ambiguous FROM m WHERE k = 1)
"""
_TILL = """
WITH s AS (
  SELECT v.id AS visit_session_id, c.tt, c.table_number, v.entered_at AS lo, v.left_at FROM visit_sessions v
  JOIN videos d ON d.video_id = v.video_id JOIN cameras c ON c.camera_name = d.camera_name WHERE v.entered_at IS NOT NULL AND v.left_at IS NOT NULL
), r AS (SELECT DISTINCT ON (id) id AS receipt_id, tt, table_number, closed_at FROM receipts),
p AS (SELECT visit_session_id, receipt_id, abs(epoch_us(closed_at) - epoch_us(left_at)) AS distance_us FROM s JOIN r USING (tt, table_number) WHERE closed_at BETWEEN lo AND left_at + INTERVAL 60 SECOND),
m AS (SELECT *, row_number() OVER (PARTITION BY visit_session_id ORDER BY distance_us, receipt_id) AS k, count(*) OVER (PARTITION BY visit_session_id) AS candidates FROM p),
n AS (SELECT visit_session_id, receipt_id, distance_us, candidates, candidates > 1 AS is_ambiguous, count(*) OVER (PARTITION BY receipt_id) > 1 AS is_group_match FROM m WHERE k = 1)
"""
TILL_CTE = _TILL
_FOLD = """
WITH RECURSIVE v AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY id) AS k FROM visits) WHERE k = 1 AND NOT coalesce(is_staff, false)
), o AS (
  SELECT id, event_key, video_id, person_id, coalesce(visit_date, CAST(entered_at AS DATE)) AS d, epoch_us(entered_at) AS a, epoch_us(left_at) AS b, entry_frame_index AS f, exit_frame_index AS x, entered_at, left_at, time_is_estimated,
    row_number() OVER (PARTITION BY video_id, person_id ORDER BY entry_frame_index NULLS LAST, id) AS rn
  FROM v WHERE person_id IS NOT NULL
), w AS (
  SELECT o.*, 1 AS no, b AS far FROM o WHERE rn = 1
  UNION ALL
  SELECT o.*, CASE WHEN o.d = w.d AND o.a - w.far <= {gap} THEN w.no ELSE w.no + 1 END,
    CASE WHEN o.d = w.d AND o.a - w.far <= {gap} THEN greatest(w.far, o.b) ELSE o.b END
  FROM w JOIN o ON o.video_id = w.video_id AND o.person_id = w.person_id AND o.rn = w.rn + 1
), z AS (
  SELECT video_id, person_id, min(d) AS visit_date, min(entered_at) AS entered_at, max(left_at) AS left_at, bool_or(time_is_estimated) AS time_is_estimated, min(f) AS entry_frame_index, max(x) AS exit_frame_index, count(*) AS segments_count,
    'session_' || sha256(string_agg(event_key, '|' ORDER BY event_key)) AS session_key, CASE WHEN max(b) >= min(a) THEN max(b) - min(a) END AS duration_us
  FROM w GROUP BY video_id, person_id, no
), y AS (
  SELECT 'session_' || sha256(event_key) AS session_key, video_id, coalesce(visit_date, CAST(entered_at AS DATE)) AS visit_date, 1 AS segments_count,
    CASE WHEN left_at >= entered_at THEN epoch_us(left_at) - epoch_us(entered_at) END AS duration_us FROM v WHERE person_id IS NULL
)
"""
_SYNC = """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN a.{key} IS NULL THEN 'create' WHEN b.{key} IS NULL THEN 'delete' WHEN {same} THEN 'unchanged' ELSE 'update' END AS status
  FROM ({old}) a FULL JOIN ({new}) b ON a.{key} = b.{key}
) GROUP BY status
"""


def _fold(gap: int) -> str:
    return _FOLD.format(gap=gap) + "SELECT session_key, segments_count, visit_date FROM z UNION ALL SELECT session_key, segments_count, visit_date FROM y"


QUERIES = {
    f.__name__: f
    for f in (
        receipt_range_candidates, receipt_nearest_match, receipt_group_flags, receipt_till_match, receipt_match_sync_diff, visit_session_merge, visit_session_singletons, session_sync_diff,
        visit_gap_close, session_window_points, observation_sampling, receipt_ingest_normalize, receipt_ingest_dedup, file_fingerprint_dedup, run_lookup, input_assertions,
    )
}
ORACLE = {
    "receipt_range_candidates": _PAIRS.format(after=60) + "SELECT * FROM p",
    "receipt_nearest_match": _PAIRS.format(after=60) + "SELECT * FROM n",
    "receipt_group_flags": _PAIRS.format(after=60) + "SELECT session_id, receipt_id, count(*) OVER (PARTITION BY receipt_id) > 1 AS is_group_match FROM n",
    "receipt_till_match": _TILL + "SELECT * FROM n",
    "receipt_match_sync_diff": _SYNC.format(
        key="session_id",
        same="a.receipt_id = b.receipt_id AND a.distance_us = b.distance_us AND a.is_ambiguous = b.is_ambiguous",
        old=_PAIRS.format(after=60) + "SELECT * FROM n",
        new=_PAIRS.format(after=600) + "SELECT * FROM n",
    ),
    "visit_session_merge": _FOLD.format(gap=90000000) + "SELECT * FROM z",
    "visit_session_singletons": _FOLD.format(gap=90000000) + "SELECT * FROM y",
    "session_sync_diff": _SYNC.format(key="session_key", same="a.segments_count = b.segments_count AND a.visit_date IS NOT DISTINCT FROM b.visit_date", old=_fold(90000000), new=_fold(30000000)),
    "visit_gap_close": """
WITH e AS (SELECT event_id % 4 AS video_id, event_id AS seq, user_id AS track_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS before FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY video_id, track_id ORDER BY seq) AS seen FROM e),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR before - seen > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY seq) AS visit_no FROM l)
SELECT video_id, track_id, CAST(visit_no AS BIGINT) AS visit_no, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM n GROUP BY video_id, track_id, visit_no HAVING max(t) - min(t) >= 15000000
""",
    "session_window_points": """
WITH l AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(t) AS start_us, max(t) AS last_us, count(*) AS n FROM n GROUP BY user_id, k
""",
    "observation_sampling": """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT g AS pos, user_id, n, CAST(round_even(g * (n - 1) / 19.0::DOUBLE, 0) AS BIGINT) AS i FROM (SELECT DISTINCT user_id, n FROM r WHERE n > 20), range(20) t(g))
SELECT r.user_id, s.pos, r.event_id FROM r JOIN s USING (user_id, i) UNION ALL SELECT user_id, i, event_id FROM r WHERE n <= 20
""",
    "receipt_ingest_normalize": "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders",
    "receipt_ingest_dedup": "SELECT external_receipt_id, stage_id, tt FROM (SELECT *, row_number() OVER (PARTITION BY external_receipt_id ORDER BY stage_id) AS k FROM receipts_stage WHERE external_receipt_id IS NOT NULL AND external_receipt_id NOT IN (SELECT external_receipt_id FROM receipts WHERE external_receipt_id IS NOT NULL)) WHERE k = 1",
    "file_fingerprint_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "run_lookup": """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END AS range_end FROM orders)
SELECT w.o_orderkey AS asked, max(h.o_orderkey) AS found FROM o w JOIN o h ON w.o_custkey = h.o_custkey AND w.range_end IS NOT DISTINCT FROM h.range_end
WHERE w.o_orderkey % 50 = 0 AND h.o_orderstatus IN ('O', 'F') GROUP BY 1
""",
    "input_assertions": """
SELECT 'visits.video_id dangling' AS "check", count(*) AS n FROM visits WHERE video_id NOT IN (SELECT video_id FROM videos)
UNION ALL SELECT 'customer.c_custkey repeated', count(c_custkey) - count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'visits.event_key repeated', count(event_key) - count(DISTINCT event_key) FROM visits
UNION ALL SELECT 'staff_registry.id_staff repeated', count(id_staff) - count(DISTINCT id_staff) FROM staff_registry
UNION ALL SELECT 'staff_registry.job_position null', count(*) FILTER (job_position IS NULL) FROM staff_registry
UNION ALL SELECT 'receipts.tt null', count(*) FILTER (tt IS NULL) FROM receipts
""",
}
