"""Queries: zones, boxes, clock texts, timelines and frame sampling, on boxes and texts made from events by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import text as X
from tidemark.functions.time import epoch_us
from tidemark.operators import sampling as P
from tidemark.operators import timeline as T
from tidemark.params import Sampling
from tidemark.sources.tables import read_table

#: A zone with a slanted side and a notch, so that edges and corners matter.
ZONE = ((10, 0), (90, 0), (90, 80), (50, 40), (10, 80))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    x1, y1 = F.col("event_id") * 7 % 100 - 10, F.col("event_id") * 13 % 70
    return e.select("event_id", "user_id", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("event_id") * 3 % 23).alias("x2"), (y1 + F.col("event_id") * 5 % 31).alias("y2"))


def _zone_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = G.bottom_center(F.col("x1"), F.col("x2"), F.col("y2"))
    b = _boxes(spark, sf_dir).withColumn("px", px).withColumn("py", py)
    return b.where(G.in_polygon(F.col("px"), F.col("py"), ZONE))


def zone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zone_points(spark, sf_dir).select("event_id", "px", "py")


def zone_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (a hundred events each) with somebody in the zone, how many, the most at once, and distinct tracks."""
    z = _zone_points(spark, sf_dir).withColumn("frame", F.floor(F.col("event_id") / 100))
    per = z.groupBy("frame").agg(F.count("*").alias("n")).agg(F.count("*").alias("frames"), F.sum("n").alias("total"), F.max("n").alias("most"))
    return per.crossJoin(z.agg(F.count_distinct("user_id").alias("tracks")))


def box_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by a tenth sideways and below and two fifths above, cut to the frame."""
    b = _boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # whole pixels, toward zero
    grown = [(c * 10).cast("bigint") for c in (F.col("x1") - w / 10, F.col("y1") - h * 4 / 10, F.col("x2") + w / 10, F.col("y2") + h / 10)]
    cut = G.clip(*[(g / 10).cast("bigint") for g in grown], F.lit(90), F.lit(80))
    return b.select("event_id", *[c.alias(n) for c, n in zip(cut, ("cx1", "cy1", "cx2", "cy2"), strict=True)])


def face_track_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame and track the face whose centre lies in the upper part of the track's box: best quality, then nearest, then smallest id."""
    b = _boxes(spark, sf_dir).withColumn("frame", F.floor(F.col("event_id") / 20))
    tracks = b.where("event_id % 2 = 0").select("frame", F.col("event_id").alias("track"), F.col("x1").alias("a"), F.col("y1").alias("b"), (F.col("x2") + 30).alias("c"), (F.col("y2") + 40).alias("d"))
    faces = b.where("event_id % 2 = 1").select("frame", F.col("event_id").alias("face"), "x1", "y1", "x2", "y2", (F.col("event_id") * 17 % 10).alias("quality"))
    inner, outer = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in "abcd"]
    hit = tracks.join(faces, "frame").where(G.upper_part(inner, outer, 0.03, 0.65)).withColumn("distance", F.round(G.center_distance(inner, outer), 6))
    best = hit.groupBy("frame", "track").agg(F.min(F.struct((-F.col("quality")).alias("q"), "distance", "face")).alias("b"))
    return best.select("frame", "track", F.col("b.face").alias("face"), F.col("b.distance").alias("distance"))


def face_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of five parts in 0..1, from angles and sizes; and the pose the yaw shows."""
    i = F.col("event_id")
    yaw = F.when(i % 9 != 0, (i * 11 % 121 - 60).cast("double"))
    pitch = F.when(i % 9 != 0, (i * 7 % 91 - 45).cast("double"))
    part = lambda k: ((i * k % 101) / 100).cast("double")
    straight = F.coalesce((G.angle_score(yaw, 40) + G.angle_score(pitch, 30)) / 2, F.lit(0.5))
    score = 0.30 * part(3) + 0.25 * part(5) + 0.20 * part(7) + 0.15 * straight + 0.10 * part(13)
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), G.pose(yaw, 15).alias("pose"))


def _clock_text(ts: Column, kind: Column) -> Column:
    plain = F.date_format(ts, "MM-dd-yyyy EEE HH:mm:ss")
    return (
        F.when(kind == 0, plain)
        .when(kind == 1, F.date_format(ts, "MM dd yyyy EEE HHmmss"))
        .when(kind == 2, F.date_format(ts, "MM-dd-yyyyEEEHH:mm:ss"))
        .when(kind == 3, F.concat(F.lit("  "), F.date_format(ts, "MM-dd-yyyy   EEEy HH:mm:ss")))
        .when(kind == 4, F.date_format(ts, "MM.dd.yyyy EEE H mm ss"))
        .when(kind == 5, F.date_format(ts, "MM - dd-yyyy/EEE HHmm:ss"))
        .when(kind == 6, F.date_format(ts, "MM-dd-yyyy\\EEE H.mm-ss"))
        .when(kind == 7, F.concat(F.date_format(ts, "MM-dd-yyyy EEE "), F.lit("31.59.59 x "), F.date_format(ts, "HH:mm:ss"), F.lit(" x 29:00:00")))
        .when(kind == 8, F.concat(F.lit("13-40-2024 "), F.date_format(ts, "EEE HH:mm:ss")))
        .otherwise(F.date_format(ts, "MM-dd-yyyy"))
    )


def ocr_clock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock texts with known faults, and what they are read as."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.timestamp_micros(epoch_us(F.col("ts")))).alias("ts"))
    return e.select("event_id", X.clock_us(_clock_text(F.col("ts"), F.col("event_id") % 10)).alias("clock_us"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six readings per user, whose implied starts scatter by up to five seconds."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 6).alias("slot"))
    e = e.groupBy("user_id", "slot").agg(F.min("event_id").alias("i"))
    return e.select("user_id", (F.col("slot") * 5).alias("offset_s"), (F.col("i") * 7919 % 5000 * 1000).alias("start_us"))


def time_anchor_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consensus(_readings(spark, sf_dir), "user_id", "start_us", "offset_s", 2_000_000, 2)


def timeline_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as media time of a clock that drifts by user, mapped back, and the end's verdict."""
    i, u = F.col("event_id"), F.col("user_id")
    end_ts, end_clock = F.lit(3_600_000_000), 3_600_000_000 + (u % 25 - 12) * 1_000_000
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.select(
        "event_id",
        T.calibrated_us(i * 1_000_003 % 3_600_000_000, F.lit(0), F.lit(1_700_000_000_000_000), end_ts, 1_700_000_000_000_000 + end_clock - 0).alias("clock_us"),
        T.end_status(F.when(u % 10 != 0, end_clock - end_ts), 2_000_000, 10_000_000).alias("status"),
    )


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twelfth event from the thirtieth on, the first 200 of them: a range with a limit is what the operator is for."""
    return P.every(read_table(spark, sf_dir, "events").select("event_id"), "event_id", 12, 30, 200)


def adaptive_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of four recordings, somebody seen in one of fifty."""
    e = read_table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("video_id"), F.floor(F.col("event_id") / 4).alias("frame_index"), (F.col("user_id") % 50 == 0).alias("seen"))
    return P.adaptive(e, 1.0, Sampling(active_s=1, idle_s=5, idle_after_s=30, rewind_s=10))


_BOX = "b AS (SELECT event_id, user_id, event_id * 7 % 100 - 10 AS x1, event_id * 13 % 70 AS y1, event_id * 7 % 100 - 10 + event_id * 3 % 23 AS x2, event_id * 13 % 70 + event_id * 5 % 31 AS y2 FROM events)"


def _zone_sql() -> str:
    sides = list(zip(ZONE, [*ZONE[1:], ZONE[0]], strict=True))
    edge = " OR ".join(f"((px - {a}) * {d - b} = (py - {b}) * {c - a} AND px BETWEEN {min(a, c)} AND {max(a, c)} AND py BETWEEN {min(b, d)} AND {max(b, d)})" for (a, b), (c, d) in sides)
    ray = " + ".join(f"CASE WHEN ({b} > py) <> ({d} > py) AND px < {c - a} * (py - {b}) / {d - b}.0 + {a} THEN 1 ELSE 0 END" for (a, b), (c, d) in sides if b != d)
    return f"WITH {_BOX}, p AS (SELECT event_id, user_id, CAST(floor((x1 + x2) / 2) AS BIGINT) AS px, y2 AS py FROM b), z AS (SELECT * FROM p WHERE ({edge}) OR ({ray}) % 2 = 1) "


QUERIES = {
    f.__name__: f
    for f in (
        zone_filter, zone_scan_stats, box_clip, face_track_association, face_quality_score, ocr_clock_parse, time_anchor_consensus, timeline_calibration, frame_sampling, adaptive_sampling,
    )
}
ORACLE = {
    "zone_filter": _zone_sql() + "SELECT event_id, px, py FROM z",
    "zone_scan_stats": _zone_sql() + ", f AS (SELECT event_id // 100 AS frame, count(*) AS n FROM z GROUP BY 1) SELECT (SELECT count(*) FROM f) AS frames, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS total, (SELECT max(n) FROM f) AS most, (SELECT count(DISTINCT user_id) FROM z) AS tracks",
    "box_clip": f"""WITH {_BOX}, g AS (SELECT event_id, trunc(trunc(x1 * 10 - (x2 - x1)) / 10) AS a, trunc(trunc(y1 * 10 - (y2 - y1) * 4) / 10) AS b, trunc(trunc(x2 * 10 + (x2 - x1)) / 10) AS c, trunc(trunc(y2 * 10 + (y2 - y1)) / 10) AS d FROM b),
k AS (SELECT event_id, greatest(a, 0) AS a, greatest(b, 0) AS b, least(c, 90) AS c, least(d, 80) AS d FROM g)
SELECT event_id, CAST(CASE WHEN c > a AND d > b THEN a END AS BIGINT) AS cx1, CAST(CASE WHEN c > a AND d > b THEN b END AS BIGINT) AS cy1, CAST(CASE WHEN c > a AND d > b THEN c END AS BIGINT) AS cx2, CAST(CASE WHEN c > a AND d > b THEN d END AS BIGINT) AS cy2 FROM k""",
    "face_track_association": f"""WITH {_BOX}, t AS (SELECT event_id // 20 AS frame, event_id AS track, x1 AS a, y1 AS b, x2 + 30 AS c, y2 + 40 AS d FROM b WHERE event_id % 2 = 0),
f AS (SELECT event_id // 20 AS frame, event_id AS face, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, event_id * 17 % 10 AS quality FROM b WHERE event_id % 2 = 1),
h AS (SELECT t.frame, track, face, quality, round(sqrt(pow(cx - (a + c) / 2.0, 2) + pow(cy - (b + d) / 2.0, 2)), 6) AS distance FROM t JOIN f ON t.frame = f.frame
  WHERE cx BETWEEN a AND c AND cy BETWEEN b AND d AND d > b AND (cy - b) / (d - b) BETWEEN 0.03::DOUBLE AND 0.65::DOUBLE),
k AS (SELECT *, row_number() OVER (PARTITION BY frame, track ORDER BY quality DESC, distance, face) AS k FROM h)
SELECT frame, track, face, distance FROM k WHERE k = 1""",
    "face_quality_score": """
WITH a AS (SELECT event_id AS i, CASE WHEN event_id % 9 <> 0 THEN (event_id * 11 % 121 - 60)::DOUBLE END AS yaw, CASE WHEN event_id % 9 <> 0 THEN (event_id * 7 % 91 - 45)::DOUBLE END AS pitch FROM events),
s AS (SELECT *, coalesce((CASE WHEN yaw IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - abs(yaw) / 40) END + greatest(0.0::DOUBLE, 1 - abs(pitch) / 30)) / 2, 0.5) AS straight FROM a)
SELECT i AS event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.30::DOUBLE * (i * 3 % 101 / 100::DOUBLE) + 0.25::DOUBLE * (i * 5 % 101 / 100::DOUBLE) + 0.20::DOUBLE * (i * 7 % 101 / 100::DOUBLE) + 0.15::DOUBLE * straight + 0.10::DOUBLE * (i * 13 % 101 / 100::DOUBLE))), 6) AS score,
  CASE WHEN yaw IS NULL THEN 'unknown' WHEN abs(yaw) <= 15 THEN 'frontal' WHEN yaw < -15 THEN 'left' ELSE 'right' END AS pose FROM s""",
    "ocr_clock_parse": "SELECT event_id, CASE WHEN event_id % 10 < 8 THEN epoch_us(date_trunc('second', ts)) END AS clock_us FROM events",
    "time_anchor_consensus": """
WITH r AS (SELECT user_id, s * 5 AS o, i * 7919 % 5000 * 1000 AS t FROM (SELECT user_id, event_id % 6 AS s, min(event_id) AS i FROM events GROUP BY 1, 2)),
w AS (SELECT a.user_id, a.t AS hi, count(*) AS n, a.t - min(b.t) AS spread, min(b.o) AS first FROM r a JOIN r b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 2000000 AND a.t GROUP BY a.user_id, a.t, a.o),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, spread, first, hi) AS k FROM w),
m AS (SELECT k.user_id, k.n, k.spread, r.t, r.o, median(r.t) OVER (PARTITION BY k.user_id) AS mid FROM k JOIN r ON r.user_id = k.user_id AND r.t BETWEEN k.hi - k.spread AND k.hi WHERE k.k = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(t - mid), o, t) AS j FROM m)
SELECT user_id, n AS n_consistent, spread AS spread_us, CASE WHEN n >= 2 THEN t END AS start_us, CASE WHEN n >= 2 THEN o END AS "offset" FROM c WHERE j = 1""",
    "timeline_calibration": """
SELECT event_id, 1700000000000000 + CAST(round_even((event_id * 1000003 % 3600000000) * ((3600000000 + (user_id % 25 - 12) * 1000000) / 3600000000::DOUBLE), 0) AS BIGINT) AS clock_us,
  CASE WHEN user_id % 10 = 0 THEN 'unavailable' WHEN abs(user_id % 25 - 12) <= 2 THEN 'valid' WHEN abs(user_id % 25 - 12) <= 10 THEN 'calibrated' ELSE 'mismatch' END AS status FROM events""",
    "frame_sampling": "SELECT event_id FROM events WHERE event_id >= 30 AND (event_id - 30) % 12 = 0 AND event_id < 30 + 12 * 200",
}
