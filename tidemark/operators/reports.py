"""Daily, total, per-receipt, per-session, per-person and quality views.

Inputs are ``sessions`` (id, session_key, video_id, person_id, visit_date, entered_at, left_at, duration_seconds, entry_frame_index,
exit_frame_index, segments_count, time_is_estimated), ``matches`` (visit_session_id, receipt_id, distance_us, is_ambiguous, is_group_match),
``receipts`` (id, external_receipt_id, tt, opened_at, closed_at, amount, table_number, source_file), ``profiles`` (person_id, gender, age,
reference_faces, poses), ``videos`` (video_id, filename, start_day) and ``links`` (visit_session_id, visit_id, track_id, time_is_estimated), the
visits each session was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us

GENDERS = ("m", "f")
_NUMBER = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))


def session_days(sessions: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds ``day``: the session's date, else the first date known of its recording's sessions, else the day the recording started, else null."""
    first = sessions.groupBy("video_id").agg(F.min("visit_date").alias("_first"))
    start = videos.groupBy("video_id").agg(F.min("start_day").alias("_start"))
    out = sessions.join(first, "video_id", "left").join(start, "video_id", "left")
    return out.withColumn("day", F.coalesce("visit_date", "_first", "_start")).drop("_first", "_start")


def face_rank() -> Column:
    """A struct whose greatest is the best face: marked best, then reference, then identity quality, then quality, then the smaller id."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return F.struct(flag("is_best"), flag("is_identity_reference"), _NUMBER("identity_quality_score").alias("iq"), _NUMBER("quality_score").alias("q"), (-F.col("id").cast("bigint")).alias("id"))


def person_profiles(faces: DataFrame) -> DataFrame:
    """(person_id, gender, age, reference_faces, poses): of a person's reference faces, else the eligible, else all, the most frequent gender (then the
    larger sum of identity quality, then the name) and the median age; the number of reference faces and their poses, sorted."""
    tier = F.when(F.col("is_identity_reference"), 2).when(F.col("is_identity_eligible"), 1).otherwise(0)
    f = faces.where("person_id is not null").withColumn("_tier", F.coalesce(tier, F.lit(0)))
    f = f.withColumn("_best", F.max("_tier").over(Window.partitionBy("person_id"))).where("_tier = _best")
    votes = f.groupBy("person_id", "gender").agg(F.count("*").alias("n"), F.round(F.sum(_NUMBER("identity_quality_score")), 6).alias("q"))
    rank = F.when(F.col("gender").isin(*GENDERS), F.struct((-F.col("n")).alias("n"), (-F.col("q")).alias("q"), "gender"))
    winner = votes.groupBy("person_id").agg(F.min(rank).alias("b")).select("person_id", F.col("b.gender").alias("gender"))
    is_reference = F.col("_tier") == 2
    pose = F.coalesce(F.nullif("pose_category", F.lit("")), F.lit("unknown"))
    other = f.groupBy("person_id").agg(
        F.round(F.median("age_estimate"), 4).alias("age"),
        F.count_if(is_reference).alias("reference_faces"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_reference, pose))), ", ").alias("poses"),
    )
    return other.join(winner, "person_id", "left").select("person_id", "gender", "age", "reference_faces", "poses")


def session_links(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """(visit_session_id, visit_id, track_id, time_is_estimated): visits of a session's person in its recording that began within it.

    Where sessions of a person overlap, the smaller id has the visit; a visit without person, recording or entry has no session.
    """
    s = sessions.where("person_id is not null and entered_at <= left_at").select("video_id", "person_id", F.col("id").alias("visit_session_id"), F.col("entered_at").alias("_lo"), F.col("left_at").alias("_hi"))
    v = visits.where("person_id is not null and entered_at is not null").select("video_id", "person_id", F.col("id").alias("visit_id"), "track_id", "time_is_estimated", "entered_at").dropDuplicates(["visit_id"])
    met = v.join(s, ["video_id", "person_id"]).where(F.col("entered_at").between(F.col("_lo"), F.col("_hi")))
    return met.groupBy("visit_id").agg(F.min(F.struct("visit_session_id", "track_id", "time_is_estimated")).alias("b")).select("b.visit_session_id", "visit_id", "b.track_id", "b.time_is_estimated")


def session_faces(links: DataFrame, faces: DataFrame) -> DataFrame:
    """(visit_session_id, face_id, is_identity_eligible, identity_quality_score, gender, age_estimate): the best face of a session's visits."""
    f = faces.select("visit_id", face_rank().alias("r"), "is_identity_eligible", "identity_quality_score", "gender", "age_estimate")
    value = F.struct(F.coalesce("is_identity_eligible", F.lit(False)).alias("is_identity_eligible"), "identity_quality_score", "gender", "age_estimate")
    best = links.select("visit_id", "visit_session_id").join(f, "visit_id").groupBy("visit_session_id").agg(F.max_by(F.struct(F.col("r.id").alias("i"), value.alias("v")), "r").alias("b"))
    return best.select("visit_session_id", (-F.col("b.i")).alias("face_id"), "b.v.*")


def dating(estimated: Column, entered: Column, left: Column) -> Column:
    """How a session got its times: ``none`` without both bounds, ``manual`` if one of its visits has an estimated time, else ``clock``."""
    return F.when(entered.isNull() | left.isNull(), "none").when(F.coalesce(estimated, F.lit(False)), "manual").otherwise("clock")


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 4)


def _session_metrics(s: DataFrame, by: list[str]) -> DataFrame:
    timed = F.col("entered_at").isNotNull() & F.col("left_at").isNotNull()
    return s.groupBy(*by).agg(
        F.count("*").alias("visits"),
        F.count_if(timed).alias("timed"),
        F.count_if(timed & F.coalesce("time_is_estimated", F.lit(False))).alias("estimated"),
        F.count_if(~timed).alias("missing_time"),
        F.count_if(F.col("person_id").isNotNull()).alias("identified"),
        F.round(F.avg("duration_seconds"), 4).alias("average_duration"),
    )


def _person_metrics(s: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    # each person counts once a group, so distinct persons come first and the profile is joined to them
    p = s.where("person_id is not null").select(*by, "person_id").distinct().join(profiles.select("person_id", "gender", "age"), "person_id", "left")
    return p.groupBy(*by).agg(
        F.count("*").alias("unique_persons"),
        F.count_if(F.col("gender") == GENDERS[0]).alias("male"),
        F.count_if(F.col("gender") == GENDERS[1]).alias("female"),
        F.count_if(F.col("gender").isNull()).alias("unknown_gender"),
        F.round(F.avg("age"), 4).alias("average_age"),
        F.count_if(F.col("age").isNull()).alias("unknown_age"),
    )


def _receipt_metrics(r: DataFrame, by: list[str]) -> DataFrame:
    """``r`` carries, per receipt, its matches, and how many of these are ambiguous."""
    return r.groupBy(*by).agg(
        F.count("*").alias("receipts"),
        F.count_if(F.col("taken") > 0).alias("matched_receipts"),
        F.sum("taken").alias("match_rows"),
        F.sum("unsure").alias("ambiguous_matches"),
        F.count_if(F.col("taken") > 1).alias("multi_visit_receipts"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("revenue"),
        F.coalesce(F.sum(F.when(F.col("taken") > 0, F.col("amount"))), F.lit(0)).cast("decimal(38,2)").alias("matched_revenue"),
    )


_COUNTS = (
    "visits", "timed", "estimated", "missing_time", "identified", "unique_persons", "male", "female", "unknown_gender", "unknown_age", "receipts", "matched_receipts", "match_rows", "ambiguous_matches",
    "multi_visit_receipts",
)


def metrics(sessions: DataFrame, matches: DataFrame, receipts: DataFrame, profiles: DataFrame, videos: DataFrame, per_day: bool) -> DataFrame:
    """The metrics of each day that has a session or a receipt, or of everything.

    Sessions count on their own day, receipts and their matches on the day of ``closed_at``; what has no day is in no day's row, but in the total.
    The total is computed anew, as distinct persons of days do not add up, and has ``period_start``, ``period_end`` and ``videos`` besides.
    A receipt counts once, however many sessions took it. ``timed`` has both bounds, ``estimated`` is a part of it, ``missing_time`` the rest.
    """
    s = session_days(sessions, videos).withColumn("_all", F.lit(0))
    per = matches.groupBy(F.col("receipt_id").alias("id")).agg(F.count("*").alias("taken"), F.count_if("is_ambiguous").alias("unsure"))
    r = receipts.dropDuplicates(["id"]).join(per, "id", "left").fillna(0, ["taken", "unsure"])
    r = r.withColumn("day", F.to_date("closed_at")).withColumn("_all", F.lit(0))
    by = ["_all"]
    if per_day:
        by, s, r = ["day"], s.where("day is not null"), r.where("day is not null")
    out = _session_metrics(s, by).join(_person_metrics(s, profiles, by), by, "left").join(_receipt_metrics(r, by), by, "full")
    money = [F.coalesce(c, F.lit(0)).cast("decimal(38,2)").alias(c) for c in ("revenue", "matched_revenue")]
    out = out.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS], "average_age", "average_duration", *money)
    out = out.withColumn("coverage", _ratio(F.col("matched_receipts"), F.col("receipts")))
    if per_day:
        return out
    days = s.select("day").unionByName(r.select("day")).agg(F.min("day").alias("period_start"), F.max("day").alias("period_end"))
    return out.crossJoin(days).crossJoin(videos.agg(F.count_distinct("video_id").alias("videos"))).drop("_all")


def receipt_summary(receipts: DataFrame, matches: DataFrame, sessions: DataFrame, links: DataFrame) -> DataFrame:
    """One row per receipt with its time of service, the sessions and persons that took it and how these were dated."""
    manual = links.groupBy("visit_session_id").agg(F.bool_or("time_is_estimated").alias("_manual"))
    s = sessions.select(F.col("id").alias("visit_session_id"), "person_id", "entered_at", "left_at").join(manual, "visit_session_id", "left")
    s = s.select("visit_session_id", "person_id", dating(F.col("_manual"), F.col("entered_at"), F.col("left_at")).alias("dating"))
    m = matches.join(s, "visit_session_id", "left")
    per = m.groupBy(F.col("receipt_id").alias("id")).agg(
        F.count("*").alias("sessions"),
        F.array_join(F.array_sort(F.collect_list("visit_session_id")), ", ").alias("session_ids"),
        F.array_join(F.array_sort(F.collect_set("person_id")), ", ").alias("person_ids"),
        F.array_join(F.array_sort(F.collect_set("dating")), ", ").alias("dating"),
        F.bool_or("is_ambiguous").alias("is_ambiguous"),
        F.bool_or("is_group_match").alias("is_group_match"),
        F.min("distance_us").alias("nearest_us"),
    )
    service = epoch_us(F.col("closed_at")) - epoch_us(F.col("opened_at"))
    r = receipts.dropDuplicates(["id"]).join(per, "id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    n = F.coalesce("sessions", F.lit(0))
    return r.select(
        F.col("id").alias("receipt_id"), "external_receipt_id", F.to_date("closed_at").alias("day"), "opened_at", "closed_at", service.alias("service_us"), "amount", "tt", "table_number",
        (n > 0).alias("matched"), n.alias("sessions"), text("person_ids"), text("session_ids"), text("dating"), "nearest_us", flag("is_ambiguous"), (n > 1).alias("several_sessions"), flag("is_group_match"),
        "source_file",
    )


def session_summary(sessions: DataFrame, matches: DataFrame, receipts: DataFrame, videos: DataFrame, links: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per session with its recording, source visits, best face and receipt."""
    r = receipts.dropDuplicates(["id"]).select(F.col("id").alias("receipt_id"), "external_receipt_id", "amount")
    m = matches.join(r, "receipt_id", "left").groupBy(F.col("visit_session_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_list("external_receipt_id")), ", ").alias("receipts"),
        F.sum("amount").cast("decimal(38,2)").alias("amount"),
        F.min("distance_us").alias("distance_us"),
        F.bool_or("is_ambiguous").alias("is_ambiguous"),
        F.bool_or("is_group_match").alias("is_group_match"),
    )
    source = links.groupBy(F.col("visit_session_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("visit_id", "track_id"))).alias("_v"), F.bool_or("time_is_estimated").alias("_manual")
    )
    best = session_faces(links, faces).withColumnRenamed("visit_session_id", "id")
    names = videos.select("video_id", "filename").dropDuplicates(["video_id"])
    out = session_days(sessions, videos).join(names, "video_id", "left").join(m, "id", "left").join(source, "id", "left").join(best, "id", "left")
    flag = lambda c, name=None: F.coalesce(c, F.lit(False)).alias(name or c)
    joined = lambda part: F.coalesce(F.array_join(F.transform("_v", lambda x: x[part].cast("string")), ", "), F.lit(""))
    return out.select(
        F.col("id").alias("visit_session_id"), "person_id", "day", "entered_at", "left_at", "duration_seconds", "entry_frame_index", "exit_frame_index",
        dating(F.col("_manual"), F.col("entered_at"), F.col("left_at")).alias("dating"), "video_id", "filename", "segments_count", joined("visit_id").alias("visit_ids"), joined("track_id").alias("track_ids"),
        flag("is_identity_eligible", "face_eligible"), F.col("identity_quality_score").alias("face_quality"), "gender", F.col("age_estimate").alias("age"),
        F.coalesce("receipts", F.lit("")).alias("receipts"), "amount", "distance_us", flag("is_ambiguous"), flag("is_group_match"), flag("time_is_estimated"), "session_key",
    )


def person_registry(persons: DataFrame, sessions: DataFrame, matches: DataFrame, receipts: DataFrame, profiles: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per person with its days, sessions, distinct receipts and what these came to, reference faces and their poses."""
    s = session_days(sessions, videos).where("person_id is not null")
    activity = s.groupBy("person_id").agg(F.count("*").alias("sessions"), F.count_distinct("day").alias("days"))
    took = matches.join(s.select(F.col("id").alias("visit_session_id"), "person_id"), "visit_session_id").select("person_id", "receipt_id").distinct()
    spent = took.join(receipts.dropDuplicates(["id"]).select(F.col("id").alias("receipt_id"), "amount"), "receipt_id").groupBy("person_id").agg(F.count("*").alias("receipts"), F.sum("amount").alias("amount"))
    p = persons.dropDuplicates(["id"]).select(F.col("id").alias("person_id"), "external_person_key", "first_seen_at", "last_seen_at")
    out = p.join(profiles, "person_id", "left").join(activity, "person_id", "left").join(spent, "person_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "person_id", "gender", "age", "first_seen_at", "last_seen_at", count("days"), count("sessions"), count("receipts"), F.coalesce("amount", F.lit(0)).cast("decimal(38,2)").alias("amount"),
        count("reference_faces"), F.coalesce("poses", F.lit("")).alias("poses"), "external_person_key",
    )


def face_coverage(sessions: DataFrame, videos: DataFrame, links: DataFrame, faces: DataFrame) -> DataFrame:
    """(day, with_face, with_eligible_face): sessions whose visits have a face, and whose best face is eligible."""
    best = session_faces(links, faces).select(F.col("visit_session_id").alias("id"), "is_identity_eligible")
    s = session_days(sessions, videos).where("day is not null").join(best, "id")
    return s.groupBy("day").agg(F.count("*").alias("with_face"), F.count_if("is_identity_eligible").alias("with_eligible_face"))


def best_face(faces: DataFrame) -> DataFrame:
    """Each visit's face: eligible before not, then higher identity quality, then higher quality, then smaller id."""
    score = [F.desc(F.coalesce("is_identity_eligible", F.lit(False))), F.desc(F.coalesce("identity_quality_score", F.lit(0.0))), F.desc(F.coalesce("quality_score", F.lit(0.0))), F.asc("id")]
    return faces.withColumn("_n", F.row_number().over(Window.partitionBy("visit_id").orderBy(*score))).where("_n = 1").drop("_n")


def report_face(faces: DataFrame, key: str) -> DataFrame:
    """(key, face_id): the face a report shows for each visit or person, by ``face_rank``."""
    best = faces.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(face_rank()).alias("r"))
    return best.select(key, (-F.col("r.id")).alias("face_id"))
