"""Keeping stored records in step: keys, upserts, links and cascades; anchors of a recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def staff_key(number: Column) -> Column:
    """``cashier_`` and the positive number in at least four digits; null for any other text."""
    n = F.when(F.trim(number).rlike(r"\A[0-9]{1,9}\z"), F.trim(number).try_cast("int"))
    return F.when(n > 0, F.concat(F.lit("cashier_"), F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0"))))


def clean_staff(registry: DataFrame) -> DataFrame:
    """(staff_key, full_name, position) of a registry of texts; a row without a valid number is left out."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    name = F.nullif(F.concat_ws(" ", tidy(F.col("first_name")), tidy(F.col("last_name"))), F.lit(""))
    rows = registry.select(staff_key(F.col("id_staff")).alias("staff_key"), name.alias("full_name"), F.lower(tidy(F.col("job_position"))).alias("position"))
    return rows.where("staff_key is not null")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All keys of both sides with the incoming row where there is one; keys must be distinct on each side."""
    rest = existing.join(incoming.select(key), key, "left_anti")
    return incoming.unionByName(rest.select(*incoming.columns))


def delete_cascade(children: DataFrame, parents: DataFrame, key: str, on_delete: str = "cascade") -> DataFrame:
    """Children after a delete of parents: without those whose parent is gone, or with the link nulled (``set_null``). A null link stays."""
    if on_delete == "cascade":
        gone = children.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_semi")
        return gone.unionByName(children.where(F.col(key).isNull()).select(*gone.columns))
    there = parents.select(key).distinct().withColumn("_there", F.lit(True))
    return children.join(there, key, "left").withColumn(key, F.when(F.col("_there"), F.col(key))).drop("_there").select(*children.columns)


def link_visits(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(event_key, session_key): each visit's session, from the sessions' lists of event keys."""
    return sessions.select("session_key", F.explode("event_keys").alias("event_key")).join(visits.select("event_key").distinct(), "event_key").select("event_key", "session_key")


def link_violations(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(check, n): event keys that sessions link but no visit has, and visits that no session links."""
    linked = sessions.select(F.explode("event_keys").alias("event_key"))
    count = lambda a, b, name: a.join(b, "event_key", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return count(linked, visits.select("event_key"), "linked visits not loaded").unionByName(count(visits.select("event_key"), linked, "loaded visits not linked"))


def anchor_frame(offset_s: Column, fps: Column, frames: Column) -> Column:
    """Frame of an offset, rounded half to even; null where it is outside the recording."""
    at = F.rint(offset_s * fps).cast("bigint")
    return F.when((offset_s >= 0) & (fps > 0) & (at < frames), at)


def manual_start_us(text: Column) -> Column:
    """Wall microseconds of ``MM-DD-YYYY Day HH:MM:SS``; null unless the form is exact, all parts are valid and the weekday is that of the date."""
    form = r"\A(\d{2}-\d{2}-\d{4}) (Mon|Tue|Wed|Thu|Fri|Sat|Sun) ([01]\d|2[0-3]):([0-5]\d):([0-5]\d)\z"
    part = lambda i: F.regexp_extract(text, form, i)
    day = F.when(text.rlike(form), F.try_to_date(part(1), "MM-dd-yyyy"))
    same = F.get(F.array(*map(F.lit, _DAYS)), F.weekday(day)) == part(2)
    seconds = part(3).try_cast("bigint") * 3600 + part(4).try_cast("bigint") * 60 + part(5).try_cast("bigint")
    return F.when(same, F.unix_date(day).cast("bigint") * 86_400_000_000 + seconds * 1_000_000)


def resolve_anchor(consensus_us: Column, consensus_n: Column, needed: int, manual_us: Column, enabled: Column) -> tuple[Column, Column]:
    """(start, source): the readings' consensus if reading is on and enough agree, else the manual start, else none."""
    read = enabled & (consensus_n >= needed) & consensus_us.isNotNull()
    source = F.when(read, "ocr").when(manual_us.isNotNull(), "manual").otherwise("manual_required")
    return F.when(read, consensus_us).otherwise(manual_us), source


def event_key(track: Column, first: Column, last: Column) -> Column:
    """``track:first:last``, the name of a visit."""
    return F.concat_ws(":", track, first.cast("string"), last.cast("string"))


def merge_json(old: Column, new: Column) -> Column:
    """Two string maps as one; the new value wins."""
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(new, F.create_map().cast("map<string,string>"))), k))
    return F.map_concat(keep, F.coalesce(new, F.create_map().cast("map<string,string>")))


def local_time(ts_us: Column, zone: str) -> Column:
    """Wall microseconds in a zone of an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(ts_us), zone))


def status_counts(diff: DataFrame, statuses: Sequence[str] = ("create", "update", "unchanged", "delete")) -> DataFrame:
    """One row with a count per status, zeros included."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
