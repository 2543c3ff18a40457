"""The queries of the general data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.storage import cut
from tidemark.functions.time import epoch_us
from tidemark.operators.instants import order_shares, parse_texts, resolve_instants
from tidemark.operators.intervals import periods_and_gaps
from tidemark.operators.rejects import failing_records, strict_load
from tidemark.sources.tables import read_table
from tidemark.streaming.sessions import run_to_end

DAY_US = 86_400_000_000
SESSION_GAP_US = 90_000_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = read_table(spark, sf_dir, "visits").select("person_id", "entered_at", "left_at")
    return periods_and_gaps(visits, "person_id", epoch_us(F.col("entered_at")), epoch_us(F.col("left_at")), max_gap_us=DAY_US)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing_records(read_table(spark, sf_dir, "receipt_lines"), "line_id", "raw_line")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid receipts, typed."""
    return strict_load(read_table(spark, sf_dir, "receipt_lines"), "line_id", "raw_line")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = read_table(spark, sf_dir, "cameras")
    shops = cameras.groupBy("tt").agg(F.min("time_zone").alias("time_zone"), F.min("date_order").alias("date_order"))
    stage = read_table(spark, sf_dir, "receipts_stage")
    receipts = stage.select(
        F.lit("receipt").alias("record_kind"),
        F.col("stage_id").cast("bigint").alias("row_id"),
        F.col("tt").alias("source"),
        F.explode(F.create_map(F.lit("opened_at"), "opened_at", F.lit("closed_at"), "closed_at")).alias("field_name", "text"),
    ).join(shops.withColumnRenamed("tt", "source"), "source", "left")
    videos = read_table(spark, sf_dir, "videos").select(
        F.lit("video").alias("record_kind"), F.col("video_id").cast("bigint").alias("row_id"), F.col("camera_name").alias("source"),
        F.lit("recorded_start_at").alias("field_name"), F.col("recorded_start_at").alias("text"),
    )
    videos = videos.join(cameras.select(F.col("camera_name").alias("source"), "time_zone", "date_order"), "source", "left")
    return receipts.unionByName(videos)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_instants(_texts(spark, sf_dir), "text", "source", "time_zone", "date_order")
    # exact copies of a row have one instant; a filter after the grouping is not pushed below it, where all would be worked out twice
    return resolved.groupBy("record_kind", "row_id", "field_name").agg(F.max("epoch_us").alias("epoch_us")).where("epoch_us is not null")


def p5_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with no date order declared: how many of each source are resolved, and its day-first share."""
    texts = _texts(spark, sf_dir).withColumn("date_order", F.lit(None).cast("string"))
    parsed = cut(parse_texts(texts, "text"))
    shares = order_shares(parsed, "source", "date_order").where("family = 'slash'").select("source", F.round(F.get("shares", F.lit(0)), 4).alias("dmy_share"))
    status = resolve_instants(texts, "text", "source", "time_zone", "date_order").groupBy("source").agg(
        F.count_if(F.col("status") == "instant").alias("instants"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
        F.count_if(~F.col("status").isin("instant", "ambiguous")).alias("other"),
    )
    return status.join(shares, "source", "left").select("source", "instants", "ambiguous", "other", "dmy_share")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(spark, f"{sf_dir}/visits.parquet", SESSION_GAP_US)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_loaded": p2_loaded, "p5_found": p5_found, "p5_undeclared": p5_undeclared, "p6_found": p6_found}

_P1 = """
WITH v AS (
  SELECT DISTINCT person_id, epoch_us(entered_at) AS s, epoch_us(left_at) AS e FROM visits
  WHERE person_id IS NOT NULL AND left_at >= entered_at
), m AS (
  SELECT *, max(e) OVER (PARTITION BY person_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM v
), g AS (
  SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY s, e) AS k FROM m
), p AS (
  SELECT person_id, min(s) AS s, max(e) AS e FROM g GROUP BY person_id, k
), n AS (
  SELECT *, lag(e) OVER (PARTITION BY person_id ORDER BY s) AS before FROM p
)
SELECT CAST(person_id AS BIGINT) AS person_id, 'period' AS kind, s AS start_us, e AS end_us FROM p
UNION ALL
SELECT CAST(person_id AS BIGINT), 'gap', before, s FROM n WHERE s - before < 86400000000
"""

_P2 = r"""
WITH r AS (
  SELECT line_id, raw_line,
    regexp_full_match(raw_line, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*', 's') AS quoted,
    len(regexp_replace(raw_line, '"([^"]|"")*"', '', 'gs')) - len(replace(regexp_replace(raw_line, '"([^"]|"")*"', '', 'gs'), ',', '')) + 1 AS width,
    regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS f
  FROM receipt_lines
), u AS (
  SELECT *, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) AS v FROM r
), j AS (
  SELECT line_id, CASE
    WHEN raw_line IS NULL THEN 'column_count'
    WHEN NOT quoted THEN 'quoting'
    WHEN width <> 7 THEN 'column_count'
    WHEN NOT regexp_full_match(v[2], '[A-Za-z0-9._/-]{1,128}') THEN 'external_receipt_id'
    WHEN v[5] <> '' AND NOT regexp_full_match(translate(v[5], '₽ ' || chr(160) || chr(8239), ''), '-?[0-9]{1,10}([.,][0-9]+)?') THEN 'amount'
    WHEN v[6] <> '' AND NOT regexp_full_match(v[6], '[1-9][0-9]{0,2}(\.0)?') THEN 'table_number'
  END AS reason
  FROM u
)
SELECT DISTINCT line_id, reason FROM j WHERE reason IS NOT NULL
"""

_P6 = """
WITH v AS (
  SELECT DISTINCT ON (event_key) event_key, video_id, person_id, visit_date, epoch_us(entered_at) AS s, epoch_us(left_at) AS e FROM visits
  WHERE person_id IS NOT NULL AND visit_date IS NOT NULL AND left_at >= entered_at AND NOT is_staff
), m AS (
  SELECT *, max(e) OVER (PARTITION BY video_id, person_id, visit_date ORDER BY s, e, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM v
), g AS (
  SELECT *, sum(CASE WHEN far IS NULL OR s - far > 90000000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, person_id, visit_date ORDER BY s, e, event_key) AS k FROM m
)
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(person_id AS BIGINT) AS person_id, min(s) AS start_us, max(e) AS end_us, count(*) AS n_visits
FROM g GROUP BY video_id, person_id, visit_date, k
"""

_P2_LOADED = (
    _P2.rpartition("SELECT DISTINCT")[0]
    + r""", k AS (SELECT line_id, v, nullif(replace(translate(v[5], '₽ ' || chr(160) || chr(8239), ''), ',', '.'), '') AS a FROM u WHERE line_id IN (SELECT line_id FROM j WHERE reason IS NULL))
SELECT line_id, nullif(v[1], '') AS tt, v[2] AS external_receipt_id, nullif(v[3], '') AS opened_at, nullif(v[4], '') AS closed_at, CAST(round(CAST(a AS DECIMAL(38, 18)), 2) AS DECIMAL(16, 2)) AS amount,
  CAST(nullif(regexp_replace(v[6], '\.0$', ''), '') AS INTEGER) AS table_number, nullif(v[7], '') AS client_external_id FROM k"""
)

ORACLE = {"p1_found": _P1, "p2_found": _P2, "p2_loaded": _P2_LOADED, "p6_found": _P6}
