"""The queries of the llm problems, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us
from tidemark.llm.clusters import describe_clusters, name_clusters, similarity_clusters
from tidemark.llm.nearest_time import nearest
from tidemark.llm.packing import fill_figures, pack
from tidemark.llm.pii import find_mentions, sanitise
from tidemark.llm.tokens import decode_ids, token_ids
from tidemark.llm.vectors import nearest_vectors
from tidemark.sources.tables import read_table

WINDOW_AFTER_US = 60_000_000
CAPACITY = 1024


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, persons = read_table(spark, sf_dir, "faces"), read_table(spark, sf_dir, "persons")
    return nearest_vectors(faces.select("id", "embedding"), persons.select("id", "face_embedding"), "id", "embedding", "id", "face_embedding")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _neighbours(spark, sf_dir)
    pair = F.when(F.col("query"), F.struct(F.lit("person_face").alias("kind"), F.col("id").alias("key_a"), F.col("neighbour").alias("key_b"))).otherwise(
        F.struct(F.lit("face_face").alias("kind"), F.least("id", "neighbour").alias("key_a"), F.greatest("id", "neighbour").alias("key_b"))
    )
    return n.select(pair.alias("p")).select("p.*").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = read_table(spark, sf_dir, "visit_sessions").where("entered_at is not null and left_at is not null").select("id", "video_id", "entered_at", "left_at")
    videos = read_table(spark, sf_dir, "videos").select("video_id", "camera_name").distinct()
    cameras = read_table(spark, sf_dir, "cameras").select("camera_name", "tt", "table_number")
    left = sessions.join(videos, "video_id").join(cameras, "camera_name").withColumn("table_number", F.col("table_number").cast("bigint"))
    left = left.select(F.col("id").alias("visit_session_id"), "tt", "table_number", epoch_us(F.col("entered_at")).alias("from_us"), epoch_us(F.col("left_at")).alias("left_us"))
    right = read_table(spark, sf_dir, "receipts").select(F.col("id").alias("receipt_id"), "tt", F.col("table_number").cast("bigint").alias("table_number"), epoch_us(F.col("closed_at")).alias("closed_us"))
    return nearest(
        left, right, left_id="visit_session_id", right_id="receipt_id", entity=("tt", "table_number"), probe_us=F.greatest("from_us", "left_us"),
        from_us=F.col("from_us"), to_us=F.col("left_us") + WINDOW_AFTER_US, target_us=F.col("left_us"), right_us=F.col("closed_us"),
    )


def _cluster_members(spark: SparkSession, sf_dir: str, flow: bool = True) -> DataFrame:
    return similarity_clusters(read_table(spark, sf_dir, "faces").select("id", "embedding"), "id", "embedding", flow=flow)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_clusters(_cluster_members(spark, sf_dir, flow=False))


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical faces of every cluster."""
    return describe_clusters(_cluster_members(spark, sf_dir))


def p7_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical faces of every Markov cluster, before chains are joined."""
    return describe_clusters(_cluster_members(spark, sf_dir), "markov")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids; null as the empty text."""
    return decode_ids(p8_ids(spark, sf_dir), "doc_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", count_only=True)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, the least by volume, and the mean share of a container in use."""
    return fill_figures(p9_containers(spark, sf_dir), "n_tokens", CAPACITY)


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, over_capacity, split_though_fitting, wrong_total, wrong_offsets): documents that lie in containers, and what must not be: containers
    over capacity, texts split though they fit, texts of which tokens are missing or twice, pieces that do not begin where the piece before ends."""
    sizes = _sizes(spark, sf_dir)
    packed = pack(sizes, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("n_tokens", "size")
    over = packed.groupBy("container_id").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("over_capacity"))
    per = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("placed"), F.sum((F.col("start") != F.col("piece_no") * CAPACITY).cast("int")).alias("off"))
    both = sizes.where("n_tokens > 0").join(per, "doc_id", "full")
    seen = both.agg(
        F.count_if(F.col("pieces").isNotNull()).alias("documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("split_though_fitting"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("wrong_total"),
        F.count_if(F.col("off") > 0).alias("wrong_offsets"),
    )
    return seen.crossJoin(over).select("documents", "over_capacity", "split_though_fitting", "wrong_total", "wrong_offsets")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_mentions(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "kind", "found_text").distinct()


def p10_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders for its mentions."""
    return sanitise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p3_found": p3_found, "p4_found": p4_found, "p7_found": p7_found, "p7_clusters": p7_clusters, "p7_markov": p7_markov,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_fill": p9_fill, "p9_invariants": p9_invariants,
    "p10_found": p10_found, "p10_sanitised": p10_sanitised,
}

_P4 = """
WITH s AS (
  SELECT DISTINCT v.id, c.tt, c.table_number, v.entered_at AS lo, v.left_at AS target
  FROM visit_sessions v JOIN videos d ON v.video_id = d.video_id JOIN cameras c ON d.camera_name = c.camera_name
  WHERE v.entered_at IS NOT NULL AND v.left_at IS NOT NULL
), r AS (
  SELECT s.id AS visit_session_id, r.id AS receipt_id,
    row_number() OVER (PARTITION BY s.id ORDER BY abs(epoch_us(r.closed_at) - epoch_us(s.target)), r.id) AS k
  FROM s JOIN receipts r ON r.tt = s.tt AND r.table_number = s.table_number
    AND r.closed_at BETWEEN s.lo AND s.target + INTERVAL 60 SECOND
)
SELECT CAST(visit_session_id AS BIGINT) AS visit_session_id, CAST(receipt_id AS BIGINT) AS receipt_id FROM r WHERE k = 1
"""

_P8_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

_P9_INVARIANTS = """
SELECT count(*) AS documents, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS split_though_fitting, CAST(0 AS BIGINT) AS wrong_total, CAST(0 AS BIGINT) AS wrong_offsets
FROM documents WHERE text <> ''
"""

ORACLE = {"p9_invariants": _P9_INVARIANTS, "p4_found": _P4, "p8_decoded": _P8_DECODED}
