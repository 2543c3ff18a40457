"""Queries: vector identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.operators.reports import best_face, person_profiles
from tidemark.sources.tables import read_table

DIM = 64


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "faces").dropDuplicates(["id"])


def _gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _faces(spark, sf_dir).where("person_id is not null and is_identity_eligible and is_identity_reference")
    return f.select(F.col("id").cast("bigint").alias("face_id"), F.col("person_id").cast("bigint").alias("person_id"), F.col("embedding").alias("v"))


def identity_knn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest persons of every face with an id divisible by 50, over the whole reference gallery."""
    q = _faces(spark, sf_dir).where("id % 50 = 0").select(F.col("id").cast("bigint").alias("query_id"), F.col("embedding").alias("v"))
    return I.nearest_persons(q, _gallery(spark, sf_dir), DIM, 5)


def identity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.decide(identity_knn_candidates(spark, sf_dir), 0.35, 0.05)


def identity_reference_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = I.reference_gallery(_faces(spark, sf_dir), 5, 2)
    return g.select("person_id", F.col("id").alias("face_id"), F.col("rank").cast("bigint").alias("rank"))


def best_face_per_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_face(_faces(spark, sf_dir)).select("visit_id", F.col("id").alias("face_id"))


def gender_mode_age_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return person_profiles(_faces(spark, sf_dir)).select("person_id", "gender", "age")


def staff_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staff vector (vec_id below 10) nearest to each other embedding: a gallery of fixed size, so every row is scored where it is read."""
    e = read_table(spark, sf_dir, "embeddings")
    staff = e.where("vec_id < 10").select(F.col("vec_id").alias("staff_id"), F.col("embedding").alias("s"))
    scored = e.where("vec_id >= 10").where(I.is_vector(F.col("embedding"), DIM)).crossJoin(F.broadcast(staff))
    s = scored.select("vec_id", "staff_id", F.round(I.cosine(F.col("embedding"), F.col("s")), 6).alias("similarity"))
    best = s.groupBy("vec_id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "staff_id")).alias("b"))
    return best.select("vec_id", F.col("b.staff_id").alias("staff_id"), (-F.col("b.d")).alias("similarity"))


def staff_reference_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.mean_vectors(read_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def staff_reclassify_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that a face at least 0.5 similar to a staff vector turns into staff visits, and the person each loses.

    A member of staff is known by the best face of the smallest person that the staff number's visits name.
    """
    faces, visits = _faces(spark, sf_dir), read_table(spark, sf_dir, "visits").dropDuplicates(["id"])
    faces = faces.where(I.is_vector(F.col("embedding"), DIM)).select(F.col("id").cast("bigint").alias("face_id"), "visit_id", F.col("person_id"), "quality_score", "embedding")
    known = visits.where("staff_id is not null and person_id is not null").groupBy("staff_id").agg(F.min("person_id").alias("person_id"))
    best = faces.where("person_id is not null").groupBy("person_id").agg(F.min_by(F.struct("face_id", "embedding"), F.struct(-F.coalesce("quality_score", F.lit(0.0)), "face_id")).alias("b"))
    staff = known.join(best, "person_id").select("b.face_id", F.col("staff_id").cast("bigint").alias("person_id"), F.col("b.embedding").alias("v"))
    near = I.nearest_persons(faces.select(F.col("face_id").alias("query_id"), F.col("embedding").alias("v")), staff, DIM, 1).where("similarity >= 0.5")
    scored = near.select(F.col("query_id").alias("face_id"), F.col("person_id").alias("staff_id"), "similarity").join(faces.select("face_id", "visit_id"), "face_id")
    hit = scored.groupBy("visit_id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "staff_id")).alias("b"))
    hit = hit.select("visit_id", F.col("b.staff_id").alias("new_staff_id"), (-F.col("b.d")).alias("similarity"))
    return hit.join(visits.select(F.col("id").alias("visit_id"), "person_id", "is_staff"), "visit_id").select("visit_id", "new_staff_id", "similarity", F.col("person_id").alias("lost_person_id"), F.col("is_staff").alias("was_staff"))


def person_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person anew from its guest visits: ``delete`` without any, else ``keep`` with bounds and best face."""
    persons = read_table(spark, sf_dir, "persons").select(F.col("id").alias("person_id")).distinct()
    visits = read_table(spark, sf_dir, "visits").dropDuplicates(["id"]).where("person_id is not null and not coalesce(is_staff, false)")
    seen = visits.groupBy("person_id").agg(F.min("entered_at").alias("first_seen_at"), F.max("entered_at").alias("last_seen_at"))
    faces = _faces(spark, sf_dir).where("person_id is not null").groupBy("person_id").agg(F.min(F.struct((-F.coalesce("quality_score", F.lit(-1.0))).alias("q"), F.col("id").alias("id"))).alias("b"))
    out = persons.join(seen, "person_id", "left").join(faces, "person_id", "left")
    return out.select("person_id", F.when(F.col("first_seen_at").isNull(), "delete").otherwise("keep").alias("action"), "first_seen_at", "last_seen_at", F.col("b.id").alias("best_face_id"))


def identity_online_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of each recording assigned to persons in the order of their ids, each by the gallery as the faces before left it."""
    visits = read_table(spark, sf_dir, "visits").dropDuplicates(["id"]).select(F.col("id").alias("visit_id"), F.col("video_id").cast("bigint").alias("part")).where("part is not null")
    f = _faces(spark, sf_dir).select(F.col("id").cast("bigint").alias("face_id"), "visit_id", F.col("embedding").alias("v")).join(visits, "visit_id")
    out = I.assign_in_order(f.select("part", "face_id", "v"), "part", DIM, 0.35, 0.05, 5)
    return out.withColumnRenamed("part", "video_id")


_VALID = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
_F = f"""
WITH f AS (SELECT DISTINCT ON (id) * FROM faces ORDER BY id),
g AS (SELECT id AS face_id, person_id, embedding::DOUBLE[] AS v FROM f WHERE person_id IS NOT NULL AND is_identity_eligible AND is_identity_reference AND {_VALID.format(v='embedding')}),
q AS (SELECT id AS query_id, embedding::DOUBLE[] AS v FROM f WHERE id % 50 = 0 AND {_VALID.format(v='embedding')}),
s AS (SELECT query_id, person_id, face_id, round(list_cosine_similarity(q.v, g.v), 6) AS similarity FROM q, g),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, person_id ORDER BY similarity DESC, face_id) AS k FROM s),
c AS (SELECT query_id, person_id, face_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, person_id) AS rank FROM p WHERE k = 1)
"""
QUERIES = {
    f.__name__: f
    for f in (
        identity_knn_candidates, identity_decision, identity_reference_gallery, best_face_per_visit, gender_mode_age_median, staff_nearest, staff_reference_mean, staff_reclassify_effect,
        person_rebuild, identity_online_fold,
    )
}
ORACLE = {
    "identity_knn_candidates": _F + "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(person_id AS BIGINT) AS person_id, CAST(face_id AS BIGINT) AS face_id, similarity, rank FROM c WHERE rank <= 5",
    "identity_decision": _F + """, d AS (SELECT query_id, max(similarity) FILTER (rank = 1) AS best, max(similarity) FILTER (rank = 2) AS second, max(person_id) FILTER (rank = 1) AS p FROM c WHERE rank <= 5 GROUP BY 1),
e AS (SELECT *, CASE WHEN best < 0.35 THEN 'no_match' WHEN round(best - second, 6) < 0.05 THEN 'ambiguous' ELSE 'matched' END AS status FROM d)
SELECT CAST(query_id AS BIGINT) AS query_id, status, CAST(CASE WHEN status = 'matched' THEN p END AS BIGINT) AS person_id, best, second FROM e""",
    "identity_reference_gallery": """
WITH f AS (SELECT DISTINCT ON (id) * FROM faces ORDER BY id),
a AS (SELECT *, row_number() OVER (PARTITION BY person_id, coalesce(nullif(pose_category, ''), 'unknown') ORDER BY identity_quality_score DESC, id) AS r FROM f
  WHERE person_id IS NOT NULL AND is_identity_eligible AND embedding IS NOT NULL AND identity_quality_score IS NOT NULL),
b AS (SELECT person_id, id AS face_id, row_number() OVER (PARTITION BY person_id ORDER BY identity_quality_score DESC, id) AS rank FROM a WHERE r <= 2)
SELECT * FROM b WHERE rank <= 5""",
    "best_face_per_visit": """
SELECT visit_id, id AS face_id FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY coalesce(is_identity_eligible, false) DESC, coalesce(identity_quality_score, 0) DESC, coalesce(quality_score, 0) DESC, id) AS k FROM (SELECT DISTINCT ON (id) * FROM faces ORDER BY id)) WHERE k = 1""",
    "gender_mode_age_median": """
WITH f AS (SELECT *, CASE WHEN is_identity_reference THEN 2 WHEN is_identity_eligible THEN 1 ELSE 0 END AS tier FROM (SELECT DISTINCT ON (id) * FROM faces ORDER BY id) WHERE person_id IS NOT NULL),
t AS (SELECT f.* FROM f JOIN (SELECT person_id, max(tier) AS best FROM f GROUP BY 1) b ON f.person_id = b.person_id AND f.tier = b.best),
g AS (SELECT person_id, gender, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, q DESC, gender) AS k FROM (SELECT person_id, gender, count(*) AS n, round(sum(coalesce(identity_quality_score, 0)), 6) AS q FROM t WHERE gender IN ('m', 'f') GROUP BY 1, 2)),
a AS (SELECT person_id, round(median(age_estimate), 4) AS age FROM t GROUP BY 1)
SELECT a.person_id, g.gender, a.age FROM a LEFT JOIN g ON a.person_id = g.person_id AND g.k = 1""",
    "staff_nearest": """
WITH s AS (SELECT e.vec_id, t.vec_id AS staff_id, round(list_cosine_similarity(e.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings t WHERE e.vec_id >= 10 AND t.vec_id < 10)
SELECT vec_id, staff_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, staff_id) AS k FROM s) WHERE k = 1""",
    "staff_reference_mean": """
WITH m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY 1, 2)
SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
    "staff_reclassify_effect": f"""
WITH f AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM faces ORDER BY id) WHERE {_VALID.format(v='embedding')}),
v AS (SELECT DISTINCT ON (id) id AS visit_id, person_id, is_staff, staff_id FROM visits ORDER BY id),
p AS (SELECT staff_id, min(person_id) AS person_id FROM v WHERE staff_id IS NOT NULL AND person_id IS NOT NULL GROUP BY 1),
o AS (SELECT staff_id, embedding::DOUBLE[] AS s, row_number() OVER (PARTITION BY staff_id ORDER BY coalesce(quality_score, 0) DESC, f.id) AS k FROM f JOIN p USING (person_id)),
c AS (SELECT visit_id, o.staff_id, round(list_cosine_similarity(f.embedding::DOUBLE[], o.s), 6) AS similarity FROM f, o WHERE o.k = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY similarity DESC, staff_id) AS k FROM c)
SELECT v.visit_id, CAST(b.staff_id AS BIGINT) AS new_staff_id, b.similarity, v.person_id AS lost_person_id, v.is_staff AS was_staff FROM b JOIN v USING (visit_id) WHERE k = 1 AND similarity >= 0.5""",
    "person_rebuild": """
WITH v AS (SELECT person_id, min(entered_at) AS first_seen_at, max(entered_at) AS last_seen_at FROM (SELECT DISTINCT ON (id) * FROM visits ORDER BY id) WHERE person_id IS NOT NULL AND NOT coalesce(is_staff, false) GROUP BY 1),
f AS (SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(quality_score, -1) DESC, id) AS k FROM (SELECT DISTINCT ON (id) * FROM faces ORDER BY id) WHERE person_id IS NOT NULL)
SELECT p.id AS person_id, CASE WHEN v.first_seen_at IS NULL THEN 'delete' ELSE 'keep' END AS action, v.first_seen_at, v.last_seen_at, f.id AS best_face_id
FROM (SELECT DISTINCT id FROM persons) p LEFT JOIN v ON v.person_id = p.id LEFT JOIN f ON f.person_id = p.id AND f.k = 1""",
}
