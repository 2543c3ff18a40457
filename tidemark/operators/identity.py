"""Vector identity: exact nearest persons of a stated query set, decisions, reference galleries, ordered assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, under half a megabyte of 64 values, as Java's heap keeps larger arrays apart; queries scored at once, so that their
#: similarities stay in the processor's cache; pairs gathered at once.
BLOCK, ROWS, GATHER = 1792, 256, 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def is_vector(v: Column, dim: int) -> Column:
    """``dim`` finite values, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _kind(rows: DataFrame) -> type:
    """The number type of the vectors ``v``; float32 stays, any other is double."""
    return np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64


def _pack(rows: DataFrame, dim: int, *keys: str) -> DataFrame:
    """Numbered blocks of at most BLOCK vectors as bytes, with their key columns as arrays; evened out, as every block meets many others."""
    kind = _kind(rows)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK - n))
                n, b = n + held[-1].num_rows, b.slice(held[-1].num_rows)
                if n == BLOCK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            x = t["v"].combine_chunks().flatten().to_numpy().astype(kind, copy=False)
            ids = [pa.array([t[k].to_numpy()], pa.list_(pa.int64())) for k in keys]
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()), *ids], names=["x", *keys])

    rows = rows.where(is_vector(F.col("v"), dim)).select("v", *keys)
    packed = rows.mapInArrow(run, "x binary, " + ", ".join(f"{k} array<bigint>" for k in keys))
    return packed.withColumn("block", F.monotonically_increasing_id()).hint("rebalance", "block")


def _units(x: pa.Buffer, kind: type, dim: int) -> np.ndarray:
    """Packed vectors in double precision, scaled to length one."""
    a = np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def _best_persons(row: np.ndarray, person: np.ndarray, face: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, person, face, s) of each row's ``k`` best persons, best first, with the best face of each."""
    o = np.lexsort((face, -s, person, row))
    first = np.ones(len(o), bool)
    first[1:] = (np.diff(row[o]) != 0) | (np.diff(person[o]) != 0)
    o = o[first]
    o = o[np.lexsort((person[o], -s[o], row[o]))]
    o = o[np.arange(len(o)) - np.searchsorted(row[o], row[o]) < k]
    return row[o], person[o], face[o], s[o]


def _meet(a: np.ndarray, b: np.ndarray, person: np.ndarray, face: np.ndarray, k: int, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """``found``, the ``_best_persons`` of the queries ``a`` so far, after these met the faces ``b``, sorted by person too.

    A product in single precision, whose error is bounded, leaves out the pairs that cannot come under the ``k`` best; the others are
    computed in double precision.
    """
    # more than the product (dim + 4 roundings of 2 ** -24) and the rounding to 6 decimals can be off
    off = (a.shape[1] + 8) * 2.0**-24 + 1e-6
    a4, b4 = a.astype(np.float32), b.astype(np.float32).T
    at = np.nonzero(np.r_[True, person[1:] != person[:-1]])[0]
    out = []
    for i in range(0, len(a), ROWS):
        row, *rest = (x[slice(*np.searchsorted(found[0], (i, i + ROWS)))] for x in found)
        s = a4[i : i + ROWS] @ b4
        least = np.full(len(s), -np.inf)
        last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
        least[row[last] - i] = rest[-1][last]
        hit = None
        if np.isneginf(least).any():  # fewer than k persons so far: each person's best faces, of the best persons if these are k
            best = np.maximum.reduceat(s, at, axis=1)
            if len(at) >= k:
                least = np.maximum(least, np.partition(best, len(at) - k, axis=1)[:, len(at) - k] - off)
            hit = s >= np.repeat(best, np.diff(np.r_[at, len(person)]), axis=1) - np.float32(2 * off)
        near = s >= (least - off).astype(np.float32)[:, None]
        r, c = np.divmod(np.flatnonzero(near if hit is None else near & hit), len(b))
        exact = [np.einsum("ij,ij->i", a[i + r[j : j + GATHER]], b[c[j : j + GATHER]]) for j in range(0, len(r), GATHER)]
        if exact:
            new = (i + r, person[c], face[c], np.round(np.concatenate(exact), 6))
            row, *rest = _best_persons(*(np.concatenate(x) for x in zip((row, *rest), new, strict=True)), k)
        out.append((row, *rest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_persons(queries: DataFrame, gallery: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, person_id, face_id, similarity, rank): of (query_id, v) the k persons of (face_id, person_id, v) with the most similar face.

    Exact: every query meets every gallery vector, block against block as one matrix product. A task keeps the
    k best persons of each of its queries over all blocks that it sees, and hands on only these: a person among
    the k best of all is so too where its best face is. Similarities are rounded to 6 decimals; then the
    smaller face decides within a person, the smaller person between them.
    """
    q_kind, g_kind = _kind(queries), _kind(gallery)
    q = _pack(queries, dim, "query_id").select(F.col("x").alias("qx"), "query_id", "block")
    g = _pack(gallery, dim, "face_id", "person_id").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, np.ndarray] = {}
        found: dict[int, tuple[np.ndarray, ...]] = {}
        none = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0))
        for b in batches:
            for r in range(b.num_rows):
                block, a, x = b["block"][r].as_py(), b["qx"][r].as_buffer(), b["x"][r].as_buffer()
                query, face, person = (b[c][r].values.to_numpy() for c in ("query_id", "face_id", "person_id"))
                o = np.lexsort((face, person))
                ids[block] = query.copy()
                found[block] = _meet(_units(a, q_kind, dim), _units(x, g_kind, dim)[o], person[o], face[o], k, found.get(block, none))
        for block, (row, person, face, s) in found.items():
            yield pa.record_batch([pa.array(x) for x in (ids[block][row], person, face, s)], names=["query_id", "person_id", "face_id", "similarity"])

    found = g.crossJoin(q).mapInArrow(run, "query_id bigint, person_id bigint, face_id bigint, similarity double")
    per = found.groupBy("query_id", "person_id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "face_id")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("d", "person_id")
    ranked = per.select("query_id", "person_id", "b.d", "b.face_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "person_id", "face_id", (-F.col("d")).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def decide(candidates: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(query_id, status, person_id, best, second): matched, ambiguous or no_match from each query's ranked candidates."""
    best = F.max(F.when(F.col("rank") == 1, F.col("similarity")))
    second = F.max(F.when(F.col("rank") == 2, F.col("similarity")))
    d = candidates.groupBy("query_id").agg(best.alias("best"), second.alias("second"), F.max(F.when(F.col("rank") == 1, F.col("person_id"))).alias("_p"))
    status = F.when(F.col("best") < threshold, "no_match").when(F.round(F.col("best") - F.col("second"), 6) < margin, "ambiguous").otherwise("matched")
    return d.select("query_id", status.alias("status"), F.when(status == "matched", F.col("_p")).alias("person_id"), "best", "second")


def reference_gallery(faces: DataFrame, per_person: int, per_pose: int) -> DataFrame:
    """Each person's best faces by quality, then id: at most ``per_pose`` of a pose and ``per_person`` in all, as two ranks.

    Faces without vector, person or identity quality, and those not eligible, are left out.
    """
    faces = faces.where("person_id is not null and is_identity_eligible and embedding is not null and identity_quality_score is not null")
    order = [F.desc("identity_quality_score"), F.asc("id")]
    pose = F.coalesce(F.nullif("pose_category", F.lit("")), F.lit("unknown"))
    r = faces.withColumn("_pose", pose).withColumn("_r", F.row_number().over(Window.partitionBy("person_id", "_pose").orderBy(*order))).where(F.col("_r") <= per_pose)
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("person_id").orderBy(*order))).where(F.col("rank") <= per_person)
    return r.drop("_pose", "_r")


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): the mean of each key's vectors, scaled to length one."""
    m = rows.select(key, F.posexplode(vector).alias("pos", "_x")).groupBy(key, "pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return m.withColumn("value", F.col("_m") / F.sqrt(F.sum(F.col("_m") * F.col("_m")).over(Window.partitionBy(key)))).select(key, "pos", "value")


def assign_in_order(faces: DataFrame, part: str, dim: int, threshold: float, margin: float, per_person: int) -> DataFrame:
    """(part, face_id, person_no, status, best): each part's faces in the order of their ids, each compared with the gallery as the ones before left it.

    A face like none starts a new person, one that is ambiguous or no vector joins none. Every face depends on
    those before, so a part is one task; parts are independent. A gallery keeps ``per_person`` vectors a person.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("face_id")
        vectors: list[list[np.ndarray]] = []
        out = []
        for part_, face, v in zip(f[part], f["face_id"], f["v"], strict=True):
            x = None if v is None else np.asarray(v, np.float64)
            if x is None or len(x) != dim or not np.isfinite(x).all() or not x.any():
                out.append((part_, face, None, "invalid", None))
                continue
            x = x / np.sqrt(x @ x)
            s = [round(float((np.stack(g) @ x).max()), 6) for g in vectors]
            o = sorted(range(len(s)), key=lambda i: (-s[i], i))
            best = s[o[0]] if o else None
            if best is None or best < threshold:
                vectors.append([x])
                out.append((part_, face, len(vectors) - 1, "no_match", best))
            elif len(o) > 1 and round(best - s[o[1]], 6) < margin:
                out.append((part_, face, None, "ambiguous", best))
            else:
                if len(vectors[o[0]]) < per_person:
                    vectors[o[0]].append(x)
                out.append((part_, face, o[0], "matched", best))
        return pd.DataFrame(out, columns=["part", "face_id", "person_no", "status", "best"])

    return faces.groupBy(part).applyInPandas(run, "part bigint, face_id bigint, person_no bigint, status string, best double")
