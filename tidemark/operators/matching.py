"""Interval joins by time buckets, nearest match, and flags on matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, lo: Column, hi: Column, at: Column, bucket_us: int, keys: Sequence[str] = ()) -> DataFrame:
    """Inner join on ``lo <= at <= hi`` (microseconds, both inclusive) and equal ``keys``.

    Both sides are cut into buckets of ``bucket_us``; the left row is repeated for each bucket its window
    meets, so the join is an equi join on keys and bucket, never a nested loop, and a hot key is spread
    over its buckets. A bucket about as long as a usual window keeps a left row to two copies. Null bounds, times and
    keys join nothing. Columns of both sides must differ but for ``keys``.
    """
    a = left.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    a = a.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / bucket_us), F.floor(F.col("_hi") / bucket_us))))
    b = right.withColumn("_at", at).where("_at is not null").withColumn("_bucket", F.floor(F.col("_at") / bucket_us))
    return a.join(b, [*keys, "_bucket"]).where(F.col("_at").between(F.col("_lo"), F.col("_hi"))).drop("_bucket", "_lo", "_hi", "_at")


def nearest_match(pairs: DataFrame, left_id: str, right_id: str, distance: Column) -> DataFrame:
    """One row per left id: the candidate at the smallest distance, then smallest right id; ``candidates`` and ``is_ambiguous`` tell of others.

    A row per left id is aggregated map-side, no candidate list is sorted.
    """
    d = pairs.withColumn("_d", distance)
    best = d.groupBy(left_id).agg(F.min(F.struct("_d", right_id)).alias("_b"), F.count("*").alias("candidates"))
    return best.select(left_id, F.col(f"_b.{right_id}").alias(right_id), F.col("_b._d").alias("distance_us"), "candidates", (F.col("candidates") > 1).alias("is_ambiguous"))


def group_flags(matches: DataFrame, right_id: str) -> DataFrame:
    """Adds ``is_group_match``: more than one left row took this right row."""
    return matches.withColumn("is_group_match", F.count("*").over(Window.partitionBy(right_id)) > 1)


def sync_diff(existing: DataFrame, desired: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """(key, status): create, update, unchanged or delete, by a full join on distinct keys; nulls compare as equal."""
    a = existing.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in compare])
    b = desired.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in compare])
    same = reduce(and_, [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in compare], F.lit(True))
    status = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").when(same, "unchanged").otherwise("update")
    return a.join(b, key, "full").select(key, status.alias("status"))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows of ``incoming`` with a key that ``existing`` lacks, the first by ``order`` of each key; a null key is never new."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = incoming.join(existing.select(key), key, "left_anti").where(F.col(key).isNotNull())
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
