"""Pairing records of two tables with the nearest in time for the same entity.

Both sides are laid on one axis of (entity, time) and range-partitioned over the cluster, so an entity may
span many tasks and a task hold many entities. Each range is scanned on its own: the last right record at
or before a left one, and the first after it. What a range cannot know lies beyond its edges: every range
gives its first and last right record per entity, a prefix scan over these few rows, forward and back,
gives each range the right records that reach into it, and the two are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import cut

_KEY = ("e0", "e1")


def nearest(
    left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, entity: tuple[str, str], probe_us: Column, from_us: Column, to_us: Column, target_us: Column, right_us: Column, ranges: int | None = None
) -> DataFrame:
    """(left_id, right_id): for each left row the right row of its entity nearest to ``target_us``, of those with
    ``from_us`` <= ``right_us`` <= ``to_us``.

    ``probe_us`` is where the two sides of the search meet: all right times at or before it that count must be
    no later than the target, or all in one instant. For a window around the target it is the target, for a
    window that begins after the target the window's begin. At equal distance, and among equal times, the
    smaller right id wins. Rows with a null entity part, time or id pair with nothing; repeated rows change
    nothing; either side may be empty. Only the named columns are read, so others may clash.
    """
    spark = left.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = [F.col(c).cast("string").alias(k) for c, k in zip(entity, _KEY, strict=True)]
    none = F.lit(None).cast("bigint")
    rights = right.select(*e, right_us.alias("t"), F.lit(0).alias("side"), F.col(right_id).cast("bigint").alias("id"), none.alias("lo"), none.alias("hi"), none.alias("target"))
    lefts = left.select(*e, probe_us.alias("t"), F.lit(1).alias("side"), F.col(left_id).cast("bigint").alias("id"), from_us.alias("lo"), to_us.alias("hi"), target_us.alias("target"))
    lefts = lefts.where("lo <= hi and target is not null")
    events = rights.unionByName(lefts).where("e0 is not null and e1 is not null and t is not null and id is not null")
    # the order inside a range puts right records first among equal times, those with smaller ids last going forward
    ranged = events.repartitionByRange(ranges, "e0", "e1", "t", "side", "id").withColumn("range", F.spark_partition_id())
    ranged = cut(ranged)
    here = ranged.withColumn("right", F.when(F.col("side") == 0, F.struct("t", "id")))
    # going forward the best at one instant is the smallest id: order ids downward, so that it comes last
    w = Window.partitionBy("range", *_KEY)
    ahead = w.orderBy("t", "side", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    back = w.orderBy(F.desc("t"), F.desc("side"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    scanned = here.withColumn("before", F.last("right", ignorenulls=True).over(ahead)).withColumn("after", F.last("right", ignorenulls=True).over(back))
    # one row per range and entity; equal times may straddle an edge, so the smaller id among them is kept
    edge = ranged.groupBy("range", *_KEY).agg(
        F.min(F.when(F.col("side") == 0, F.struct("t", "id"))).alias("first"),
        F.max(F.when(F.col("side") == 0, F.struct("t", (-F.col("id")).alias("id")))).alias("last"),
    )
    over = Window.partitionBy(*_KEY)
    carried = edge.select(
        "range",
        *_KEY,
        F.max("last").over(over.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("from_left"),
        F.min("first").over(over.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)).alias("from_right"),
    ).where("from_left is not null or from_right is not null")
    found = scanned.where("side = 1").join(carried, ["range", *_KEY], "left")
    # -id makes "later, then smaller id" one comparison
    before = F.greatest(F.when(F.col("before").isNotNull(), F.struct(F.col("before.t"), (-F.col("before.id")).alias("id"))), "from_left")
    after = F.least("after", "from_right")
    found = found.select("id", "lo", "hi", "target", before.alias("b"), after.alias("a"))
    ok = lambda t: t.between(F.col("lo"), F.col("hi"))
    choice = F.least(
        F.when(ok(F.col("b.t")), F.struct(F.abs(F.col("b.t") - F.col("target")).alias("d"), (-F.col("b.id")).alias("id"))),
        F.when(ok(F.col("a.t")), F.struct(F.abs(F.col("a.t") - F.col("target")).alias("d"), F.col("a.id").alias("id"))),
    )
    return found.select(F.col("id").alias(left_id), choice["id"].alias(right_id)).where(F.col(right_id).isNotNull()).dropDuplicates([left_id])
