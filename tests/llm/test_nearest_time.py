import random

from pyspark.sql import functions as F

from tidemark.llm.nearest_time import nearest

L = "sid int, tt string, n int, lo bigint, out bigint, t int, side string"
R = "rid int, tt string, n int, closed bigint, range string"


def run(spark, left, right, ranges):
    df = nearest(
        spark.createDataFrame(left, L), spark.createDataFrame(right, R), left_id="sid", right_id="rid", entity=("tt", "n"), probe_us=F.greatest("lo", "out"),
        from_us=F.col("lo"), to_us=F.col("out") + 60, target_us=F.col("out"), right_us=F.col("closed"), ranges=ranges,
    )
    return {tuple(r) for r in df.collect()}


def brute(left, right):
    out = set()
    for s, tt, n, lo, hi, *_ in left:
        if None in (s, tt, n, lo, hi):
            continue
        c = [(abs(r[3] - hi), r[0]) for r in right if r[1] == tt and r[2] == n and r[3] is not None and lo <= r[3] <= hi + 60]
        if c:
            out.add((s, min(c)[1]))
    return out


def test_against_brute_force_with_a_hot_entity_over_many_ranges(spark):
    rng = random.Random(8)
    who = lambda: ("A", 1) if rng.random() < 0.7 else (rng.choice(["A", "B", None]), rng.choice([1, 2, None]))
    right = [(i, *who(), rng.choice([rng.randrange(0, 3000), rng.randrange(0, 3000), None]), "x") for i in range(500)]
    left = []
    for i in range(500):
        lo = rng.randrange(0, 3000)
        left.append((i, *who(), rng.choice([lo, lo, lo, None]), lo + rng.choice([0, 5, 100, 700, -10, -100]), 0, "y"))
    right += right[:40]
    left += left[:40]
    for ranges in (1, 7, 40):
        assert run(spark, left, right, ranges) == brute(left, right)


def test_ties_go_to_the_smaller_id(spark):
    left = [(1, "A", 1, 0, 100, 0, ""), (2, "A", 1, 100, 100, 0, "")]
    right = [(9, "A", 1, 90, ""), (8, "A", 1, 110, ""), (7, "A", 1, 110, "")]
    assert run(spark, left, right, 3) == {(1, 7), (2, 7)}


def test_empty_sides(spark):
    assert run(spark, [], [(1, "A", 1, 5, "")], 3) == set()
    assert run(spark, [(1, "A", 1, 0, 10, 0, "")], [], 3) == set()
