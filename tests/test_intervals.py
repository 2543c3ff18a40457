import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators.intervals import dyadic_union, periods_and_gaps

DDL = "person_id int, s bigint, e bigint, key string, tile int"


def brute(rows, max_gap=None):
    out = set()
    by = {}
    for p, s, e, *_ in rows:
        if p is not None and s is not None and e is not None and e >= s:
            by.setdefault(p, []).append((s, e))
    for p, v in by.items():
        done = []
        for s, e in sorted(v):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(p, "period", a, b) for a, b in done}
        out |= {(p, "gap", x[1], y[0]) for x, y in zip(done, done[1:]) if max_gap is None or y[0] - x[1] < max_gap}
    return out


def run(spark, rows, tile_bits, max_gap=None):
    df = spark.createDataFrame(rows, DDL)
    return {tuple(r) for r in periods_and_gaps(df, "person_id", F.col("s"), F.col("e"), max_gap, tile_bits).collect()}


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        s = rng.randrange(-400, 4000)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), s, s + rng.choice([0, 0, 1, 5, 40, 300, -3]), "x", 7))
    for bits in (4, 7, 12):
        assert run(spark, rows, bits) == brute(rows)
    assert run(spark, rows, 6, 20) == brute(rows, 20)


def test_touching_joins_and_one_apart_does_not(spark):
    rows = [(1, 0, 10, None, None), (1, 10, 10, None, None), (1, 11, 12, None, None), (1, 11, 12, None, None), (2, None, 3, None, None), (2, 5, 4, None, None)]
    assert run(spark, rows, 5) == {(1, "period", 0, 10), (1, "gap", 10, 11), (1, "period", 11, 12)}


def test_empty(spark):
    assert run(spark, [], 5) == set()


def test_blocks_cover_what_the_intervals_cover():
    rng = np.random.default_rng(3)
    lo = rng.integers(0, 200, 60)
    hi = np.minimum(256, lo + rng.integers(1, 30, 60))
    k, a, b = dyadic_union(np.zeros(60, np.int64), lo, hi, 8)
    want = np.zeros(256, bool)
    for x, y in zip(lo, hi):
        want[x:y] = True
    got = np.zeros(256, bool)
    for x, y in zip(a, b):
        assert not got[x:y].any()
        got[x:y] = True
    assert (got == want).all() and (b[:-1] < a[1:]).all() and (k == 0).all()


def test_long_intervals_stay_whole_between_their_ends(spark, monkeypatch):
    """Blocks above the tile beside short intervals in, at the edge of and after what they cover."""
    from tidemark.operators import intervals

    monkeypatch.setattr(intervals, "LONG_TILES", 3)
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        s = rng.randrange(-4000, 40_000)
        rows.append((rng.choice([1, 2, 2, 3]), s, s + rng.choice([0, 1, 5, 9, 40, rng.choice([200, 700, 3000]) if rng.random() < 0.02 else 2]), "x", 7))
    for bits in (3, 5, 8):
        assert run(spark, rows, bits) == brute(rows)
    assert run(spark, rows, 4, 20) == brute(rows, 20)


def test_millennia_are_a_few_blocks(spark):
    year = 31_556_952_000_000
    rows = [(1, 0, 8000 * year, None, None), (1, 5 * year, 5 * year + 10, None, None), (1, -50, -40, None, None), (1, 8000 * year + 5, 8000 * year + 6, None, None), (2, 5, 80 * year, None, None)] * 3
    assert run(spark, rows, 33) == brute(rows)
