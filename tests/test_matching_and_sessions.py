import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import matching as M
from tidemark.operators import sessions as S

T0 = datetime(2025, 3, 1)


def test_interval_join_is_inclusive_and_complete(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "a", "b", None]), lo := rng.randrange(-500, 500), lo + rng.choice([0, 10, 90, 400, -1])) for i in range(200)]
    right = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-500, 500)])) for i in range(200)]
    a = spark.createDataFrame(left, "l int, k string, lo bigint, hi bigint")
    b = spark.createDataFrame(right, "r int, k string, t bigint")
    for bucket in (7, 60, 5000):
        got = {(r.l, r.r) for r in M.interval_join(a, b, F.col("lo"), F.col("hi"), F.col("t"), bucket, ["k"]).collect()}
        assert got == {(x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and y[2] is not None and x[2] <= y[2] <= x[3]}


def test_nearest_ties_and_group_flags(spark):
    pairs = spark.createDataFrame([(1, 9, 5), (1, 8, 5), (1, 7, 6), (2, 8, 1), (3, 5, 2)], "l int, r int, d bigint")
    got = {r.l: (r.r, r.candidates, r.is_ambiguous, r.is_group_match) for r in M.group_flags(M.nearest_match(pairs, "l", "r", F.col("d")), "r").collect()}
    assert got == {1: (8, 3, True, True), 2: (8, 1, False, True), 3: (5, 1, False, False)}


def test_sync_diff_and_insert(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "z"), (4, "w")], "k int, v string")
    assert {tuple(r) for r in M.sync_diff(old, new, "k", ["v"]).collect()} == {(1, "unchanged"), (2, "update"), (3, "delete"), (4, "create")}
    more = spark.createDataFrame([(4, "b", 2), (4, "a", 1), (1, "c", 3), (None, "d", 4)], "k int, v string, n int")
    assert [tuple(r) for r in M.insert_new(old, more, "k", [F.col("n")]).collect()] == [(4, "a", 1)]


VISITS = "id int, event_key string, video_id int, person_id int, visit_date date, entered_at timestamp_ntz, left_at timestamp_ntz, entry_frame_index int, exit_frame_index int, time_is_estimated boolean, is_staff boolean"


def fold(rows, gap_s):
    """The same sessions one visit after another."""
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(r[1], r)
    out, by = [], {}
    for r in first.values():
        if r[10]:
            continue
        if r[3] is None:
            out.append((r[1],))
        else:
            by.setdefault((r[2], r[3]), []).append(r)
    for v in by.values():
        s = []
        for r in sorted(v, key=lambda r: (r[7] is None, r[7] or 0, r[0])):
            d = r[4] or (r[5].date() if r[5] else None)
            if s and None not in (d, s[-1][1], r[5], s[-1][2]) and d == s[-1][1] and (r[5] - s[-1][2]).total_seconds() <= gap_s:
                s[-1][0].append(r[1])
                s[-1][2] = max(x for x in (s[-1][2], r[6]) if x is not None)
            else:
                s.append([[r[1]], d, r[6]])
        out += [tuple(sorted(k)) for k, *_ in s]
    return sorted(out)


def test_merge_equals_the_fold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        a = T0 + timedelta(seconds=rng.randrange(0, 3000))
        rows.append((i, f"k{i % 480}", rng.choice([1, 2]), rng.choice([1, 2, 3, None]), rng.choice([date(2025, 3, 1), date(2025, 3, 1), date(2025, 3, 2), None]), rng.choice([a, a, a, None]), rng.choice([a + timedelta(seconds=30), None]), rng.choice([i, 500 - i, None]), i, False, rng.random() < 0.1))
    got = S.merge_visits(spark.createDataFrame(rows, VISITS), 90_000_000)
    want = fold(rows, 90)
    assert got.count() == len(want)
    from hashlib import sha256

    keys = {"session_" + sha256("|".join(k).encode()).hexdigest() for k in want}
    assert {r.session_key for r in got.select("session_key").collect()} == keys


def test_close_by_gap_follows_the_frame_before(spark):
    frames = [(1, i, t) for i, t in enumerate([0, 50, 120, 300, 310])]
    df = spark.createDataFrame(frames, "v int, seq int, ts bigint")
    seen = spark.createDataFrame([(1, 0, 0, "a"), (1, 3, 300, "a"), (1, 0, 0, "b"), (1, 1, 50, "b"), (1, 2, 120, "b")], "v int, seq int, ts bigint, tr string")
    got = {(r.tr, r.visit_no, r.first_us, r.last_us, r.n) for r in S.close_by_gap(df, seen, "v", "tr", "seq", "ts", 90).collect()}
    # a: the frame at 120 closed it; b: no frame lies between
    assert got == {("a", 1, 0, 0, 1), ("a", 2, 300, 300, 1), ("b", 1, 0, 120, 3)}


def test_even_sample(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(3)], "k int, i int")
    got = {}
    for r in S.even_sample(df.withColumn("v", F.col("i")), "k", "i", "v").collect():
        got.setdefault(r.k, {})[r.pos] = r.v
    assert got[1] == {p: round(p * 99 / 19) for p in range(20)} and got[2] == {0: 0, 1: 1, 2: 2}
