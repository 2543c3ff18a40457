import random
from datetime import date, datetime, timedelta

from tidemark.streaming.sessions import run_to_end

DDL = "event_key string, video_id int, person_id int, visit_date date, entered_at timestamp_ntz, left_at timestamp_ntz, is_staff boolean, id int, start_us string"
T0 = datetime(2025, 3, 1)


def brute(rows, gap):
    seen, by = set(), {}
    for k, v, p, d, a, b, staff, *_ in rows:
        if k in seen or None in (v, p, d, a, b) or b < a or staff:
            continue
        seen.add(k)
        by.setdefault((v, p, d), []).append((a, b))
    out = []
    for (v, p, _), x in by.items():
        s = []
        for a, b in sorted(x):
            if s and (a - s[-1][1]).total_seconds() * 1e6 <= gap:
                s[-1][1] = max(s[-1][1], b)
                s[-1][2] += 1
            else:
                s.append([a, b, 1])
        us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        out += [(v, p, us(a), us(b), n) for a, b, n in s]
    return sorted(out)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        a = T0 + timedelta(seconds=rng.randrange(0, 40_000), microseconds=rng.randrange(10))
        b = a + timedelta(seconds=rng.choice([0, 10, 90, 500, -5]))
        rows.append((f"k{i}", rng.choice([1, 2]), rng.choice([1, 2, None]), rng.choice([date(2025, 3, 1), date(2025, 3, 1), None]), rng.choice([a, a, a, None]), b, rng.random() < 0.1, i, "clash"))
    rows.append(("gap0", 9, 9, date(2025, 3, 1), T0, T0 + timedelta(seconds=10), False, 0, ""))
    rows.append(("gap1", 9, 9, date(2025, 3, 1), T0 + timedelta(seconds=100), T0 + timedelta(seconds=100), False, 0, ""))
    rows.append(("gap2", 9, 9, date(2025, 3, 1), T0 + timedelta(seconds=190, microseconds=1), T0 + timedelta(seconds=200), False, 0, ""))
    rows += rows[:50] + [(*r[:7], 5000 + i, r[8]) for i, r in enumerate(rows[50:100])]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "visits.parquet"))
    got = sorted(tuple(r) for r in run_to_end(spark, str(tmp_path / "visits.parquet"), 90_000_000).collect())
    assert got == brute(rows, 90_000_000)
    assert [r[4] for r in got if r[0] == 9] == [2, 1]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "visits.parquet"))
    assert run_to_end(spark, str(tmp_path / "visits.parquet"), 90_000_000).count() == 0
