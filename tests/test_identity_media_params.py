import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import params
from tidemark.functions import geometry as G
from tidemark.functions import text as X
from tidemark.operators import identity as I
from tidemark.operators import sampling as P
from tidemark.operators import timeline as T


def vectors(n, seed=1):
    return np.random.default_rng(seed).normal(size=(n, 8)).round(3)


def test_nearest_persons_and_decision(spark):
    g, q = vectors(90), vectors(20, 2)
    person = [i % 7 for i in range(90)]
    gdf = spark.createDataFrame([(i, person[i], v.tolist()) for i, v in enumerate(g)] + [(900, 1, [0.0] * 8), (901, 1, None)], "face_id bigint, person_id bigint, v array<double>").repartition(3)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None), (98, [float("nan")] * 8)], "query_id bigint, v array<double>")
    got = I.nearest_persons(qdf, gdf, 8, 3)
    u, w = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, g))
    s = np.round(u @ w.T, 6)
    want = set()
    for i in range(20):
        best = {}
        for j in range(90):
            best[person[j]] = min(best.get(person[j], (9, 9)), (-s[i, j], j))
        for r, (p, (d, j)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:3], 1):
            want.add((i, p, j, round(-d, 6), r))
    assert {tuple(r) for r in got.collect()} == want
    c = spark.createDataFrame([(1, 5, 0, 0.35, 1), (1, 6, 1, 0.3, 2), (2, 5, 0, 0.34, 1), (3, 5, 0, 0.9, 1), (3, 6, 0, 0.86, 2), (4, 7, 0, 0.6, 1)], "query_id int, person_id int, face_id int, similarity double, rank int")
    assert {r.query_id: (r.status, r.person_id) for r in I.decide(c, 0.35, 0.05).collect()} == {1: ("matched", 5), 2: ("no_match", None), 3: ("ambiguous", None), 4: ("matched", 7)}


def shuffled_rows(plan):
    """Rows written by the exchanges of a plan that ran."""
    kind, m = plan.getClass().getSimpleName(), plan.metrics()
    n = m.apply("shuffleRecordsWritten").value() if m.contains("shuffleRecordsWritten") else 0
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below = plan.children()
    return n + sum(map(shuffled_rows, inner + [below.apply(i) for i in range(below.size())]))


def test_nearest_persons_hands_on_the_best_persons_only(spark):
    g, q = vectors(2000), vectors(100, 2)
    gdf = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(g)], "face_id bigint, person_id bigint, v array<double>").repartition(2)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, v array<double>").repartition(2)
    got = I.nearest_persons(qdf, gdf, 8, 3)
    assert len(got.collect()) == 300
    # of 200 000 (query, person) pairs
    assert shuffled_rows(got._jdf.queryExecution().executedPlan()) < 10_000


@pytest.mark.parametrize(("persons", "of", "element"), [(3, 400, "float"), (40, 6, "float"), (400, 6, "double"), (100, 1, "float")])
def test_nearest_persons_over_many_blocks_with_ties(spark, monkeypatch, persons, of, element):
    """Fewer persons than k, equal vectors of several persons, near ones: as when every pair is computed."""
    monkeypatch.setattr(I, "BLOCK", 32)
    rng = np.random.default_rng(persons)
    # few distinct vectors, and copies of them that differ by less than single precision tells
    w = rng.normal(size=(of * 10, 8))[rng.integers(0, of * 10, 500)] * (1 + rng.choice([0, 3e-7], (500, 8)))
    u, person = np.concatenate([w[:20], rng.normal(size=(60, 8))]), rng.integers(0, persons, 500)
    u, w = (x.astype(np.float32 if element == "float" else np.float64).astype(np.float64) for x in (u, w))
    gdf = spark.createDataFrame([(i, int(person[i]), v.tolist()) for i, v in enumerate(w)], f"face_id bigint, person_id bigint, v array<{element}>").repartition(3)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], f"query_id bigint, v array<{element}>")
    got = {(r.query_id, r.rank): (r.person_id, r.face_id, r.similarity) for r in I.nearest_persons(qdf, gdf, 8, 5).collect()}
    un, wn = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (u, w))
    s = np.round(np.einsum("ik,jk->ij", un, wn), 6)
    want = {}
    for i in range(len(u)):
        best = {}
        for j in range(500):
            best[person[j]] = min(best.get(person[j], (9, 9)), (-s[i, j], j))
        for r, (p, (d, j)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:5], 1):
            want[i, r] = (p, j, -d)
    assert got == want


def test_reference_gallery_is_greedy_with_a_cap_per_pose(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2]), rng.choice(["l", "r", "f", None]), rng.choice([0.1, 0.5, 0.9, None]), i % 7 != 0, [1.0] if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, person_id int, pose_category string, identity_quality_score double, is_identity_eligible boolean, embedding array<float>")
    want = set()
    for p in (1, 2):
        n, taken = {}, []
        for i, _, pose, q, *_ in sorted((r for r in rows if r[1] == p and r[3] is not None and r[4] and r[5]), key=lambda r: (-r[3], r[0])):
            if len(taken) < 5 and n.get(pose, 0) < 2:
                n[pose] = n.get(pose, 0) + 1
                taken.append(i)
        want |= set(taken)
    assert {r.id for r in I.reference_gallery(df, 5, 2).collect()} == want


def test_ordered_assignment(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.7, 0.7], None, [1.0]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "part bigint, face_id bigint, v array<double>")
    got = {r.face_id: (r.status, r.person_no) for r in I.assign_in_order(df, "part", 2, 0.35, 0.1, 5).collect()}
    assert got == {0: ("no_match", 0), 1: ("matched", 0), 2: ("no_match", 1), 3: ("ambiguous", None), 4: ("invalid", None), 5: ("invalid", None)}


def test_polygon_edges_count_as_inside(spark):
    corners = ((0, 0), (10, 0), (10, 10), (5, 5), (0, 10))
    df = spark.range(-2, 13).select(F.col("id").alias("x")).crossJoin(spark.range(-2, 13).select(F.col("id").alias("y")))
    got = {(r.x, r.y) for r in df.where(G.in_polygon(F.col("x"), F.col("y"), corners)).collect()}
    assert got == {(x, y) for x in range(11) for y in range(11) if y <= max(10 - x, x)}
    assert spark.range(1).select(G.floor_half(F.lit(-3)).alias("h")).first().h == -2


@pytest.mark.parametrize("text,want", [("06-22-202f Mon10:01:58", 1782122518), ("06 22 2026 Mon 100158", 1782122518), ("13-22-2026 Mon 10:01:58", None), ("06-22-2026 Mon 10:01:58 11:02:59", 1782126179), ("06-22-2026", None), (None, None),
    ("06-22-2026 Tue 10 11 12", 1782123072), ("06-22-2026 Tue 10:11 12", 1782123072), ("06-22-2026 Tue 10.11.12", 1782123072), ("06-22-2026 Tue 10-11-12", 1782123072), ("06-22-2026 Tue 9:11:12", 1782119472),
    ("06-22-2026 Tue 1011:12", 1782123072), ("06.22.2026 Tue 10:11:7", 1782123067), ("06 - 22 .2026/Tuey10:11:12", 1782123072), ("06-22-2026 Tue 25:11:12", None), ("06-22-2026 10:11:12 Tue", None)])
def test_clock(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.clock_us(F.col("t")).alias("u")).first().u
    assert got == (None if want is None else want * 1_000_000)


def test_amounts(spark):
    rows = [("1 234,565 ₽", "1234.57"), ("-5", "-5.00"), ("", None), ("x", None), (None, None), ("1 0,1", "10.10"), ("9999999999999,999", "10000000000000.00"), ("99999999999999", None), ("0.0049999999999999999999999999", "0.00"), ("-0,005", "-0.01")]
    got = spark.createDataFrame(rows, "t string, w string").select(X.amount(F.col("t")).cast("string").alias("a"), "w").collect()
    assert all(r.a == r.w for r in got)


def test_consensus(spark):
    rows = [(1, 0, 100), (1, 5, 101), (1, 10, 500), (1, 20, 502), (2, 0, 7), (3, 0, None), (4, 0, 10), (4, 5, 11), (4, 10, 12)]
    df = spark.createDataFrame(rows, "k int, o int, s bigint")
    got = {r.k: (r.n_consistent, r.spread_us, r.s, r.o) for r in T.consensus(df, "k", "s", "o", 2, 2).withColumnRenamed("start_us", "s").withColumnRenamed("offset", "o").collect()}
    assert got == {1: (2, 1, 100, 0), 2: (1, 0, None, None), 4: (3, 2, 11, 5)}


def test_end_status_bounds(spark):
    got = [r.s for r in spark.createDataFrame([(2,), (-3,), (10,), (11,), (None,)], "d int").select(T.end_status(F.col("d"), 2, 10).alias("s")).collect()]
    assert got == ["valid", "calibrated", "calibrated", "mismatch", "unavailable"]


def test_adaptive_sampling_rewinds(spark):
    df = spark.createDataFrame([(1, i, i in (0, 100)) for i in range(140)], "video_id bigint, frame_index bigint, seen boolean")
    out = P.adaptive(df, 1.0, params.Sampling(1, 7, 30, 5)).orderBy("proc_seq").collect()
    active = [r.frame_index for r in out if r.mode == "active"]
    assert active == [*range(31), *range(95, 131)]
    assert [r.frame_index for r in out if r.mode == "idle"] == [37, 44, 51, 58, 65, 72, 79, 86, 93, 100, 137]
    assert {(r.mode, r.epoch) for r in out} == {("active", 0), ("idle", 0), ("active", 1), ("idle", 1)}


def test_params():
    with pytest.raises(ValueError):
        params.Sampling(active_s=2, idle_s=1)
    with pytest.raises(ValueError):
        params.Timeline(start_offsets_s=(1, 2))
    with pytest.raises(ValueError):
        params.Timeline(min_end=9)
    with pytest.raises(ValueError):
        params.Identity(threshold=2)
    p = params.Params(database_url="db://u:secret@h/x")
    assert "secret" not in str(p.snapshot()) and p.digest() == params.Params().digest()
    assert params.Sampling().strides(25.0) == (3, 30)


def test_faces_are_searched_on_every_nth_active_frame_since_wake(spark):
    df = spark.createDataFrame([(1, i, i in (0, 10, 15, 101, 106)) for i in range(140)], "video_id bigint, frame_index bigint, seen boolean")
    out = P.adaptive(df, 1.0, params.Sampling(1, 7, 30, 5)).orderBy("proc_seq").collect()
    # somebody seen on the idle frame 101 starts the second epoch at 96, so its search comes at 106
    assert [(r.frame_index, r.active_seq) for r in out if r.face_search] == [(0, 0), (10, 10), (106, 10)]
    assert all((r.active_seq is None) == (r.mode == "idle") for r in out)


def test_parameters_from_a_file(tmp_path):
    at = tmp_path / "p.json"
    at.write_text('{"time_zone": "UTC", "matching": {"after_s": 30}, "timeline": {"start_offsets_s": [0, 1]}}')
    p = params.load(str(at))
    assert p.time_zone == "UTC" and p.matching.after_s == 30 and p.timeline.start_offsets_s == (0, 1) and p.faces == params.Faces()
    for bad in ('{"nowhere": 1}', '{"faces": {"max_yaw": 91}}', '{"detection": {"tracker": "other"}}', '{"matching": {"after_s": "x"}}', '{"faces": 3}', "[]"):
        at.write_text(bad)
        with pytest.raises(ValueError):
            params.load(str(at))


def test_boxes_at_the_border_crops_and_growth(spark):
    df = spark.createDataFrame([(5, 5, 20, 20), (3, 5, 20, 20), (5, 5, 97, 20), (5, 5, 96, 96)], "a int, b int, c int, d int")
    box = [F.col(c) for c in "abcd"]
    got = df.select(G.clipped_at_border(*box, F.lit(100), F.lit(100), 3).alias("e"), G.expand(*box, 0.1, 0.5, 0.1, 0.0)[1].alias("g"), G.crop_bounds(*box[:2], F.col("c"), F.col("d"), F.lit(100), F.lit(26)).alias("k")).collect()
    assert [r.e for r in got] == [False, True, True, False] and [r.g for r in got] == [-2, -2, -2, -40] and [r.k for r in got] == [True, True, False, False]
    o = df.select(G.overlap(box, [F.lit(5), F.lit(5), F.lit(20), F.lit(35)]).alias("o"), G.overlap(box, [F.lit(0)] * 4).alias("z")).collect()
    assert o[0].o == 0.5 and o[0].z == 0.0


def test_detections_suppressed_by_stronger_ones(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9, 0), (1, 2, 1, 0, 11, 10, 0.8, 0), (1, 3, 2, 0, 12, 10, 0.7, 0), (1, 4, 50, 50, 60, 60, 0.3, 0), (1, 5, 50, 50, 60, 60, 0.9, 7), (2, 6, 0, 0, 10, 10, 0.5, 0), (2, 7, 0, 0, 10, 10, 0.5, 0)]
    df = spark.createDataFrame(rows, "frame bigint, box bigint, x1 int, y1 int, x2 int, y2 int, confidence double, class int")
    # 2 falls to 1; 3 overlaps 2 more than allowed, but not 1, so it stays; of equal ones the smaller id
    assert sorted(r.box for r in P.detections(df, "frame", "box", 0.4, 0.7, 0).collect()) == [1, 3, 6]


def test_visits_on_the_clock(spark):
    df = spark.createDataFrame([(1, 5_000_000, 9_000_000, 1_000_000, 100_000_000, True), (2, 9, 5, 0, 0, None), (3, 1, 2, 0, None, False)], "i int, a bigint, b bigint, r bigint, k bigint, e boolean")
    got = T.enrich_visits(df, "a", "b", "r", "k", "e").orderBy("i").collect()
    assert [(r.entered_us, r.left_us, r.duration_us, r.visit_day, r.time_is_estimated) for r in got] == [(104_000_000, 108_000_000, 4_000_000, 0, True), (None, None, None, None, False), (None, None, None, None, False)]
    got = df.select(T.anchor_start_us(F.col("k"), F.col("r")).alias("s"), T.anchor_end_us(F.col("k"), F.col("r"), F.lit(10)).alias("e")).collect()
    assert [(r.s, r.e) for r in got] == [(99_000_000, 99_000_010), (0, 10), (None, None)]


def test_reading_attempts_as_json(spark):
    import json

    df = spark.createDataFrame([(2.0, 50, 2.0, "06-22 x", 60_000_000), (5.0, 125, 5.0, None, None)], "o double, f bigint, t double, x string, c bigint")
    got = [json.loads(r.attempt) for r in T.attempt_json(df, "o", "f", "t", "x", "c").orderBy("o").collect()]
    assert got[0]["parsed_datetime"] == "1970-01-01T00:01:00" and got[0]["recorded_start_at"] == "1970-01-01T00:00:58" and got[0]["succeeded"]
    assert got[1] == {"requested_offset_seconds": 5.0, "frame_index": 125, "timestamp_seconds": 5.0, "raw_text": None, "parsed_datetime": None, "recorded_start_at": None, "succeeded": False}


def test_limit_counts_frames_that_exist(spark):
    df = spark.createDataFrame([(i,) for i in range(60) if i != 20], "i bigint")
    assert sorted(r.i for r in P.every(df, "i", 10, 10, 3).collect()) == [10, 30, 40]
