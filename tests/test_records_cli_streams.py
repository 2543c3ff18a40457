import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import records as R
from tidemark.plans import records as plans
from tidemark.sources import files
from tidemark.streaming.points import stream_first_per_key, stream_point_sessions

DATA = "/root/testdata/sf0.001"


def test_staff_keys(spark):
    rows = [("1", "cashier_0001"), (" 42 ", "cashier_0042"), ("12345", "cashier_12345"), ("0", None), ("-1", None), ("x", None), (None, None)]
    assert all(r.k == r.w for r in spark.createDataFrame(rows, "n string, w string").select(R.staff_key(F.col("n")).alias("k"), "w").collect())


@pytest.mark.parametrize("text,ok", [("06-22-2026 Mon 10:01:58", True), ("06-22-2026 Tue 10:01:58", False), ("06-31-2026 Mon 10:01:58", False), ("06-22-2026 Mon 24:01:58", False), ("06-22-2026 Mon 10:01:58 ", False), (None, False)])
def test_manual_start(spark, text, ok):
    got = spark.createDataFrame([(text,)], "t string").select(R.manual_start_us(F.col("t")).alias("u")).first().u
    assert got == (1782122518_000_000 if ok else None)


def test_cascades(spark):
    c = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, p int")
    p = spark.createDataFrame([(10,)], "p int")
    assert {tuple(r) for r in R.delete_cascade(c, p, "p").select("id", "p").collect()} == {(1, 10), (3, None)}
    assert {tuple(r) for r in R.delete_cascade(c, p, "p", "set_null").select("id", "p").collect()} == {(1, 10), (2, None), (3, None)}


def test_anchor_frames_round_half_to_even(spark):
    rows = [(0.5, 25.0, 100, 12), (1.5, 25.0, 100, 38), (4.0, 25.0, 100, None), (-1.0, 25.0, 100, None), (1.0, None, 100, None)]
    assert all(r.f == r.w for r in spark.createDataFrame(rows, "o double, fps double, n int, w int").select(R.anchor_frame(F.col("o"), F.col("fps"), F.col("n")).alias("f"), "w").collect())


def test_fingerprints(spark, tmp_path):
    for name, text in (("a.MP4", "x"), ("b.mp4", "x"), ("c.txt", "y")):
        (tmp_path / name).write_text(text)
    f = files.fingerprints(spark, str(tmp_path), (".mp4",)).collect()
    assert len(f) == 2 and len({r.sha256 for r in f}) == 1
    assert cli.main(["register-videos", str(tmp_path), str(tmp_path / "out")], spark) == {"files": 3, "registered": 2}


def test_import_is_idempotent_and_keeps_rejects(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('TT,OrderId,openTime,dl_tm,OrderSum,stol_num,Client_TTGID\nT,A,2025-01-01T10:00:00,2025-01-01T10:05:00,"1 234,565 ₽",7.0,\nT,A,2025-01-01T11:00:00,2025-01-01T11:05:00,2,7,\nT,B,2025-01-01T10:00:00,2025-01-01T10:05:00,oops,7,\nT,C,2025-01-01T10:00:00,2025-01-01T10:05:00,,,\n')
    out = str(tmp_path / "receipts")
    assert cli.main(["import-receipts", str(p), out], spark) == {"rows": 4, "imported": 2, "rejected": 1}
    assert cli.main(["import-receipts", str(p), out], spark)["imported"] == 0
    row = spark.read.parquet(out).where("external_receipt_id = 'A'").first()
    assert str(row.amount) == "1234.57" and row.table_number == 7 and row.opened_at == datetime(2025, 1, 1, 10)


def test_register_staff_twice(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("id_staff,position,first_name,last_name,gender,age\n1, Cook ,Ann,Bo,f,3\n2,,C,,m,4\n")
    out = str(tmp_path / "staff")
    assert cli.main(["register-staff", str(p), out], spark) == {"registered": 2, "stored": 2}
    p.write_text("id_staff,position,first_name,last_name,gender,age\n2,lead,C,D,m,4\n3,x,E,F,m,4\n")
    assert cli.main(["register-staff", str(p), out], spark) == {"registered": 2, "stored": 3}
    assert spark.read.parquet(out).where("staff_key = 'cashier_0002'").first().full_name == "C D"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_sync_and_match_settle(spark, tmp_path):
    for command in ("sync-visit-sessions", "match-receipts"):
        out = str(tmp_path / command)
        first = cli.main([command, DATA, out], spark)
        again = cli.main([command, DATA, out], spark)
        assert first["create"] > 0 and again == {"create": 0, "update": 0, "unchanged": first["create"], "delete": 0}


def test_config_check_and_version(capsys):
    assert cli.main(["version"])["version"]
    assert len(cli.main(["config-check"])["digest"]) == 64


def test_streams_of_points(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("a", t), ("a", t + timedelta(minutes=9)), ("a", t + timedelta(hours=2)), ("b", t), ("z", t + timedelta(days=9))]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("s", stream_point_sessions(src(), "k", "ts", "10 minutes", "1 hour")), ("f", stream_first_per_key(src(), "k", "ts", "1 hour"))):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_counted_visit_is_linked_to_its_merged_session(spark):
    visits = spark.read.parquet(f"{DATA}/visits.parquet").where("not coalesce(is_staff, false)")
    links = plans.visit_session_links(spark, DATA)
    assert links.count() == links.select("event_key").distinct().count() == visits.select("event_key").distinct().count()
    assert links.select("session_key").distinct().count() < links.count()
    assert {r.n for r in plans.visit_link_assertions(spark, DATA).collect()} == {0}
    alone = plans.visit_links(spark, DATA).withColumn("w", F.concat(F.lit("session_"), F.sha2("event_key", 256)))
    assert alone.count() > 0 and alone.where("w <> session_key").isEmpty()


def test_links_to_visits_that_are_not_loaded_are_counted(spark):
    v = spark.createDataFrame([("a",), ("b",)], "event_key string")
    s = spark.createDataFrame([("s", ["a", "x", "y"])], "session_key string, event_keys array<string>")
    assert [r.n for r in R.link_violations(v, s).orderBy("n").collect()] == [1, 2]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_sync_deletes_recordings_without_sessions(spark, tmp_path):
    src, out = tmp_path / "tables", str(tmp_path / "sessions")
    visits = spark.read.parquet(f"{DATA}/visits.parquet").where("video_id is not null")
    visits.write.parquet(str(src / "visits.parquet"))
    cli.main(["sync-visit-sessions", str(src), out], spark)
    gone = visits.agg(F.min("video_id")).first()[0]
    visits.where(f"video_id <> {gone}").write.parquet(str(tmp_path / "later" / "visits.parquet"))
    assert cli.main(["sync-visit-sessions", str(tmp_path / "later"), out], spark)["delete"] > 0
    assert cli.main(["sync-visit-sessions", str(tmp_path / "later"), out], spark)["delete"] == 0
    assert spark.read.parquet(out).where(f"video_id = {gone}").isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_matches_of_sessions_without_bounds_survive(spark, tmp_path):
    src, out = str(tmp_path / "tables"), str(tmp_path / "matches")
    shutil.copytree(DATA, src)
    first = cli.main(["match-receipts", src, out], spark)
    one = spark.read.parquet(out).agg(F.min("visit_session_id")).first()[0]
    os.remove(f"{src}/visit_sessions.parquet")
    s = spark.read.parquet(f"{DATA}/visit_sessions.parquet")
    s.withColumn("left_at", F.when(F.col("id") != one, F.col("left_at"))).write.parquet(f"{src}/visit_sessions.parquet")
    assert cli.main(["match-receipts", src, out], spark)["delete"] == 0
    assert spark.read.parquet(out).count() == first["create"]
