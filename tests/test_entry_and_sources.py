import importlib
import os
import re

import pytest

from tidemark.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_imports_the_llm_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"tidemark\.llm|from \.+llm", open(os.path.join(folder, f)).read()), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_runs(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).limit(1).count() == 1


def test_delimited_files(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(' TT , OrderId,openTime,dl_tm,OrderSum,stol_num,Client_TTGID\nT1,A,o,c,"1,5",7,\n')
    row = tables.read_receipts_csv(spark, str(p)).first()
    assert (row.TT, row.OrderSum, row.source_file) == ("T1", "1,5", "r.csv")
    with pytest.raises(ValueError):
        tables.read_receipts_csv(spark, "x.txt")
    s = tmp_path / "s.csv"
    s.write_text("id_staff,position,first_name,last_name,gender,age\n1,a,b,c,m,3\n1,a,b,c,m,3\n")
    with pytest.raises(ValueError):
        tables.read_staff_csv(spark, str(s))
    s.write_text("id_staff,position\n1,a\n")
    with pytest.raises(ValueError):
        tables.read_staff_csv(spark, str(s))


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "v int, x string"), at, "v")
    tables.write_partitioned(spark.createDataFrame([(2, "c")], "v int, x string"), at, "v")
    assert {tuple(r) for r in spark.read.parquet(at).select("v", "x").collect()} == {(1, "a"), (2, "c")}


def test_photos_of_keys(spark):
    from tidemark.sources.files import photos_of

    listed = spark.createDataFrame([("file:/p/a.JPG",), ("file:/p/a.png",), ("file:/p/b.txt",), ("file:/p/c.d.jpeg",)], "path string")
    got = {r.k: r.path for r in photos_of(listed, spark.createDataFrame([("a",), ("b",), ("c.d",)], "k string"), "k").collect()}
    assert got == {"a": "file:/p/a.JPG", "b": None, "c.d": "file:/p/c.d.jpeg"}
