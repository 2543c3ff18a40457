from datetime import datetime, timezone

import pytest

from tidemark.operators.instants import order_shares, parse_texts, resolve_instants

DDL = "id int, text string, source string, time_zone string, date_order string"


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2025-02-25T10:40:25", "Europe/Moscow", "dmy", us(2025, 2, 25, 7, 40, 25)),
    (" 2024-07-31 04:35:22,581\t", "UTC", "dmy", us(2024, 7, 31, 4, 35, 22) + 581_000),
    ("2024-01-31 23:57:25.532+0300", None, None, us(2024, 1, 31, 20, 57, 25) + 532_000),
    ("2024-09-04T10:09:31.4079209Z", None, None, us(2024, 9, 4, 10, 9, 31) + 407_920),
    ("04/05/2025 17:52", "UTC", "dmy", us(2025, 5, 4, 17, 52)),
    ("04/05/2025 17:52", "UTC", "mdy", us(2025, 4, 5, 17, 52)),
    ("13/05/2025 17:52", "UTC", "mdy", None),
    ("11/2/2025 12:01:53 AM", "UTC", "mdy", us(2025, 11, 2, 0, 1, 53)),
    ("27.08.25 15:23:11", "UTC", "mdy", us(2025, 8, 27, 15, 23, 11)),
    ("6.05.2025, 20:25", "UTC", "mdy", us(2025, 5, 6, 20, 25)),
    ("03-27-2025 Thu 22:15:57", "UTC", "dmy", us(2025, 3, 27, 22, 15, 57)),
    ("04 02 2025 Wed 004257", "UTC", "dmy", us(2025, 4, 2, 0, 42, 57)),
    ("2025-03-27_20-19-57", "UTC", "dmy", us(2025, 3, 27, 20, 19, 57)),
    ("20240724162806", "UTC", None, us(2024, 7, 24, 16, 28, 6)),
    ("20240102T090703Z", "Asia/Kolkata", None, us(2024, 1, 2, 9, 7, 3)),
    ("1747644993", "Asia/Kolkata", None, 1747644993_000_000),
    ("1742453261160", None, None, 1742453261160_000),
    ("1751447936769789", None, None, 1751447936769789),
    ("2024-08-17 07:45:58 MSK", "UTC", None, us(2024, 8, 17, 4, 45, 58)),
    ("2024-08-29T10:00:00+02:00[Europe/Berlin]", "UTC", None, us(2024, 8, 29, 8)),
    ("2025-09-26 22:31:18 Europe/Moscow", "UTC", None, us(2025, 9, 26, 19, 31, 18)),
    ("Sun, 26 Oct 2025 03:15:31 +0100", None, None, us(2025, 10, 26, 2, 15, 31)),
    ("15. März 2024 22:06", "Europe/Berlin", None, us(2024, 3, 15, 21, 6)),
    ("2025-10-26 02:30:00", "Europe/Berlin", None, us(2025, 10, 26, 0, 30)),
    ("2025-03-30 02:30:00", "Europe/Berlin", None, None),
    ("2025-11-02 01:30", "America/New_York", None, us(2025, 11, 2, 5, 30)),
    ("2024-06-31 12:00:00+03:00", None, None, None),
    ("07.11.2024", "UTC", None, None),
    ("10:44:51", "UTC", None, None),
    ("2025-02-25 10:40:25+05", None, None, us(2025, 2, 25, 5, 40, 25)),
    ("Jan 2, 2024 10:00", "UTC", None, us(2024, 1, 2, 10)),
    ("Tue, March 5 2024 10:00", "UTC", None, us(2024, 3, 5, 10)),
    ("1743159705.25", None, None, 1743159705_250_000),
    ("05.13.2025 10:00", "UTC", None, None),
    ("2025-01-01 24:00", "UTC", None, None),
    ("2031-01-01 00:00", "UTC", None, None),
    ("n/a", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
    ("2025-01-01 10:00", None, None, None),
    ("x" * 50_000, "UTC", None, None),
]


def test_forms_and_zones(spark):
    df = spark.createDataFrame([(i, t, f"s{i}", z, o) for i, (t, z, o, _) in enumerate(CASES)], DDL)
    got = {r.id: r.epoch_us for r in resolve_instants(df, "text", "source", "time_zone", "date_order").collect()}
    for i, (text, *_, want) in enumerate(CASES):
        assert got[i] == want, (text, got[i], want)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York"])
def test_session_zone_has_no_say(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        test_forms_and_zones(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_shares_decide_where_no_order_is_declared(spark):
    rows = [(i, f"{13 + i % 10}/05/2024 10:00", "a", "UTC", None) for i in range(20)] + [(100, "04/05/2024 10:00", "a", "UTC", None), (101, "04/05/2024 10:00", "b", "UTC", None), (102, "05/05/2024 10:00", "b", "UTC", None)]
    df = spark.createDataFrame(rows, DDL)
    got = {r.id: (r.status, r.epoch_us) for r in resolve_instants(df, "text", "source", "time_zone", "date_order").collect()}
    assert got[100] == ("instant", us(2024, 5, 4, 10))
    assert got[101] == ("ambiguous", None)
    assert got[102] == ("instant", us(2024, 5, 5, 10))
    share = {r.source: r.shares for r in order_shares(parse_texts(df, "text"), "source", "date_order").collect()}
    assert share["a"][0] > 0.9 and share["b"][0] == share["b"][1]


def test_texts_outweigh_a_declared_order(spark):
    """A prior is worth a hundred texts: a few dates that fit the other order only are noise, four hundred turn the source."""
    rows = [(i, f"{13 + i % 15}/05/2024 10:00", "wrong", "UTC", "mdy") for i in range(1500)] + [(i, f"05/{13 + i % 15}/2024 10:00", "right", "UTC", "mdy") for i in range(1500, 1600)]
    rows += [(9000, "04/05/2024 10:00", "wrong", "UTC", "mdy"), (9001, "04/05/2024 10:00", "right", "UTC", "mdy"), (9002, "13/05/2024 10:00", "right", "UTC", "mdy")]
    got = {r.id: (r.status, r.epoch_us) for r in resolve_instants(spark.createDataFrame(rows, DDL), "text", "source", "time_zone", "date_order").where("id >= 9000 or id = 0").collect()}
    assert got[9000] == ("instant", us(2024, 5, 4, 10)) and got[0] == ("instant", us(2024, 5, 13, 10))
    assert got[9001] == ("instant", us(2024, 4, 5, 10)) and got[9002] == ("none", None)


def test_abbreviations_of_several_offsets(spark):
    rows = [(1, "2024-05-05 10:00 IST", "a", "Asia/Kolkata", None), (2, "2024-01-05 10:00 IST", "b", "Asia/Jerusalem", None), (3, "2024-05-05 10:00 IST", "c", None, None), (4, "2024-01-05 10:00 CST", "d", "Asia/Shanghai", None), (5, "2024-01-05 10:00 CST", "e", "UTC", None)]
    got = {r.id: (r.status, r.epoch_us) for r in resolve_instants(spark.createDataFrame(rows, DDL), "text", "source", "time_zone", "date_order").collect()}
    assert got[1] == ("instant", us(2024, 5, 5, 4, 30)) and got[2] == ("instant", us(2024, 1, 5, 8)) and got[4] == ("instant", us(2024, 1, 5, 2))
    assert got[3] == got[5] == ("ambiguous", None)


def test_empty(spark):
    assert resolve_instants(spark.createDataFrame([], DDL), "text", "source", "time_zone", "date_order").count() == 0
